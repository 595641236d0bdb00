from pyspark.sql import functions as F

from quillgate.functions.identity import folded, uuid_value

VALUE = "4f45922476d14f8db39c41b2eb1515ae"


def test_identifier_forms_state_one_value(spark):
    forms = [VALUE, VALUE.upper(), f"  {VALUE} ", "{" + VALUE.upper() + "}", "4f459224-76d1-4f8d-b39c-41b2eb1515ae", "urn:uuid:4f459224-76d1-4f8d-b39c-41b2eb1515ae", "0x" + VALUE, f"({VALUE})"]
    rows = spark.createDataFrame([(f,) for f in forms], "v string").select(F.lower(F.hex(uuid_value(F.col("v")))).alias("v")).collect()
    assert {r.v for r in rows} == {VALUE}


def test_placeholders_and_damaged_identifiers_state_nothing(spark):
    bad = [None, "", "   ", "0" * 32, "f" * 32, "00000000-0000-0000-0000-000000000000", "unknown", VALUE[:-1], VALUE + "a", "g" + VALUE[1:]]
    rows = spark.createDataFrame([(b,) for b in bad], "v string").select(uuid_value(F.col("v")).alias("v")).collect()
    assert all(r.v is None for r in rows)


def test_folded(spark):
    rows = spark.createDataFrame([(" OK\t",), ("",), (None,), ("  ",)], "v string").select(folded(F.col("v")).alias("v")).collect()
    assert [r.v for r in rows] == ["ok", None, None, None]
