import time

import pytest
from pyspark.sql import functions as F

from quillgate.session import Options, Principal, SessionCache, TimedOut
from tests.test_guard import _session
from tests.test_plans import CATALOG, ROWS, SCHEMAS


def test_rows_are_capped_and_audited(spark):
    seen = []
    s = _session(spark, audit=seen.append, principal=Principal("ann", "t1"))
    query = s.query("select id from sale order by id")
    result = s.run(query.df, query.query_hash, Options(max_rows=4))
    assert [r[0] for r in result.rows] == [0, 1, 2, 3] and result.truncated and result.columns == ["id"]
    assert not s.run(query.df, query.query_hash, Options(max_rows=60)).truncated
    assert [(a.status, a.principal_id, a.tenant_id, a.row_count) for a in seen] == [("ok", "ann", "t1", 4), ("ok", "ann", "t1", 60)]


def test_timeout_stops_the_job(spark):
    seen = []
    s = _session(spark, audit=seen.append)
    slow = s.spark.range(0, 10**12, 1, 4).select(F.sum(F.sqrt("id") * F.sin("id")).alias("x"))
    began = time.time()
    with pytest.raises(TimedOut):
        s.run(slow, "q", Options(timeout_s=2))
    assert time.time() - began < 30 and seen[-1].status == "timeout"
    assert s.run(s.sql("select count(*) as n from sale")).rows == [(60,)]


def test_errors_are_recorded(spark):
    seen = []
    s = _session(spark, audit=seen.append)
    with pytest.raises(RuntimeError):
        s.run(s.sql("select id / (id - id) as x from sale"), "q")
    assert seen[-1].status == "error" and "DIVIDE" in seen[-1].error.upper()


def test_sessions_are_kept_by_principal_and_catalog(spark):
    sources = {t: (lambda s, t=t: s.createDataFrame(ROWS[t], SCHEMAS[t])) for t in ROWS}
    cache = SessionCache(spark, sources, most=2)
    a = cache.get(CATALOG, Principal("a"))
    assert cache.get(CATALOG, Principal("a")) is a and cache.get(CATALOG, Principal("b")) is not a
    cache.get(CATALOG, Principal("c"))
    assert cache.get(CATALOG, Principal("a")) is not a
