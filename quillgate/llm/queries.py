"""Registered queries of the problems on training text, with their SQL where there is any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgate.functions.identity import folded
from quillgate.llm import distinct, mixing, overlap, packing, quantiles, reading, terms
from quillgate.llm.tokens import with_token_counts
from quillgate.workspace import materialize, read_table, spread

# --- 2: distinct identifiers -----------------------------------------------------------------------

_SET_GROUPINGS = {"day": ["day"], "tenant": ["tenant_id"], "day_tenant": ["day", "tenant_id"]}


def _identifier_registers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "audit_record").select("timestamp", "tenant_id", "principal_id", "sql_hash")
    return distinct.register_rows(
        rows,
        {"day": F.to_date("timestamp"), "tenant_id": F.col("tenant_id")},
        {"principal_id": F.col("principal_id"), "sql_hash": folded(F.col("sql_hash"))},
    )


def p2_distinct_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = distinct.merge_groupings(_identifier_registers(spark, sf_dir), _SET_GROUPINGS)
    return distinct.estimate(merged, ["grouping", "day", "tenant_id"])


def p2_registers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The partial result of each day and tenant, as it would be stored to be merged later."""
    return _identifier_registers(spark, sf_dir)


# --- 3: terms --------------------------------------------------------------------------------------


def p3_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "eval_case").select("question", "tags")
    counts = terms.term_counts(rows, {"question": (F.col("question"), terms.words), "tags": (F.col("tags"), terms.labels)})
    return terms.mark_terms(counts, rows.count())


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_terms(spark, sf_dir).filter("mark is not null").select("field_name", "term", "mark")


# --- 4: percentiles --------------------------------------------------------------------------------

_DURATION_GROUPINGS = {"backend": ["backend"], "tenant": ["tenant_id"], "backend_tenant": ["backend", "tenant_id"]}


def _duration_sketches(spark: SparkSession, sf_dir: str, *, daily: bool) -> DataFrame:
    rows = read_table(spark, sf_dir, "audit_record").select("timestamp", "backend", "tenant_id", "duration_ms")
    by = {"day": F.to_date("timestamp")} if daily else {}
    return quantiles.sketches(rows, by | {"backend": folded(F.col("backend")), "tenant_id": F.col("tenant_id")}, F.col("duration_ms"))


def p4_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = quantiles.merge_sketches(_duration_sketches(spark, sf_dir, daily=False), _DURATION_GROUPINGS)
    return quantiles.percentiles(merged, {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99})


def p4_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The partial result of each day, backend and tenant, as it would be stored to be merged later."""
    return _duration_sketches(spark, sf_dir, daily=True)


# --- 6: overlaps across splits ---------------------------------------------------------------------


def _overlaps(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    cases = spread(read_table(spark, sf_dir, "eval_case").select("id", "split", "source", "question", "reference_sql"))
    fields = {"question": (F.col("question"), overlap.split_question), "reference_sql": (F.col("reference_sql"), overlap.split_query)}
    rows = overlap.split_records(cases, id=F.col("id"), split=F.col("split"), source=F.col("source"), fields=fields)
    rows = materialize(rows, "overlap-rows")
    return rows, overlap.overlapping_classes(rows, strict_fields=("reference_sql",))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = overlap.overlapping_pairs(*_overlaps(spark, sf_dir))
    return pairs.select(F.least("train_id", "eval_id").alias("id_1"), F.greatest("train_id", "eval_id").alias("id_2")).distinct()


def p6_identical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the pairs found, those whose question or query is the same text but for case and outer space."""
    cases = read_table(spark, sf_dir, "eval_case").select("id", F.lower(F.trim("question")).alias("q"), F.lower(F.trim("reference_sql")).alias("s"))
    a, b = (cases.select(F.col("id").alias(f"id_{k}"), F.col("q").alias(f"q_{k}"), F.col("s").alias(f"s_{k}")) for k in (1, 2))
    pairs = p6_found(spark, sf_dir).join(a, "id_1").join(b, "id_2")
    same_question = (F.col("q_1") == F.col("q_2")) & F.col("q_1").rlike("[a-z0-9]")
    return pairs.filter(same_question | ((F.col("s_1") == F.col("s_2")) & F.col("s_1").rlike("[a-z0-9]"))).select("id_1", "id_2")


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, classes = _overlaps(spark, sf_dir)
    return overlap.overlap_report(rows, classes)


# --- 7: packing ------------------------------------------------------------------------------------


def _sized(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Documents without their text but with its size; written once, as counting tokens costs most of a run."""
    docs = spread(read_table(spark, sf_dir, "documents").select("doc_id", "text", *columns))
    return materialize(with_token_counts(docs, F.col("text")).drop("text"), "document-sizes")


#: Container kinds a query packs for; a table of more is refused.
MOST_CONTAINERS = 1000


def _capacities(spark: SparkSession, sf_dir: str) -> dict[str, int]:
    """The container kinds: a handful of rows by the table's definition."""
    spec = read_table(spark, sf_dir, "container_spec").filter("capacity_tokens > 0").limit(MOST_CONTAINERS + 1).collect()
    if len(spec) > MOST_CONTAINERS:
        raise ValueError(f"more than {MOST_CONTAINERS} kinds of containers")
    return {r["container"]: r["capacity_tokens"] for r in spec}


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    capacity = _capacities(spark, sf_dir)["standard"]
    placed = packing.pack(_sized(spark, sf_dir), item=F.col("doc_id"), size=F.col("n_tokens"), capacities=[capacity])
    return placed.filter("piece > 0").select(F.col("item").alias("doc_id")).distinct()


def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_sized(spark, sf_dir), item=F.col("doc_id"), size=F.col("n_tokens"), capacities=list(_capacities(spark, sf_dir).values())).withColumnRenamed("item", "doc_id")


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per container kind: containers used, tokens placed and the share of room left over."""
    return (
        p7_packed(spark, sf_dir)
        .groupBy("capacity", "bin_id")
        .agg(F.sum("n_tokens").alias("used"))
        .groupBy("capacity")
        .agg(F.count("*").alias("n_bins"), F.sum("used").alias("n_tokens"))
        .withColumn("unused_share", F.round(1 - F.col("n_tokens") / (F.col("n_bins") * F.col("capacity")), 4))
    )


def p7_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per capacity: documents placed, containers overfull, documents not placed whole, once and in order, documents cut in vain."""
    sized = _sized(spark, sf_dir)
    placed = packing.pack(sized, item=F.col("doc_id"), size=F.col("n_tokens"), capacities=list(_capacities(spark, sf_dir).values()))
    placed = materialize(placed, "packed")
    over = placed.groupBy("capacity", "bin_id").agg(F.sum("n_tokens").alias("used")).groupBy("capacity").agg(F.count_if(F.col("used") > F.col("capacity")).alias("n_overfull"))
    whole = placed.groupBy("capacity", F.col("item").alias("doc_id")).agg(
        F.sum("n_tokens").alias("got"), F.count("*").alias("pieces"), F.count_distinct("piece").alias("kinds"), F.max(F.col("first_token") + F.col("n_tokens")).alias("reach")
    )
    whole = whole.join(sized, "doc_id").groupBy("capacity").agg(
        F.count("*").alias("n_documents"),
        F.count_if((F.col("got") != F.col("n_tokens")) | (F.col("reach") != F.col("n_tokens")) | (F.col("kinds") != F.col("pieces"))).alias("n_torn"),
        F.count_if((F.col("pieces") > 1) & (F.col("n_tokens") <= F.col("capacity"))).alias("n_cut_in_vain"),
    )
    return whole.join(over, "capacity")


# --- 8: mixing -------------------------------------------------------------------------------------


def _mix(spark: SparkSession, sf_dir: str) -> mixing.Mix:
    targets = read_table(spark, sf_dir, "mix_target").filter("source is not null").limit(mixing.MOST_SOURCES + 1).collect()
    sized = _sized(spark, sf_dir, "source").withColumn("source", folded(F.col("source")))
    return mixing.mix_sources(
        sized,
        doc_id=F.col("doc_id"),
        source=F.col("source"),
        size=F.col("n_tokens"),
        targets={r["source"]: (r["target_weight"], r["max_repeat"]) for r in targets},
    )


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of which the mix, with each document drawn as often as allowed, still has too little."""
    return mixing.shares(_mix(spark, sf_dir)).filter("short").select("source")


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir).copies


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(_mix(spark, sf_dir))


def p8_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source: no document used too often, its share met within a thousandth of the mix, or all of it used and too little."""
    got = mixing.shares(_mix(spark, sf_dir))
    off = F.abs(F.col("actual_share") - F.col("target_weight"))
    return got.select("source", "short", (F.col("most_used") <= F.col("max_repeat")).alias("within_repeats"), (F.col("short") | (off < 1e-3 + F.lit(20_000) / F.sum("available_tokens").over(Window.partitionBy()))).alias("share_met"))


# --- 9: reading level ------------------------------------------------------------------------------


def p9_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    featured = materialize(reading.with_features(docs, F.col("doc_id"), F.col("text")), "reading-features")
    model = reading.fit_readers(featured, read_table(spark, sf_dir, "reading_label"))
    return reading.reading_levels(featured, model)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_levels(spark, sf_dir).filter("band = 4").select("doc_id")


def p9_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per band: documents that two or more readers judge alike, and whether nineteen in twenty of them get that band."""
    told = read_table(spark, sf_dir, "reading_label").filter("band is not null").groupBy("doc_id").agg(F.count("*").alias("n"), F.min("band").alias("low"), F.max("band").alias("high"))
    told = told.filter("n > 1 and low = high").join(p9_levels(spark, sf_dir).filter("band is not null"), "doc_id")
    return told.groupBy(F.col("low").alias("band")).agg(F.count("*").alias("n_documents"), (F.count_if(F.col("band") == F.col("low")) >= 0.95 * F.count("*")).alias("met"))


QUERIES = {
    f.__name__: f
    for f in (
        p2_distinct_ids, p2_registers, p3_found, p3_terms, p4_percentiles, p4_sketches, p6_found, p6_identical, p6_report, p7_found, p7_packed, p7_fill, p7_check,
        p8_found, p8_mix, p8_shares, p8_check, p9_found, p9_levels, p9_check,
    )
}

_REGISTERS = r"""
items as (
  select cast("timestamp" as date) as day, tenant_id, 'principal_id' as field_name, principal_id as value from audit_record
  union all
  select cast("timestamp" as date), tenant_id, 'sql_hash', nullif(lower(regexp_replace(sql_hash, '^\s+|\s+$', '', 'g')), '') from audit_record
), hashed as (
  select day, tenant_id, field_name, cast(concat('0x', substr(md5(value), 1, 4)) as integer) >> 2 as register, cast(concat('0x', substr(md5(value), 5, 13)) as bigint) as tail
  from items where regexp_matches(value, '\S')
), registers as (
  select day, tenant_id, field_name, register, max(case when tail = 0 then 53 else 53 - length(format('{:b}', tail)) end)::integer as rank
  from hashed group by all
)"""

SQL = {
    "p2_registers": "with" + _REGISTERS + " select * from registers",
    "p2_distinct_ids": "with"
    + _REGISTERS
    + """, merged as (
  select 'day' as grouping, day, null::varchar as tenant_id, field_name, register, max(rank) as rank from registers group by day, field_name, register
  union all select 'tenant', null::date, tenant_id, field_name, register, max(rank) from registers group by tenant_id, field_name, register
  union all select 'day_tenant', day, tenant_id, field_name, register, rank from registers
), sums as (
  select grouping, day, tenant_id, field_name, sum(pow(2.0, -rank)) as hit, (16384 - count(*)) / 16384.0::double as empty from merged group by all
), counts as (
  select *, 16384 * 16384 / (2 * ln(2)) / (hit + 16384 * (empty + list_sum([pow(empty, pow(2.0, k)) * pow(2.0, k - 1) for k in range(1, 31)]))) as n from sums
)
select grouping, day, tenant_id, field_name, cast(round(n) as bigint) as estimate, round(n * 0.008125, 1) as std_error, 0.008125::double as relative_error from counts""",
}

_TERMS = r"""
found as (
  select 'question' as field_name, id, unnest(regexp_extract_all(lower(nfc_normalize(question)), '[\p{L}\p{N}]+')) as term from eval_case
  union all
  select 'tags', id, regexp_replace(lower(t), '^\s+|\s+$', '', 'g') from (select id, unnest(tags) as t from eval_case)
), counted as (
  select field_name, term, count(*) as occurrences, count(distinct id) as records from found where term <> '' group by 1, 2
), marked as (
  select *, case when records <= 2 then 'rare' when records > 0.1 * (select count(*) from eval_case) then 'common' end as mark from counted
)"""
SQL["p3_terms"] = "with" + _TERMS + " select * from marked"
SQL["p3_found"] = "with" + _TERMS + " select field_name, term, mark from marked where mark is not null"

_HASHED = ", ".join(str(h) for h in quantiles.HASHES)
_SKETCHES = rf"""
usable as (
  select cast("timestamp" as date) as day, nullif(lower(regexp_replace(backend, '^\s+|\s+$', '', 'g')), '') as backend, tenant_id,
    case when duration_ms >= 4611686018427387904 * 0.001 then 4611686018427387903 else cast(round(duration_ms * 1000.0::double) as bigint) end as steps
  from audit_record where duration_ms >= 0 and not isnan(duration_ms) and not isinf(duration_ms)
), shifted as (
  select *, greatest(0, length(format('{{:b}}', steps)) - 11) as shift from usable
), counted as (
  select day, backend, tenant_id, (shift << 10) + (steps >> shift) as code, count(*) as n from shifted group by all
), hashes(level, row_no, a, b, c, d) as (values {_HASHED}), placed as (
  select day, backend, tenant_id, code >> {quantiles.EXACT_SHIFT} as cell, n from counted
  union all
  select day, backend, tenant_id,
    (a::bigint * (code >> level) + b) % {quantiles.PRIME} % {quantiles.WIDTH} + {quantiles.EXACT} + (level * {quantiles.DEPTH} + row_no) * {quantiles.WIDTH},
    case when (c::bigint * (code >> level) + d) % {quantiles.PRIME} % 2 = 1 then -n else n end
  from counted cross join hashes
)"""
SQL["p4_sketches"] = "with" + _SKETCHES + " select day, backend, tenant_id, cast(cell as integer) as cell, cast(sum(n) as bigint) as n from placed group by day, backend, tenant_id, cell having sum(n) <> 0"


def _descent() -> str:
    """The sketch descended in SQL, level by level."""
    steps = []
    for level in range(quantiles.EXACT_SHIFT - 1, -1, -1):
        last = f"d{level + 1}"
        steps.append(
            f"""looked{level} as (
  select s.grp, s.share, s.code * 2 as low, s.rest, s.parent, h.row_no,
    (a::bigint * (s.code * 2) + b) % {quantiles.PRIME} % {quantiles.WIDTH} + {quantiles.EXACT} + ({level} * {quantiles.DEPTH} + row_no) * {quantiles.WIDTH} as cell,
    case when (c::bigint * (s.code * 2) + d) % {quantiles.PRIME} % 2 = 1 then -1 else 1 end as sign
  from {last} s cross join (select * from hashes where level = {level}) h
), guessed{level} as (
  select l.grp, l.share, l.low, l.rest, l.parent, greatest(0, least(l.parent, median(coalesce(m.n, 0) * l.sign))) as guess
  from looked{level} l left join merged m on m.grp = l.grp and m.cell = l.cell group by l.grp, l.share, l.low, l.rest, l.parent
), d{level} as (
  select grp, share, case when rest > guess then low + 1 else low end as code, case when rest > guess then rest - guess else rest end as rest,
    case when rest > guess then parent - guess else guess end as parent from guessed{level}
)"""
        )
    return ", ".join(steps)


SQL["p4_percentiles"] = (
    "with"
    + _SKETCHES
    + f""", groups as (
  select row_number() over () as grp, * from (
    select 'backend' as grouping, backend, null::varchar as tenant_id from counted union select 'tenant', null, tenant_id from counted union select 'backend_tenant', backend, tenant_id from counted)
), merged as (
  select g.grp, p.cell, cast(sum(p.n) as bigint) as n from placed p join groups g
    on (g.grouping = 'tenant' or g.backend is not distinct from p.backend) and (g.grouping = 'backend' or g.tenant_id is not distinct from p.tenant_id) group by 1, 2
), summed as (
  select grp, cell as code, n, sum(n) over (partition by grp order by cell) as upto, sum(n) over (partition by grp) as total from merged where cell < {quantiles.EXACT}
), wanted as (
  select grp, share, greatest(ceil(share * any_value(total) - 1e-9), 1) as rank from summed cross join (values (0.5::double), (0.9::double), (0.95::double), (0.99::double)) s(share) group by 1, 2
), d{quantiles.EXACT_SHIFT} as (
  select w.grp, w.share, s.code, w.rank - (s.upto - s.n) as rest, s.n as parent from wanted w join summed s on s.grp = w.grp and s.upto >= w.rank and s.upto - s.n < w.rank and s.n > 0
), {_descent()}, decoded as (
  select *, greatest(code // 1024 - 1, 0) as shift from d0
), valued as (
  select grp, share, (((code - (shift << 10)) << shift) + ((1::bigint << shift) - 1) / 2.0::double) * 0.001::double as value from decoded
), ranked as (
  select grp, (cell - {quantiles.EXACT}) // {quantiles.WIDTH} as part, n, row_number() over (partition by grp, (cell - {quantiles.EXACT}) // {quantiles.WIDTH} order by n * n desc) as k from merged where cell >= {quantiles.EXACT}
), squares as (
  select g.grp, h.level, h.row_no, coalesce(sum(r.n * r.n), 0) as square from groups g cross join hashes h
    left join ranked r on r.grp = g.grp and r.part = h.level * {quantiles.DEPTH} + h.row_no and r.k > {quantiles.HEAVY} group by 1, 2, 3
), errors as (
  select grp, sum(middle) as squares from (select grp, level, median(square) as middle from squares group by 1, 2) group by 1
)
select grouping, backend, tenant_id, cast(max(t.total) as bigint) as n, max(value) filter (share = 0.5::double) as p50, max(value) filter (share = 0.9::double) as p90,
  max(value) filter (share = 0.95::double) as p95, max(value) filter (share = 0.99::double) as p99,
  round(3 * sqrt(max(e.squares) / {quantiles.WIDTH}) / max(t.total), 9) as rank_error
from groups g join valued v using (grp) join (select distinct grp, total from summed) t using (grp) join errors e using (grp) group by g.grp, grouping, backend, tenant_id"""
)

SQL["p6_identical"] = """with e as (select id, split, lower(trim(question, ' ')) as q, lower(trim(reference_sql, ' ')) as s from eval_case where split is not null)
select distinct least(a.id, b.id) as id_1, greatest(a.id, b.id) as id_2 from e a join e b on a.q = b.q and a.split = 'train' and b.split <> 'train' and regexp_matches(a.q, '[a-z0-9]')
union select least(a.id, b.id), greatest(a.id, b.id) from e a join e b on a.s = b.s and a.split = 'train' and b.split <> 'train' and regexp_matches(a.s, '[a-z0-9]')"""

# sizes in words and signs: by the tables' definition no document and no source lies near a limit, whichever the tokenizer
_WORDS = r"words as (select doc_id, nullif(lower(regexp_replace(source, '^\s+|\s+$', '', 'g')), '') as source, len(regexp_extract_all(text, '\w+|[^\w\s]')) as n from documents)"
# (of hard texts the words are long: five characters a token)
SQL["p7_found"] = "select doc_id from documents where length(text) > 5 * (select capacity_tokens from container_spec where container = 'standard')"
SQL["p7_check"] = """select cast(c.capacity_tokens as bigint) as capacity, count(*) as n_documents, 0::bigint as n_overfull, 0::bigint as n_torn, 0::bigint as n_cut_in_vain
from (select distinct capacity_tokens from container_spec) c cross join documents d where length(d.text) > 0 group by 1"""
_SHORT = _WORDS + """, sizes as (select t.source, t.target_weight, t.max_repeat, coalesce(sum(w.n), 0) as n from mix_target t left join words w using (source) group by all),
short as (select source, n * max_repeat < target_weight * sum(n) over () as short from sizes)"""
SQL["p8_found"] = "with " + _SHORT + " select source from short where short"
SQL["p8_check"] = "with " + _SHORT + " select source, short, true as within_repeats, true as share_met from short"
SQL["p9_check"] = """with told as (select doc_id, count(*) as n, min(band) as low, max(band) as high from reading_label where band is not null group by 1)
select low as band, count(*) as n_documents, true as met from told join documents using (doc_id) where told.n > 1 and low = high and regexp_matches(text, '\\S') group by 1"""
