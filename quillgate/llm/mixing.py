"""A mix in which each source makes up its target share of the total size.

Poisson replication: a document's number of copies is a Poisson number with its source's rate, got by
inverting the distribution at a uniform number hashed from the seed and the document, and cut at the
most repeats allowed. With the uniform number fixed, copies only grow with the rate, so each document
has breakpoints: the rate from which it has a first, second ... copy. A histogram of breakpoints,
weighted by size, tells for each source the rate at which its share is met; a source too small even
with every repeat falls short and is used in full. With the rates known, a document's number of copies
is that of the distribution's values (one for each repeat allowed) its uniform number has reached. The
copies are exploded and put in an order hashed from the seed, over all partitions.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quillgate.workspace import materialize

GRID, SPAN = 16384, 12
#: Sources a mix may have; more are refused. Their targets are sent to every task.
MOST_SOURCES = 100_000


@dataclass(frozen=True)
class SourcePlan:
    source: str
    target_weight: float
    max_repeat: int
    available: int
    wanted: float
    rate: float
    short: bool


def breakpoints(u: np.ndarray, most: int) -> np.ndarray:
    """Column k-1: the Poisson rate at which the inverse of the distribution at ``u`` reaches k.

    That is the rate r with P(N < k) = 1 - u ... solved for all rows at once by bisection; P(N < k)
    falls as r grows.
    """
    out = np.empty((len(u), most))
    for k in range(1, most + 1):
        low, high = np.zeros(len(u)), np.full(len(u), k + 60.0 + 12 * math.sqrt(k))
        for _ in range(48):
            mid = (low + high) / 2
            term = below = np.exp(-mid)
            for j in range(1, k):
                term = term * mid / j
                below = below + term
            above = below <= u
            high = np.where(above, mid, high)
            low = np.where(above, low, mid)
        out[:, k - 1] = high
    return out


def _uniform(*on: str, seed: int) -> Column:
    """In (0, 1), the same for the same values and seed."""
    return (F.pmod(F.xxhash64(F.lit(seed), *[F.col(c) for c in on]), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))


def _with_breaks(sized: DataFrame, repeats: dict[str, int], seed: int) -> DataFrame:
    with_u = sized.withColumn("_u", _uniform("doc_id", seed=seed))
    schema = T.StructType([*sized.schema.fields, T.StructField("breaks", T.ArrayType(T.DoubleType()))])
    names = sized.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            most = np.array([repeats[s] for s in batch.column("source").to_pylist()], np.int64)
            table = np.full((batch.num_rows, max(repeats.values(), default=0)), np.inf)
            for m in np.unique(most):
                rows = most == m
                table[rows, :m] = breakpoints(batch.column("_u").to_numpy()[rows], m)
            flat = table[np.arange(table.shape[1])[None, :] < most[:, None]]
            offsets = pa.array(np.concatenate([[0], np.cumsum(most)]), pa.int32())
            lists = pa.ListArray.from_arrays(offsets, pa.array(flat))
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], lists], names=[*names, "breaks"])

    return with_u.mapInArrow(run, schema)


def _plan(broken: DataFrame, targets: dict[str, tuple[float, int]], known: DataFrame) -> list[SourcePlan]:
    """The histogram stays with the executors; a size and a slot a source reach the driver."""
    slot = F.least(F.lit(GRID - 1), F.floor(F.log1p("_rate") * (GRID / SPAN))).cast("int")
    spread = broken.select("source", "n_tokens", F.posexplode_outer("breaks").alias("_copy", "_rate"))
    size_if_drawn = F.when(F.col("_rate").isNotNull(), F.col("n_tokens")).otherwise(0)
    size_once = F.when(F.coalesce("_copy", F.lit(0)) == 0, F.col("n_tokens")).otherwise(0)
    slot = F.coalesce(slot, F.lit(0))
    slots = materialize(spread.groupBy("source", slot.alias("slot")).agg(F.sum(size_if_drawn).alias("size"), F.sum(size_once).alias("once")), "mix-histogram")
    sizes = {r["source"]: r for r in slots.groupBy("source").agg(F.sum("once").alias("once"), F.sum("size").alias("all")).toLocalIterator()}
    total = sum(r["once"] for r in sizes.values())
    by_slot = Window.partitionBy("source").orderBy("slot")
    reach = slots.withColumn("reach", F.sum("size").over(by_slot)).join(F.broadcast(known), "source").withColumn("wanted", F.col("weight") * F.lit(float(total)))
    at = {r["source"]: r for r in reach.filter("reach >= wanted and reach - size < wanted").toLocalIterator()}
    out = []
    for s, (weight, most) in targets.items():
        wanted = weight * total
        short = (sizes[s]["all"] if s in sizes else 0) < wanted
        if short:
            rate = math.inf
        elif wanted <= 0:
            rate = -1.0
        else:
            r = at[s]
            inner = r["slot"] + (wanted - (r["reach"] - r["size"])) / max(r["size"], 1.0)
            rate = math.expm1(inner * SPAN / GRID)
        out.append(SourcePlan(s, weight, most, int(sizes[s]["once"]) if s in sizes else 0, wanted, rate, short))
    return out


def steps_at(rate: float, most: int) -> list[float]:
    """P(N < k) for k = 1 to ``most``: a uniform number that has reached it is drawn k times."""
    if rate < 0:
        return []
    if math.isinf(rate):
        return [0.0] * most
    out, term, below = [], math.exp(-rate), 0.0
    for k in range(most):
        below += term
        out.append(below)
        term *= rate / (k + 1)
    return out


@dataclass(frozen=True)
class Mix:
    plan: list[SourcePlan]
    copies: DataFrame

    def shortfalls(self) -> list[SourcePlan]:
        return [p for p in self.plan if p.short]


def mix_sources(
    documents: DataFrame, *, doc_id: Column, source: Column, size: Column, targets: dict[str, tuple[float, int]], seed: int = 17
) -> Mix:
    """The mix and its plan. ``targets`` maps each source to its weight and its most repeats.

    The mix size is the size of all documents whose source (already in the spelling of ``targets``) is
    a target; documents of no target, or of null or no size, are left out. ``copies`` has a row for each
    copy: ``doc_id, source, n_tokens, copy, position`` in the order of ``position`` within each
    partition and with partitions of their own positions: a hashed order that no source, document or
    input order shows through. Rows that repeat an identifier are documents of their own that are drawn
    alike. Other columns are not read, whatever their names; an empty table gives an empty mix in which
    no source falls short.
    """
    for s, (weight, most) in targets.items():
        if weight < 0 or most < 0:
            raise ValueError(f"weight and repeats of {s} must not be negative")
    if len(targets) > MOST_SOURCES:
        raise ValueError(f"a mix has at most {MOST_SOURCES} sources")
    spark = documents.sparkSession
    most = {s: m for s, (_, m) in targets.items()}
    known = spark.createDataFrame([(s, float(w)) for s, (w, _) in targets.items()], "source string, weight double")
    sized = documents.select(doc_id.alias("doc_id"), source.alias("source"), size.cast("bigint").alias("n_tokens"))
    usable = sized.filter("n_tokens > 0").join(F.broadcast(known.select("source")), "source").select("doc_id", "source", "n_tokens")
    plan = _plan(_with_breaks(usable, most, seed), targets, known)
    steps = spark.createDataFrame([(p.source, steps_at(p.rate, p.max_repeat)) for p in plan], "source string, steps array<double>")
    drawn = usable.withColumn("_u", _uniform("doc_id", seed=seed)).join(F.broadcast(steps), "source")
    chosen = drawn.withColumn("_n", F.size(F.filter("steps", lambda b: b <= F.col("_u")))).filter("_n > 0")
    copies = chosen.select("doc_id", "source", "n_tokens", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("copy"))
    copies = copies.withColumn("position", F.xxhash64(F.lit(seed + 1), "doc_id", "copy"))
    return Mix(plan, copies.repartition("position").sortWithinPartitions("position", "doc_id", "copy"))


def shares(mix: Mix) -> DataFrame:
    """One row a source: what was wanted, what is in the mix, the most often any document is used.

    ``short`` is told from the copies themselves: every document is used as often as allowed, and still
    the mix has less of the source than wanted.
    """
    spark = mix.copies.sparkSession
    plan = spark.createDataFrame(
        [(p.source, float(p.target_weight), p.max_repeat, p.available, float(p.wanted)) for p in mix.plan],
        "source string, target_weight double, max_repeat int, available_tokens bigint, wanted_tokens double",
    )
    got = mix.copies.groupBy("source").agg(F.sum("n_tokens").alias("mix_tokens"), F.count("*").alias("copies"), F.max("copy").alias("most_used"))
    size = sum(p.available for p in mix.plan)
    return plan.join(F.broadcast(got), "source", "left").select(
        *plan.columns,
        ((F.coalesce("mix_tokens", F.lit(0)) == F.col("available_tokens") * F.col("max_repeat")) & (F.coalesce("mix_tokens", F.lit(0)) < F.col("wanted_tokens"))).alias("short"),
        F.coalesce("mix_tokens", F.lit(0)).alias("mix_tokens"),
        F.coalesce("copies", F.lit(0)).alias("copies"),
        F.coalesce("most_used", F.lit(0)).alias("most_used"),
        (F.coalesce("mix_tokens", F.lit(0)) / F.lit(float(max(size, 1)))).alias("actual_share"),
    )
