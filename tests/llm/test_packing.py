import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgate.llm.packing import UNITS, fit_counts, pack, pack_lengths, patterns


def test_patterns_fill_a_container_exactly():
    m = patterns()
    sizes = np.arange(1, UNITS + 1)
    assert (sizes @ m == UNITS).all() and (m.sum(0) <= 4).all()
    assert len({tuple(c) for c in m.T.tolist()}) == m.shape[1]


def test_fit_finds_nonnegative_counts():
    m = patterns(12, 3)
    x = np.zeros(m.shape[1])
    x[[1, 4, 7]] = [30, 5, 12]
    found = fit_counts(m @ x, m, 3000)
    assert (found >= 0).all() and np.abs(m @ found - m @ x).max() < 0.5


@pytest.mark.parametrize("seed", range(4))
def test_no_container_overflows_and_little_is_wasted(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.choice([100, 512, 2048]))
    lengths = np.clip(rng.lognormal(np.log(capacity / 5), 0.9, 4000).astype(int), 1, capacity)
    where = pack_lengths(lengths, capacity)
    used = np.bincount(where, lengths)
    assert where.min() == 0 and used.max() <= capacity and (used > 0).all()
    floor = max(int(np.ceil(lengths.sum() / capacity)), int((lengths * 2 > capacity).sum()))
    assert len(used) <= floor * 1.03 + 2


def test_every_piece_is_placed_once(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([None, 0, 1, 5, 99, 100, 101, 250, 300, 12_345]), "x", 3) for i in range(600)] + [(1, 250, "x", 3), (1, 250, "x", 3), (-5, 700, "x", 3)]
    df = spark.createDataFrame(rows, "k bigint, n bigint, item string, capacity int")
    got = pack(df, item=F.col("k"), size=F.col("n"), capacities=[100, 1000], shard_items=100).collect()
    for capacity in (100, 1000):
        mine = [r for r in got if r.capacity == capacity]
        bins, pieces = {}, {}
        for r in mine:
            bins[r.bin_id] = bins.get(r.bin_id, 0) + r.n_tokens
            pieces.setdefault(r.item, []).append(r)
            assert 0 < r.n_tokens <= capacity and r.first_token == r.piece * capacity
        assert max(bins.values()) <= capacity
        want = {}
        for k, n, *_ in rows:
            if n:
                want.setdefault(k, []).append(n)
        assert {k: sum(p.n_tokens for p in v) for k, v in pieces.items()} == {k: sum(v) for k, v in want.items()}
        assert {k: len(v) for k, v in pieces.items()} == {k: sum(-(-n // capacity) for n in v) for k, v in want.items()}
    assert pack(df.limit(0), item=F.col("k"), size=F.col("n"), capacities=[100]).count() == 0
    with pytest.raises(ValueError):
        pack(df, item=F.col("k"), size=F.col("n"), capacities=[0])


def test_one_row_very_many_times(spark):
    df = spark.range(5000).select(F.lit(7).alias("k"), F.lit(250).alias("n"))
    got = pack(df, item=F.col("k"), size=F.col("n"), capacities=[100], shard_items=500).collect()
    bins = {}
    for r in got:
        bins.setdefault(r.bin_id, []).append(r.n_tokens)
    assert len(got) == 15_000 and sum(len(b) == 1 and b[0] == 100 for b in bins.values()) == 10_000
    assert all(sum(b) <= 100 for b in bins.values())
