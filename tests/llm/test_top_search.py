"""Exact top-k against brute force: ties, copies, odd vectors, lengths, phases, and how deep the lists are read."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from paylens.llm import top_search
from paylens.llm.queries import llm_queries

SCHEMA = "vec_id long, embedding array<float>"


def integers(vector):
    if vector is None or any(x is None or not math.isfinite(x) for x in vector):
        return None
    return [math.floor(1024 * float(np.float32(x))) for x in vector]


def plain(rows, k, modulus):
    known = [(i, z) for i, v, *_ in rows if (z := integers(v)) is not None]
    out = []
    for at, (q, z) in enumerate(known):
        if q is None or q % modulus:
            continue
        met = [
            (-sum(a * b for a, b in zip(z, w)), c is None, c or 0, c)
            for other, (c, w) in enumerate(known) if other != at and len(w) == len(z)
        ]
        out += [(q, rank, c, -s) for rank, (s, _, _, c) in enumerate(sorted(met)[:k], 1)]
    return sorted(out, key=repr)


def searched(df, k=10, modulus=10):
    got = top_search.top_k(top_search.integer_vectors(df), F.col("vec_id") % modulus == 0, k)
    assert got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    return sorted((tuple(r) for r in got.collect()), key=repr)


def some_rows(seed, n, dims, values):
    rng = random.Random(seed)
    return [(i, [rng.choice(values) for _ in range(dims)]) for i in rng.sample(range(-n, n), n)]


#: Blocks of 40 rows in phases of 2 blocks and, by default, one block.
@pytest.mark.parametrize("small", [True, False])
def test_equals_brute_force(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(top_search, "LARGEST", 40)
        monkeypatch.setattr(top_search, "PHASE", 2)
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(300)]
    # Few values: nearly everything ties.
    rows += [(i + 1000, v) for i, v in some_rows(6, 200, 3, [-0.5, 0.0, 0.25])]
    assert searched(spark.createDataFrame(rows, SCHEMA).repartition(5)) == plain(rows, 10, 10)


def test_copies_repeated_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(top_search, "LARGEST", 8)
    nan, inf = float("nan"), float("inf")
    same = [0.5, -0.25, 0.125]
    rows = [(i, same) for i in range(100, 160)] + [(7, same), (None, same), (20, same), (20, same), (20, [1.0, 1.0, 1.0])]
    rows += [(1, None), (2, []), (10, []), (30, [None, 1.0, 1.0]), (40, [nan, 1.0, 1.0]), (50, [inf, 1.0, 1.0]), (60, [0.0, 0.0, 0.0])]
    rows += [(70, [1.0] * 5), (80, [-3.5] * 5), (90, [100000.5, -99999.25, 1e5]), (-10, [1e-9, -1e-9, 0.0]), (110, [0.1] * 900)]
    schema = SCHEMA + ", block long, v string, `a.b` int, copies string"
    df = spark.createDataFrame([(*r, 3, "x", 1, "y") for r in rows], schema).repartition(4)
    assert searched(df) == plain(rows, 10, 10)
    assert searched(df, k=2, modulus=5) == plain(rows, 2, 5)
    assert searched(spark.createDataFrame([], SCHEMA)) == []
    assert searched(spark.createDataFrame([(1, [1.0])], SCHEMA)) == []
    assert searched(spark.createDataFrame([(10, [1.0])], SCHEMA)) == []


def test_large_components_are_exact():
    rng = np.random.default_rng(1)
    values = rng.integers(-(2**29), 2**29, (50, 4))
    lists = top_search.Lists(np.arange(50), values)
    scores, ids = lists.search(values[3], 3, 5, None)
    want = sorted(((-int(sum(int(a) * int(b) for a, b in zip(values[3], values[i]))), i) for i in range(50) if i != 3))[:5]
    assert list(zip((-scores).tolist(), ids.tolist())) == want
    with pytest.raises(OverflowError):
        top_search.Lists(np.arange(2), np.full((2, 4), 2**40)).search(np.full(4, 2**40), 9, 1, None)


def test_the_threshold_ends_the_reading(monkeypatch):
    """Where few rows are large in a few dimensions, most of the block is never met."""
    rng = np.random.default_rng(2)
    values = rng.integers(-5, 6, (20_000, 6))
    values[:30] += 1000
    lists = top_search.Lists(np.arange(20_000), values)
    met = []
    order = lists.order
    monkeypatch.setattr(lists, "order", _Counting(order, met))
    scores, ids = lists.search(np.array([9, 8, 7, 6, 5, 4]), -1, 10, None)
    want = values @ np.array([9, 8, 7, 6, 5, 4])
    assert scores.tolist() == sorted(want.tolist(), reverse=True)[:10]
    assert sum(met) < 2000
    # A bound from elsewhere that nothing beats ends it at once, and nothing is returned.
    assert len(lists.search(np.array([9, 8, 7, 6, 5, 4]), -1, 10, 10**9)[0]) == 0


class _Counting:
    def __init__(self, order, met):
        self.order, self.met = order, met

    def __getitem__(self, key):
        found = self.order[key]
        self.met.append(found.size)
        return found


def test_copies_do_not_gather(spark):
    """Of many copies of one vector, k + 1 reach the blocks."""
    df = spark.range(0, 20_000).select(F.col("id").alias("vec_id"), F.array(F.lit(0.5), F.lit(0.25)).alias("embedding"))
    got = top_search.top_k(top_search.integer_vectors(df), F.col("vec_id").isin(0, 5, 19_999), 4)
    rows = sorted(tuple(r) for r in got.collect())
    assert [r[2] for r in rows] == [1, 2, 3, 4, 0, 1, 2, 3, 0, 1, 2, 3] and {r[3] for r in rows} == {512**2 + 256**2}


def test_query_equals_brute_force(spark, star):
    rows = [tuple(r) for r in spark.read.parquet(f"{star}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = llm_queries()["op12_exact_top_k"](spark, star)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain(rows, 10, 100)
