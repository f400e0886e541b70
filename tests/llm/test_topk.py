"""op9: exact search against brute force."""

import math

import numpy as np

from terrapatch.llm import queries, topk

from .conftest import SF


def brute(rows, k=10, every=100):
    vectors = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            vectors.append((i, [math.floor(1024 * float(x)) for x in v]))
    asked = {}
    for i, v in vectors:
        if i % every == 0:
            asked[i] = min(asked.get(i, v), v)
    out = []
    for q, v in asked.items():
        scores = [(-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in vectors if i != q and len(w) == len(v)]
        out += [(q, n, i, -s) for n, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def test_whole_table(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    assert sorted(map(tuple, queries.op9_topk(spark, SF).collect())) == brute(rows)


KIND = "vec_id long, embedding array<float>, query_id long, score string"


def test_odd_rows(spark):
    r = np.random.default_rng(2)
    rows = [(i, [float(x) for x in r.integers(-3, 4, 4) / 4]) for i in range(60)]
    rows += [(None, [1.0, 1.0, 1.0, 1.0]), (100, None), (200, [1.0, None, 0.0, 0.0]), (300, [float("nan"), 0.0, 0.0, 0.0]), (400, [float("inf")] * 4), (500, [1.0, 2.0]), (501, [1.0, -2.0]), (600, []), (0, rows[0][1]), (7, rows[7][1]), (7, rows[7][1])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], KIND).repartition(3)
    got = sorted(map(tuple, topk.search(df, every=10).collect()))
    assert got == brute(rows, every=10)


def test_ties_go_to_the_smaller_id(spark):
    df = spark.createDataFrame([(i, [1.0, 1.0], 0, "") for i in range(5000, -1, -1)], KIND).repartition(4)
    got = topk.search(df, k=3, every=5000).orderBy("query_id", "rank").collect()
    assert [r["vec_id"] for r in got] == [1, 2, 3, 0, 1, 2]


def test_few_candidates_and_none(spark):
    df = spark.createDataFrame([(0, [0.5], 0, ""), (1, [0.25], 0, "")], KIND)
    assert [tuple(r) for r in topk.search(df).collect()] == [(0, 1, 1, 512 * 256)]
    assert topk.search(spark.createDataFrame([], KIND)).collect() == []


def test_large_values_are_exact():
    q, s = np.array([[2.0**40, 1.0]]), np.array([[2.0**20, 1.0], [2.0**20, 3.0]])
    assert topk.products(q, s).tolist() == [[2**60 + 1, 2**60 + 3]]
