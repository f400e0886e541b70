"""op5: the field against enumeration of all paths, and scores on held-out labels."""

import itertools
import math

import numpy as np
import pytest

from terrapatch.llm import common, queries, toxicity

from .conftest import frame, passage

SF, LARGER = "/root/testdata/sf0.01", "/root/testdata/sf0.1"


def enumerated(theta, emit_at, n):
    """Marginals of the toxic state and the log partition of one chain, by all its paths. emit_at: features by token."""
    total, mass = 0.0, np.zeros(n)
    for path in itertools.product((0, 1), repeat=n):
        s, before = 0.0, 0
        for i, y in enumerate(path):
            s += [[0.0, theta[0]], [theta[1], theta[2]]][before][y]
            if y:
                s += theta[3] + float(np.dot(theta[4:6], emit_at.get(i, (0.0, 0.0))))
            before = y
        w = math.exp(s)
        total += w
        mass += w * np.array(path)
    return mass / total, math.log(total)


def test_forward_backward_equals_enumeration():
    r = np.random.default_rng(0)
    for _ in range(40):
        theta = r.normal(0, 1.5, 6)
        docs = [sorted(r.choice(8, r.integers(0, 5), replace=False).tolist()) for _ in range(3)]
        sizes = r.integers(8, 10, 3).tolist()
        x = [{i: r.normal(0, 1, 2) for i in d} for d in docs]
        doc = np.array([k for k, d in enumerate(docs) for _ in d], np.int64)
        gap = np.array([i - (d[j - 1] + 1 if j else 0) for d in docs for j, i in enumerate(d)], np.int64)
        tail = np.array([n - (d[-1] + 1 if d else 0) for d, n in zip(docs, sizes, strict=True)])
        feats = np.array([x[k][i] for k, d in enumerate(docs) for i in d]).reshape(-1, 2)
        marginal, logz = toxicity.passes(theta, doc, gap, tail, feats)
        for k, (d, n) in enumerate(zip(docs, sizes, strict=True)):
            m, z = enumerated(theta, x[k], n)
            assert logz[k] == pytest.approx(z, abs=1e-6)
            assert marginal[doc == k] == pytest.approx(m[d], abs=1e-6)


def test_path_score_is_a_path_of_the_field():
    """The potential of a labelling is what the enumeration gives that path."""
    r = np.random.default_rng(1)
    theta = r.normal(0, 1, 6)
    at, n = [1, 2, 5, 6], 7
    x = r.normal(0, 1, (4, 2))
    for y in itertools.product((False, True), repeat=4):
        path = [0] * n
        for i, on in zip(at, y, strict=True):
            path[i] = int(on)
        s, before = 0.0, 0
        for i, p in enumerate(path):
            s += [[0.0, theta[0]], [theta[1], theta[2]]][before][p] + (theta[3] + float(theta[4:6] @ x[at.index(i)]) if p else 0.0)
            before = p
        got = toxicity.path_score(theta, np.zeros(4, np.int64), np.array([1, 0, 2, 0]), np.array([0]), x, np.array(y))
        assert got[0] == pytest.approx(s)


def auc(score, label):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    for v in np.unique(score):
        rank[score == v] = rank[score == v].mean()
    n1 = label.sum()
    return (rank[label == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(label) - n1))


@pytest.fixture(scope="module")
def scored(spark):
    return queries.op5_toxicity(spark, SF).toPandas()


def test_held_out_documents_are_told_apart(spark):
    """On 990 held-out rows; the smaller tables hold too few toxic rows to learn from."""
    labels = spark.read.parquet(f"{LARGER}/labels.parquet").toPandas()
    both = queries.op5_toxicity(spark, LARGER).toPandas().merge(labels, on="doc_id")
    held = both[both["held_out"]]
    assert auc(held["score"].to_numpy(), held["toxic"].to_numpy()) > 0.95
    assert (held["predicted"] != held["toxic"]).mean() < 0.02


def test_scores_and_predictions(spark, scored):
    assert len(scored) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert ((scored["score"] >= 0) & (scored["score"] <= 1)).all()
    assert ((scored["score"] >= 0.3).astype(int) == scored["predicted"]).all()


def test_held_out_rows_are_those_of_the_check_sum(scored):
    import zlib

    assert all((zlib.crc32(str(i).encode()) % 4 == 2) == h for i, h in zip(scored["doc_id"], scored["held_out"], strict=True))


def test_held_out_labels_are_not_used(spark, scored):
    """Other labels of held-out rows leave the scores as they are."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    held = common.crc_mod("doc_id", 4) == 2
    other = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.tagged(docs, toxicity.learned(docs, other.where(~held))).toPandas()
    both = scored.merge(again, on="doc_id")
    assert np.allclose(both["score_x"], both["score_y"], atol=1e-9)


@pytest.fixture(scope="module")
def field(spark):
    bad = ["vilefool", "scumrat", "trashmouth"]
    texts = [passage(100 + i, 60) for i in range(80)] + [f"{passage(300 + i, 20)} {bad[i % 3]} {bad[(i + 1) % 3]}! {passage(500 + i, 30)}" for i in range(20)]
    docs = frame(spark, texts)
    labels = spark.createDataFrame([(i, int(i >= 80)) for i in range(100)], "doc_id long, toxic int")
    return toxicity.learned(docs, labels)


def test_spans_are_the_offending_words(spark, field):
    text = f"é {passage(900, 30)} vilefool, scumrat {passage(901, 10)}"
    r = toxicity.tagged(frame(spark, [text, passage(902, 40)]), field).orderBy("doc_id").collect()
    raw = text.encode()
    assert [raw[s["start"] : s["end"]].decode() for s in r[0]["spans"]] == ["vilefool, scumrat"]
    assert r[0]["score"] > 0.5 > 0.3 > r[1]["score"] and r[1]["n_spans"] == 0


def test_odd_rows(odd, field):
    got = toxicity.tagged(odd, field).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    kept = toxicity.below(odd, field, 0.3)
    assert kept.schema == odd.schema
    low = sorted(str(r["doc_id"]) for r in got if r["score"] < 0.3)
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == low


def test_empty_tables(spark, empty, field):
    assert toxicity.tagged(empty, field).collect() == []
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    nothing = toxicity.learned(empty, labels)
    got = toxicity.tagged(frame(spark, ["a text", None]), nothing).collect()
    assert len(got) == 2 and all(0 <= r["score"] <= 1 for r in got)


def test_long_texts_are_whole(field, monkeypatch):
    text = f"{passage(903, 500)} vilefool {passage(904, 400)} scumrat trashmouth {passage(905, 100)}".encode()
    data, offs = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    whole, _ = toxicity.score(field, data, offs)
    plain = common.pieces
    monkeypatch.setattr(common, "pieces", lambda d, o: plain(d, o, 300))
    assert toxicity.score(field, data, offs)[0] == pytest.approx(whole)
