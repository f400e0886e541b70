"""The corpus pipeline on the smallest tables and on planted cases."""

import re

import corpus_pipeline as pipeline
import pytest

from .conftest import SF, passage
from .test_packing import holds

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages():
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "near_duplicates", "passages", "packing"]


@pytest.fixture(scope="module")
def stages(spark, documents):
    """What each stage returns, written and read again."""
    from terrapatch.llm import common

    out, docs = [documents], documents
    for name, stage in pipeline.STAGES:
        docs = common.written(stage(spark, docs, SF), f"test-{name}")
        out.append(docs)
    return out


def test_stages_keep_the_columns(documents, stages):
    assert all(s.columns == documents.columns for s in stages[1:-1])
    counts = [s.count() for s in stages[:-1]]
    assert counts[0] >= counts[1] >= counts[2] == counts[3] > 0.5 * counts[0]


def test_toxic_documents_go_and_clean_ones_stay(labels, stages):
    left = {r["doc_id"] for r in stages[1].select("doc_id").collect()}
    marks = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    toxic, clean = [i for i, t in marks.items() if t == 1], [i for i, t in marks.items() if t == 0]
    assert sum(i in left for i in clean) >= 0.97 * len(clean)
    assert sum(i not in left for i in toxic) > 0.5 * len(toxic)  # eleven, some of which have no word that marks others


def shingles(text):
    w = re.findall(r"\S+", (text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def test_near_copies_go_and_others_stay(stages):
    """Brute force on five words. All pairs that are 0.9 alike are found and nine in ten of those that are 0.8 (the README has figures); what goes is alike to something."""
    rows = [(r["doc_id"], shingles(r["text"])) for r in stages[1].collect()]
    left = {r["doc_id"] for r in stages[2].select("doc_id").collect()}
    like = lambda a, b: len(a & b) / max(len(a | b), 1)
    alike = {i: [j for j, t in rows if j != i and (like(s, t) >= 0.8 or s == t)] for i, s in rows}
    close = {i: any(j != i and like(s, t) >= 0.3 for j, t in rows) for i, s in rows}
    by = dict(rows)
    missed = [i for i in left if any(j in left for j in alike[i])]
    assert len(missed) <= 0.1 * max(1, sum(bool(v) for v in alike.values()))
    assert not any(j in left and like(by[i], by[j]) >= 0.9 for i in left for j in alike[i])
    wrong = [i for i, _ in rows if i not in left and not alike[i] and not close[i]]
    assert len(wrong) <= 0.02 * len(rows)


def test_of_each_component_of_fingerprints_one_stays(spark, stages):
    """The method of op4: what its fingerprints link goes, on the table and where the sets of five words are less alike than 0.8; unlike texts stay."""
    from terrapatch.llm import simhash

    from .conftest import frame
    from .test_simhash import fingerprint

    component = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(stages[1]).collect()}
    left = [component[r["doc_id"]] for r in stages[2].select("doc_id").collect()]
    assert len(left) == len(set(left))
    pairs, seed = [], 3000
    while len(pairs) < 3:
        seed += 1
        one, other = passage(seed, 100).split(), passage(seed, 100).split()
        for i in (25, 50, 75):
            other[i] = f"edit{i}"
        one, other = " ".join(one), " ".join(other)
        if (fingerprint(one) ^ fingerprint(other)).bit_count() <= 4:
            assert len(shingles(one) & shingles(other)) < 0.8 * len(shingles(one) | shingles(other))
            pairs += [(one, other)]
    texts = [t for pair in pairs for t in pair] + [passage(2000 + i, 100) for i in range(20)] + [None, ""]
    got = pipeline.near_copies_out(spark, frame(spark, texts), SF)
    assert sorted(r["doc_id"] for r in got.collect()) == [0, 2, 4, *range(6, 27)]


def test_passages_are_gone(stages):
    from .test_suffixes import brute

    cut = {r[0]: r for r in brute([(r["doc_id"], r["text"]) for r in stages[2].collect()])}
    for r in stages[3].collect():
        _, n, gone, _, _ = cut[r["doc_id"]]
        assert len((r["text"] or "").encode()) == pytest.approx(n - gone, abs=8)  # parts of characters at the cuts go
        assert r["n_chars"] == len(r["text"])


def test_all_that_is_left_is_packed(spark, stages):
    holds(stages[4].collect(), [(r["doc_id"], r["text"]) for r in stages[3].collect()])
    run = pipeline.run(spark, SF)
    assert run.columns == stages[4].columns
    assert {(r["doc_id"], r["doc_tokens"]) for r in run.select("doc_id", "doc_tokens").distinct().collect()} == {(r["doc_id"], r["doc_tokens"]) for r in stages[4].select("doc_id", "doc_tokens").distinct().collect()}


def test_planted_cases(spark, tmp_path):
    """Exact and near copies, a shared passage, a toxic document among clean ones, nulls, and no rows."""
    bad = "vilefool scumrat trashmouth"
    clean = [passage(600 + i, 80) for i in range(60)]
    shared = passage(599, 55)
    near = clean[0].split()
    near[40] = "other"
    texts = [*clean, clean[1], " ".join(near), f"{passage(700, 50)} {shared} {passage(701, 40)}", f"{passage(702, 60)} {shared} {passage(703, 30)}", f"{passage(704, 40)} {bad} {passage(705, 30)}", None, ""]
    texts += [f"{passage(800 + i, 30)} {bad} {passage(850 + i, 20)}" for i in range(20)]
    docs = spark.createDataFrame([(i, t, None, None, None if t is None else len(t)) for i, t in enumerate(texts)], COLUMNS)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(60)] + [(i, 0, 1) for i in range(67, 87)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    one = pipeline.toxic_out(spark, docs, str(tmp_path))
    left = sorted(r["doc_id"] for r in one.collect())
    assert left == [*range(64), 65, 66]
    two = pipeline.near_copies_out(spark, one, str(tmp_path))
    assert sorted(r["doc_id"] for r in two.collect()) == [*range(60), 62, 63, 65]
    three = {r["doc_id"]: r["text"] for r in pipeline.passages_out(spark, two, str(tmp_path)).collect()}
    assert shared[1:-1] not in three[62] and shared[1:-1] not in three[63] and three[5] == clean[5]
    pieces = pipeline.run(spark, str(tmp_path)).collect()
    assert {p["doc_id"] for p in pieces} == {*range(60), 62, 63, 65}
    docs.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    spark.read.parquet(str(tmp_path / "labels.parquet")).write.parquet(str(tmp_path / "none" / "labels.parquet"))
    assert pipeline.run(spark, str(tmp_path / "none")).collect() == []
