"""op4: fingerprints and components against brute force."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from terrapatch.llm import graph, queries, simhash

from .conftest import SF, frame, passage

WORD = re.compile("[^\x20\x09-\x0d]+")


def fingerprint(text, n=4):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    runs = [" ".join(words[i : i + n]) for i in range(max(len(words) - n + 1, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(values):
    """Smallest member that each value reaches by links of at most four bits."""
    values = sorted(set(values))
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if (a ^ b).bit_count() <= 4 and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {v: find(v) for v in values}


def expected(rows):
    prints = [(i, fingerprint(t)) for i, t in rows]
    root = components([p for _, p in prints])
    least = defaultdict(lambda: 1 << 62)
    for i, p in prints:
        if i is not None:
            least[root[p]] = min(least[root[p]], i)
    return sorted(((i, f"{p:016x}", least.get(root[p])) for i, p in prints), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def result(df):
    return sorted(map(tuple, df.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def test_whole_table(spark, documents):
    assert result(queries.op4_simhash(spark, SF)) == expected(documents.select("doc_id", "text").collect())


def test_odd_rows(odd):
    assert result(simhash.near_duplicates(odd)) == expected(odd.select("doc_id", "text").collect())


def test_empty_table(empty):
    assert simhash.near_duplicates(empty).collect() == []
    assert simhash.representatives(empty).collect() == []


def test_long_texts_are_whole(spark, monkeypatch):
    from terrapatch.llm import common

    text = passage(8, 3000)
    plain = common.pieces
    monkeypatch.setattr(common, "pieces", lambda d, o: plain(d, o, 500))
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text])], names=["a", "b"])
    got = next(simhash.fingerprints(iter([batch]))).column(1)[0].as_py()
    assert got & (2**64 - 1) == fingerprint(text)


@pytest.mark.parametrize("block, extend", [(2048, 32768), (7, 32768), (7, 50)])
def test_links_connect_all_that_is_within_the_budget(spark, monkeypatch, block, extend):
    """Random and crowded fingerprints; with small bounds, keys are extended along the ring and dealt out in blocks."""
    monkeypatch.setattr(simhash, "KEY_BLOCK", block)
    monkeypatch.setattr(simhash, "EXTEND", extend)
    r = random.Random(block)
    values = {r.getrandbits(64) for _ in range(60)} | {0, 2**64 - 1}
    for v in list(values)[:20]:
        for _ in range(6):
            x = v
            for b in r.sample(range(64), r.randint(1, 6)):
                x ^= 1 << b
            values.add(x)
            v = x if r.random() < 0.5 else v
    crowd = r.getrandbits(64)
    values |= {crowd ^ 1 << b for b in range(64)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in signed], "fp long").repartition(3)
    pairs = [(a & 2**64 - 1, b & 2**64 - 1) for a, b in simhash.links(df).collect()]
    assert all((a ^ b).bit_count() <= 4 for a, b in pairs)
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert {v: find(v) for v in values} == components(values)


def test_chains_drop_no_pair_within_the_budget():
    """Some start on the ring passes for every pair of at most four differing bits, and the full distance is checked."""
    r = random.Random(9)
    for _ in range(300):
        a, b = r.getrandbits(64), 0
        for bit in r.sample(range(64), r.randint(0, 7)):
            b |= 1 << bit
        hit = any(simhash.linked(np.uint64(a), np.array([a ^ b], np.uint64), i)[0] for i in range(5))
        assert hit == (b.bit_count() <= 4)


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100), (7, 7)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert {n for n, root in got.items() if root == 0} | {0} == set(range(41))
    assert got[101] == got[102] == 100


def test_one_of_each_group_stays(spark):
    base = passage(11, 120)
    edited = base.split()
    edited[60] = "changed"
    texts = [passage(12, 100), base, base, " ".join(edited), passage(13, 90), None, ""]
    df = frame(spark, texts).withColumnRenamed("doc_id", "doc_id")
    kept = sorted(r["doc_id"] for r in simhash.representatives(df).collect())
    assert kept == [0, 1, 4, 5]


def test_representatives_keep_columns_and_distinct_documents(odd):
    got = simhash.representatives(odd)
    assert got.schema == odd.schema
    rows = got.collect()
    texts = [r["text"] for r in rows if r["text"] and len(r["text"].split()) > 4]
    assert len(texts) == len(set(texts)) and "abc " * 200 in texts


def test_representatives_take_five_words_and_four_fifths(spark):
    """Edits spread over texts: the pairs a little above 0.8 on five words lose one document, those a little below keep both."""

    def like(a, b):
        a, b = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a.split(), b.split()))
        return len(a & b) / len(a | b)

    texts, want = [], []
    for k in range(40):
        w = passage(9000 + k, 200).split()
        edited = list(w)
        for i in range(4 if k % 2 else 5):  # four edits are 0.81 alike, five 0.77
            edited[15 + 40 * i] = f"edit{i}"
        texts += [" ".join(w), " ".join(edited)]
        assert (like(*texts[-2:]) >= 0.8) == bool(k % 2) and like(*texts[-2:]) > 0.75
        want += [2 * k] if k % 2 else [2 * k, 2 * k + 1]
    assert sorted(r["doc_id"] for r in simhash.representatives(frame(spark, texts)).collect()) == want


def test_blocks_of_a_large_key_link_alike(spark, monkeypatch):
    """A chain of texts: neighbours are alike, and it stays one group when its keys are dealt out in blocks."""
    w = passage(9100, 200).split()
    texts = []
    for k in range(30):
        w[15 + 6 * k] = f"edit{k}"
        texts.append(" ".join(w))
    docs = frame(spark, texts)
    one = [r["doc_id"] for r in simhash.representatives(docs).collect()]
    monkeypatch.setattr(simhash, "KEY_BLOCK", 4)
    assert [r["doc_id"] for r in simhash.representatives(docs).collect()] == one == [0]
