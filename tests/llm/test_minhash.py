"""op10: fingerprints, edited texts and likeness."""

import hashlib

import numpy as np

from terrapatch.llm import minhash, queries, words

from .conftest import SF, passage


def edits(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    texts = [t or "" for _, t in rows]
    out = []
    for n, (i, _) in enumerate(rows):
        own, after = texts[n], texts[(n + 1) % len(rows)]
        half = len(own) // 2
        out.append((i, len(own), own[: len(own) - half] + after[:half], own, after))
    return out


def holds(got, rows):
    want = edits(rows)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])
    found = sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got), key=key)
    assert found == sorted(((i, n, hashlib.sha256(e.encode()).hexdigest()) for i, n, e, _, _ in want), key=key)
    own = {}
    for i, n, e, text, after in want:
        own[hashlib.sha256(e.encode()).hexdigest(), i] = (text, e, after)
    prints = {}
    for r in got:
        text, e, after = own[r["edited_sha256"], r["doc_id"]]
        for t, p in ((text, r["fingerprint"]), (e, r["edited_fingerprint"])):
            assert prints.setdefault(t, p) == p  # equal texts, equal fingerprints
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        assert text != e or r["near_edited"] == 1
        assert text != after or r["near_next"] == 1
    return own


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))}


def resemblance(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def test_whole_table(spark, documents):
    got = queries.op10_minhash(spark, SF).collect()
    own = holds(got, documents.select("doc_id", "text").collect())
    gaps = []
    for r in got:
        text, e, _ = own[r["edited_sha256"], r["doc_id"]]
        if len(text.split()) >= 30:
            gaps.append(r["near_edited"] - resemblance(text, e))
    assert abs(np.mean(gaps)) < 0.02 and np.sqrt(np.mean(np.square(gaps))) < 0.06


def test_odd_rows(odd):
    got = minhash.fingerprinted(odd).collect()
    assert len(got) == odd.count()
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    ids = sorted(r["doc_id"] for r in got if r["doc_id"] is not None)
    assert ids == sorted(r["doc_id"] for r in odd.collect() if r["doc_id"] is not None)


def test_ascending_ids_over_many_ranges(spark):
    import random

    r = random.Random(4)
    ids = r.sample(range(-500, 5000), 300)
    rows = [(i, passage(i % 50, 1 + i % 17)) for i in ids]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    holds(minhash.fingerprinted(df).collect(), rows)


def test_one_row_and_none(spark, empty):
    one = minhash.fingerprinted(spark.createDataFrame([(5, "a few words that stand alone here")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1
    assert minhash.fingerprinted(empty).collect() == []


def test_estimates_are_unbiased():
    """Likeness follows the resemblance over its whole range, for texts with fewer shingles than bins too."""
    errors = []
    for seed in range(60):
        for n in (40, 400):
            a = passage(seed, n).split()
            b = a.copy()
            b[: seed * n // 60] = passage(1000 + seed, n).split()[: seed * n // 60]
            x, y = " ".join(a), " ".join(b)
            p = minhash.fingerprints([x.encode(), y.encode()])
            errors.append(float(minhash.likeness(p[:1], p[1:])[0]) - resemblance(x, y))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.07


def test_no_bin_stays_empty():
    text = [b"one two three four five six"]
    data, offs = np.frombuffer(text[0], np.uint8), np.array([0, len(text[0])])
    filled = minhash.bins(data, offs)
    assert len(np.unique(filled)) <= 2  # two shingles fill all bins
    row, h = zip(*words.shingle_hashes(data, offs, 5), strict=True)
    assert len(h[0]) == 2


def test_long_texts_are_whole(monkeypatch):
    from terrapatch.llm import common

    text = passage(30, 3000).encode()
    whole = minhash.fingerprints([text])
    plain = common.pieces
    monkeypatch.setattr(common, "pieces", lambda d, o: plain(d, o, 400))
    assert (minhash.fingerprints([text]) == whole).all()
