"""op6: removal of repeated bytes against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from terrapatch.llm import queries, suffixes

from .conftest import SF, frame, passage

L = suffixes.LENGTH


def brute(rows):
    data = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[k : k + L] for _, b in data for k in range(len(b) - L + 1))
    out = []
    for i, b in data:
        gone = np.zeros(len(b) + 1, np.int64)
        for k in range(len(b) - L + 1):
            if seen[b[k : k + L]] > 1:
                gone[k] += 1
                gone[k + L] -= 1 if k + L <= len(b) else 0
        mask = np.cumsum(gone)[: len(b)] > 0
        kept = bytes(np.frombuffer(b, np.uint8)[~mask])
        runs = int(mask[:1].sum() + (mask[1:] & ~mask[:-1]).sum()) if len(b) else 0
        out.append((i, len(b), int(mask.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


def result(df):
    return sorted(map(tuple, df.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


def test_whole_table(spark, documents):
    got = result(queries.op6_suffixes(spark, SF))
    assert got == brute(documents.select("doc_id", "text").collect())
    assert any(r[2] for r in got)


def test_odd_rows(odd):
    assert result(suffixes.removed(odd)) == brute(odd.select("doc_id", "text").collect())


def test_empty_table(empty):
    assert suffixes.removed(empty).collect() == []
    assert suffixes.cleaned(empty).collect() == []


@pytest.mark.parametrize("seed", range(3))
def test_passages_at_all_edges(spark, seed):
    """Passages of lengths about the limit, at different places, with shared and differing surroundings, periodic texts and tiny alphabets."""
    r = random.Random(seed)
    word = lambda n, abc: "".join(r.choices(abc, k=n))
    shared = [word(n, "abcdef ") for n in (198, 199, 200, 201, 230, 400, 777)]
    texts = []
    for _ in range(60):
        parts = [r.choice([word(r.randint(0, 150), "abcdefgh "), r.choice(shared), r.choice(shared)[r.randint(0, 60) :], "ab" * r.randint(0, 200), word(r.randint(0, 5), "é中")]) for _ in range(r.randint(1, 6))]
        texts.append("".join(parts))
    texts += ["a" * 199, "a" * 200, "a" * 201, "b" * 200, "c" * 200 + "d", "d" + "c" * 200, "xy" * 400]
    df = frame(spark, texts).repartition(3)
    assert result(suffixes.removed(df)) == brute(list(enumerate(texts)))


def test_long_texts_are_worked_on_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "PIECE", 700)
    from terrapatch.llm import common

    monkeypatch.setattr(common, "CHUNK_BYTES", 1500)
    text = passage(20, 800)
    data, offs = np.frombuffer((text + text[100:2500]).encode(), np.uint8), np.array([0, len(text), len(text) + 2400])
    seen = Counter()
    for row, _, _, s, n, o in suffixes.contexts(data, offs):
        for a, b, c, d in zip(row.tolist(), s.tolist(), n.tolist(), o.tolist(), strict=True):
            assert -L < c - 1 + L - d and d < L
            seen.update((a, b + k) for k in range(c))
    windows = {(0, k) for k in range(len(text) - L + 1)} | {(1, k) for k in range(2400 - L + 1)}
    assert set(seen) == windows and max(seen.values()) == 1


def test_samples_depend_on_the_window_alone():
    """The least position of a window is the same wherever the window stands."""
    a, b = passage(21, 100).encode(), passage(22, 100).encode()
    ha, hb = (suffixes.Hashes(np.frombuffer(x, np.uint8)) for x in (a, b[:77] + a))
    pa_, pb = suffixes.least_positions(ha.samples()), suffixes.least_positions(hb.samples())
    assert (pb[77 : 77 + len(pa_)] - 77 == pa_).all()


def test_cleaned_keeps_columns_and_follows_the_text(spark, odd):
    got = suffixes.cleaned(odd)
    assert got.schema == odd.schema
    rows = got.collect()
    assert len(rows) == odd.count()
    assert all(r["n_chars"] == len(r["text"]) for r in rows if r["text"] is not None and r["doc_id"] is not None and r["doc_id"] < 18)
    assert sum(r["text"] is None for r in rows) == odd.where("text IS NULL").count()
    shared = passage(1, 60)
    assert all(shared not in (r["text"] or "") for r in rows)
