"""op3: pieces against the tokenizers library, and plans against brute force."""

import itertools
import random
import struct
import zlib
from collections import defaultdict

import numpy as np
from public_tokenizers import path as vocab
from tokenizers import Tokenizer

from terrapatch.llm import packing, queries

from .conftest import SF

PATH = vocab("word_bpe_49k.json")


def holds(pieces, rows):
    """Every id of every document in one piece, windows gapless and of allowed sizes; returns the share of padding."""
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    docs, windows = defaultdict(list), defaultdict(list)
    for p in pieces:
        docs[p["doc_id"], p["doc_tokens"]].append(p)
        windows[p["sequence_id"]].append(p)
    want = defaultdict(list)
    for doc_id, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        want[doc_id, len(ids)].append(ids)
    assert set(docs) == set(want)
    for key, several in want.items():
        own = sorted(docs[key], key=lambda p: p["start"])
        # documents of one id and length: as many rounds of pieces as there are rows
        assert sum(p["length"] for p in own) == sum(map(len, several))
        crc = lambda ids: zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))
        for p in own:
            assert any(p["ids_crc32"] == crc(ids[p["start"] : p["start"] + p["length"]]) for ids in several)
        if len(several) == 1:
            assert [p["start"] for p in own] == list(itertools.accumulate([0] + [p["length"] for p in own[:-1]]))
    used = padded = 0
    for own in windows.values():
        own.sort(key=lambda p: p["offset"])
        assert [p["offset"] for p in own] == list(itertools.accumulate([0] + [p["length"] for p in own[:-1]]))
        n = sum(p["length"] for p in own)
        assert 0 < n <= packing.SIZE
        used += n
        padded += 0 if n & (n - 1) == 0 else packing.SIZE - n
    return padded / max(used, 1)


def test_whole_table(spark, documents):
    assert holds(queries.op3_packing(spark, SF).collect(), documents.select("doc_id", "text").collect()) < 0.02


def test_odd_rows(odd):
    holds(packing.packed(odd, PATH).collect(), odd.select("doc_id", "text").collect())


def test_empty_table(empty):
    assert packing.packed(empty, PATH).collect() == []


def test_order_is_kept(documents):
    """Documents follow each other through the windows of a partition as in the input."""
    docs = documents.coalesce(1)
    pieces = packing.packed(docs, PATH).orderBy("sequence_id", "offset").collect()
    seen = [k for k, _ in itertools.groupby(p["doc_id"] for p in pieces)]
    assert seen == [r["doc_id"] for r in docs.select("doc_id").collect()]


def test_plan_costs_least():
    """The monotone queue finds what trying all cuts finds."""
    r = random.Random(3)
    for _ in range(200):
        size, total = r.randint(3, 8), r.randint(1, 16)
        at = np.array(sorted({0, total, *(r.sample(range(total + 1), r.randint(0, total)))}))
        if (np.diff(at) > size).any():
            continue
        cost = np.array([0 if p in (0, total) else r.randint(0, 6) for p in at])
        pay = dict(zip(at.tolist(), cost.tolist(), strict=True))

        def price(cuts, pay=pay, size=size):
            return sum(size - (b - a) + pay[b] + packing.WINDOW for a, b in zip([0, *cuts], cuts, strict=False))

        inner = at[1:].tolist()
        best = {}
        for n in range(len(inner) + 1):
            for cuts in itertools.combinations(inner, n):
                if all(b - a <= size for a, b in zip([0, *cuts], cuts, strict=False)):
                    last = cuts[-1] if cuts else 0
                    if last > total - size:
                        best[last] = min(best.get(last, 1 << 30), price(list(cuts)) if cuts else 0)
        got = packing.plan(at, cost, size)
        assert (price(got) if got else 0) == min(best.values())


def test_powers_of_two():
    assert packing.powers(0, 13) == [8, 12, 13]
    assert packing.powers(5, 5) == []


def test_cuts_prefer_sentences():
    """In a long text windows end at sentences' ends unless padding costs more."""
    ends, stops = np.array([6000]), np.arange(37, 6000, 37)
    at, cost = packing.candidates(ends, stops, 6000)
    cuts = packing.plan(at, cost)
    assert cuts and all(c in set(stops.tolist()) for c in cuts)
