"""Document fingerprints by one-permutation MinHash.

Each word shingle is hashed once; the top bits of the hash choose a bin, and a bin keeps
its least hash.  An empty bin takes the value of a bin that a hash of its own number and of
the attempt chooses, until that one is not empty (optimal densification).  The low-order
bits of the values are packed; equal bits by chance are corrected for in the likeness.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrapatch.llm import common, words

SHINGLE = 5
#: Bins (2**8) and bits kept of each.
BIN_BITS, KEPT = 8, 4
BINS = 1 << BIN_BITS
_VALUE_BITS = 42
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def bins(data: np.ndarray, offs: np.ndarray, n: int = SHINGLE) -> np.ndarray:
    """The least hash of each bin of each text (texts x BINS), densified. A text without words has the bins of one fixed shingle."""
    rows = len(offs) - 1
    out = np.full(rows * BINS, _NONE, np.uint64)
    for row, h in words.shingle_hashes(data, offs, n):
        if not len(row):
            continue
        low = row.min()
        for a in range(0, int(row.max() - low) + 1, 1 << 14):  # texts in the key's upper bits
            sel = slice(None) if row.max() - low < 1 << 14 else (row - low >= a) & (row - low < a + (1 << 14))
            key = np.sort(((row[sel] - low - a).astype(np.uint64) << np.uint64(50)) | (h[sel] >> np.uint64(14)))
            if not len(key):
                continue
            place = (key >> np.uint64(_VALUE_BITS)).astype(np.int64)
            lead = np.concatenate([[True], place[1:] != place[:-1]])
            at = place[lead] + (low + a) * BINS
            out[at] = np.minimum(out[at], key[lead] & np.uint64((1 << _VALUE_BITS) - 1))
    out = out.reshape(rows, BINS)
    none = (out == _NONE).all(1)
    out[none, 0] = 0
    filled = out != _NONE
    turn = 0
    todo = np.flatnonzero(~filled.ravel())
    dense = out.copy().ravel()
    while len(todo):
        b = (todo % BINS).astype(np.uint64)
        other = (words.mixed(b * np.uint64(0x9E3779B97F4A7C15) + np.uint64((turn * 0xC2B2AE3D27D4EB4F + 1) & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(64 - BIN_BITS)).astype(np.int64)
        source = todo - todo % BINS + other
        ok = filled.ravel()[source]
        dense[todo[ok]] = out.ravel()[source[ok]]
        todo = todo[~ok]
        turn += 1
    return dense.reshape(rows, BINS)


def packed(values: np.ndarray) -> np.ndarray:
    """The low-order bits of the (mixed) values, two bins to a byte."""
    low = (words.mixed(values) & np.uint64((1 << KEPT) - 1)).astype(np.uint8)
    return low[:, 0::2] << 4 | low[:, 1::2]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated resemblance of packed fingerprints, row by row, without the matches that chance makes."""
    x = a ^ b
    same = ((x & 15) == 0).mean(1) / 2 + ((x >> 4) == 0).mean(1) / 2
    chance = 1.0 / (1 << KEPT)
    return np.clip((same - chance) / (1 - chance), 0.0, 1.0)


def fingerprints(texts: list[bytes]) -> np.ndarray:
    """Packed fingerprints of UTF-8 texts."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    offs = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
    return packed(bins(data, offs))


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def with_next(docs: DataFrame, id_column: str, column: str) -> DataFrame:
    """Rows (p, tail, k, doc_id, text) of contiguous ranges p of ids; the first row of the next range (after the last: of all) follows each range with tail = 1. Null ids come first."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    low = -(2**63)
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(column), F.lit("")).alias("text")).withColumn("k", F.coalesce("doc_id", F.lit(low)))
    ranges = 4 * parts
    cuts = rows.select(F.col("doc_id").cast("double").alias("x")).approxQuantile("x", [i / ranges for i in range(1, ranges)], 0.25 / ranges)
    edges = np.unique(np.array(cuts, np.float64)).astype(np.int64)

    def place(batches):
        for b in batches:
            p = np.searchsorted(edges, b.column(0).to_numpy(False), side="right")
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), b.column(0)], names=["p", "k"])

    # one row for each range, of which there are a few for each partition
    heads = rows.select("k").mapInArrow(place, "p int, k long").groupBy("p").agg(F.min("k").alias("k")).orderBy("p").collect()
    number = {r["k"]: (heads[i - 1]["p"] if i else heads[-1]["p"]) for i, r in enumerate(heads)}
    firsts = np.array(sorted(number), np.int64)
    before = np.array([number[k] for k in firsts.tolist()], np.int32)

    def deal(batches):
        for b in batches:
            k = b.column(2).to_numpy(False)
            p = np.searchsorted(edges, k, side="right")
            tail = np.flatnonzero(np.isin(k, firsts))
            for at, range_, is_tail in ((None, p, 0), (tail, before[np.searchsorted(firsts, k[tail])], 1)):
                cols = list(b.columns) if at is None else [c.take(pa.array(at)) for c in b.columns]
                yield pa.RecordBatch.from_arrays([pa.array(range_, pa.int32()), pa.array(np.full(len(range_), is_tail), pa.int32()), cols[2], cols[0], cols[1]], names=["p", "tail", "k", "doc_id", "text"])

    dealt = rows.mapInArrow(deal, "p int, tail int, k long, doc_id long, text string")
    return dealt.repartition(parts, "p").sortWithinPartitions("p", "tail", "k", "text")


def fingerprinted(docs: DataFrame, id_column: str = "doc_id", column: str = "text") -> DataFrame:
    """The fingerprint of each text and of its edited text, and how alike its fingerprint is to that and to the next document's.

    The edited text has the last half of its code points replaced by as many first ones of the next document, by
    ascending id (equal ids by text; null ids first; after the last comes the first). Null texts are empty; all
    texts without words are alike. A table of one row follows itself; an empty table gives no rows.
    """
    common.small_batches(docs.sparkSession)

    def run(batches):
        held: list = []  # of one range: (tail, id, text); the last waits for its next
        now = None
        for batch in batches:
            p, tail, _, ids, texts = (c.to_pylist() for c in batch.columns)
            for i in range(len(p)):
                if p[i] != now:
                    if held:
                        yield from emit(held)
                    now, held = p[i], []
                if tail[i] and held and held[-1][0]:
                    continue  # a repeated row of the first id of the next range
                held.append((tail[i], ids[i], texts[i]))
                if len(held) > 200 or sum(len(x[2]) for x in held[-2:]) > 1_000_000:
                    yield from emit(held)
                    held = held[-1:]
        if held:
            yield from emit(held)

    def emit(held):
        """Rows of all but the last of held, each with its next."""
        if len(held) < 2:
            return
        text = [x[2] for x in held]
        half = [len(x) // 2 for x in text[:-1]]
        edited = [(x[: len(x) - h] + y[:h]).encode() for x, y, h in zip(text[:-1], text[1:], half, strict=True)]
        n = len(edited)
        prints = fingerprints([x.encode() for x in text] + edited)
        own, after, new = prints[:n], prints[1 : n + 1], prints[n + 1 :]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([x[1] for x in held[:-1]], pa.int64()),
                pa.array([len(x) for x in text[:-1]], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in edited]),
                pa.array([x.tobytes().hex() for x in own]),
                pa.array([x.tobytes().hex() for x in new]),
                pa.array(likeness(own, new)),
                pa.array(likeness(own, after)),
            ],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    return with_next(docs, id_column, column).mapInArrow(run, RESULT)
