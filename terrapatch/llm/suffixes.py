"""Removal of repeated passages: every byte covered by a string of `LENGTH` bytes that also starts elsewhere.

The suffixes that matter are windows of LENGTH bytes.  As a cover sample serve the positions
whose 32-byte string has the least hash within some window: equal windows hold equal sample
positions at equal offsets, so a window is repeated only if its sample string is, and the
sample is about one position in 85.  Suffixes are bucketed by their sample string and one
bucket at a time is resolved: windows around one sample position form a context, whose rank
is its hash; equal contexts are repeated whole.  Contexts that differ are cut at multiples of
STEP of their offset to the sample position; parts without an equal core drop out, equal
parts are repeated whole, and only parts that an edge of a passage crosses are compared
window by window.  No bucket is ever gathered: each step is an aggregation by key.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrapatch.llm import common, words

LENGTH = 200
#: Bytes of a sample string, sample strings in a window, and windows of a part.
SAMPLE = 32
SPAN = LENGTH - SAMPLE + 1
STEP = 32
#: Windows of a text that are worked on at once.
PIECE = 4_000_000
_R = 0xD1342543DE82EF95
_POS = np.uint64((1 << 24) - 1)


@functools.lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64."""
    one, two = np.full(n, _R, np.uint64), np.full(n, pow(_R, -1, 1 << 64), np.uint64)
    one[0] = two[0] = 1
    return np.cumprod(one, dtype=np.uint64), np.cumprod(two, dtype=np.uint64)


class Hashes:
    """Hashes of any substrings of some bytes, by sums over their 8-byte strings."""

    def __init__(self, data: np.ndarray):
        n = 1 << max(20, int(len(data) + 1).bit_length())
        self.up, self.down = _powers(n)
        pad = np.concatenate([data, np.zeros(8, np.uint8)])
        self.eight = words.mixed(np.ndarray(len(data) + 1, "<u8", pad.data, 0, (1,)).copy() + np.uint64(1))
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(self.eight * self.up[: len(self.eight)], dtype=np.uint64)])

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hash of data[a:b], at least 8 bytes each."""
        return words.mixed((self.sums[b - 7] - self.sums[a]) * self.down[a] + (b - a).astype(np.uint64))

    def samples(self) -> np.ndarray:
        """Hash of the 32 bytes from each position on that has as many."""
        e, n = self.eight, len(self.eight) - 1 - SAMPLE + 1
        h = e[:n] + e[8 : n + 8] * np.uint64(0x9E3779B97F4A7C15) + e[16 : n + 16] * np.uint64(0xC2B2AE3D27D4EB4F) + e[24 : n + 24] * np.uint64(0x165667B19E3779F9)
        return words.mixed(h)


def least_positions(h: np.ndarray) -> np.ndarray:
    """For each window the (leftmost) position of the least of its SPAN hashes."""
    n = len(h)
    key = (h & ~_POS) | np.arange(n, dtype=np.uint64)
    width = -(-n // SPAN) * SPAN
    key = np.concatenate([key, np.full(width - n, np.uint64(0xFFFFFFFFFFFFFFFF))]).reshape(-1, SPAN)
    left = np.minimum.accumulate(key, axis=1).ravel()
    right = np.minimum.accumulate(key[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - SPAN + 1
    return (np.minimum(right[:m], left[SPAN - 1 : SPAN - 1 + m]) & _POS).astype(np.int64)


def runs(offs: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first byte, end, rows with window ranges) of chunks: texts together up to CHUNK_BYTES, long texts in pieces of windows. The last item has columns row, first window, end of windows."""
    held, begin = [], None
    for row in range(len(offs) - 1):
        a, b = int(offs[row]), int(offs[row + 1])
        if b - a < LENGTH:
            continue
        for w in range(a, b - LENGTH + 1, PIECE):
            e = min(w + PIECE, b - LENGTH + 1)
            if begin is not None and e + LENGTH - 1 - begin > common.CHUNK_BYTES:
                yield begin, held[-1][2] + LENGTH - 1, np.array(held, np.int64)
                held, begin = [], None
            if begin is None:
                begin = w
            held.append((row, w, e))
    if held:
        yield begin, held[-1][2] + LENGTH - 1, np.array(held, np.int64)


def contexts(data: np.ndarray, offs: np.ndarray):
    """Sample positions of the texts with the windows around them: row, sample hash, context hash, first window (in the text), number of windows, offset of the sample position to the first window."""
    for begin, end, ranges in runs(offs):
        hashes = Hashes(data[begin:end])
        h = hashes.samples()
        at = least_positions(h)
        lens = ranges[:, 2] - ranges[:, 1]
        window = words.gathered(ranges[:, 1] - begin, lens)
        sample = at[window]
        part = np.repeat(np.arange(len(lens)), lens)
        new = np.ones(len(window), bool)
        new[1:] = (sample[1:] != sample[:-1]) | (part[1:] != part[:-1])
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(window)))
        s, a, row = window[first], sample[first], ranges[part[first], 0]
        yield row, h[a], hashes.of(s, s + count - 1 + LENGTH), s + begin - offs[row], count, a - s


def _packed(s: np.ndarray, n: np.ndarray, o: np.ndarray) -> np.ndarray:
    return s << 16 | n << 8 | o


def _zipped(docs: DataFrame) -> DataFrame:
    """Texts compressed, for the shuffles in which they move."""

    def run(batches):
        for b in batches:
            t = b.column(1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.as_buffer().size if x.is_valid else 0 for x in t], pa.int64()), pa.array([pa.compress(x.as_buffer(), "zstd", asbytes=True) if x.is_valid else b"" for x in t], pa.binary())], names=["k", "size", "z"])

    return docs.select("k", "text").mapInArrow(run, "k long, size long, z binary")


def _unzipped(size: int, z: bytes) -> bytes:
    return pa.decompress(z, size, "zstd", asbytes=True) if size else b""


def repeated(docs: DataFrame) -> DataFrame:
    """(k, spans): for each text (rows k, text; k is equal for equal rows only) the byte ranges, possibly overlapping, that repeated windows cover."""

    def scan(batches):
        for b in batches:
            data, offs = common.texts(b, 1)
            k = b.column(0).to_numpy(False)
            for row, anchor, ctx, s, n, o in contexts(data, offs):
                yield pa.RecordBatch.from_arrays([pa.array(k[row]), pa.array(anchor.view(np.int64)), pa.array(ctx.view(np.int64)), pa.array(_packed(s, n, o))], names=["k", "anchor", "ctx", "at"])

    seen = common.written(docs.select("k", "text").mapInArrow(scan, "k long, anchor long, ctx long, at long"), "suffix-samples")
    live = common.written(seen.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "suffix-live")
    held = common.written(seen.join(live.hint("shuffle_merge"), "anchor"), "suffix-held")
    common.forgotten(seen, live)
    known = common.written(held.groupBy("anchor", "ctx").agg(F.count("*").alias("c"), F.min(F.struct("k", "at")).alias("one")), "suffix-contexts")
    # contexts that occur again are repeated whole
    again = held.join(known.where("c > 1").select("anchor", "ctx").hint("shuffle_merge"), ["anchor", "ctx"])
    first = F.shiftright("at", 16)
    whole = again.select("k", F.struct(first.alias("a"), (first + F.shiftright("at", 8).bitwiseAND(F.lit(255)) - 1 + LENGTH).alias("b")).alias("span"))
    # of samples with several contexts, one occurrence of each is looked at again
    several = common.written(known.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "suffix-several")
    asked = known.join(several.hint("shuffle_merge"), "anchor").select(F.col("one.k").alias("k"), F.struct("anchor", "ctx", "c", F.col("one.at").alias("at")).alias("q"))
    asked = asked.groupBy("k").agg(F.collect_list("q").alias("q"))  # as many as the text has sample positions
    met = asked.hint("shuffle_merge").join(_zipped(docs), "k").dropDuplicates(["k"])

    def cut(batches):
        for b in batches:
            for r in range(b.num_rows):
                q, size, z = b.column(1)[r].as_py(), b.column(2)[r].as_py(), b.column(3)[r].as_py()
                text = _unzipped(size, z)
                hashes = Hashes(np.frombuffer(text, np.uint8))
                at = np.array([x["at"] for x in q], np.int64)
                s, n, o = at >> 16, at >> 8 & 255, at & 255
                # offsets of a context's windows to the sample: from o down to o - n + 1; part p has offsets p * STEP ... + STEP - 1
                low, high = (o - n + 1) // STEP, o // STEP
                who = np.repeat(np.arange(len(q)), high - low + 1)
                p = low[who] + np.arange(len(who)) - np.repeat(np.cumsum(high - low + 1) - (high - low + 1), high - low + 1)
                sample = (s + o)[who]
                top, bottom = np.minimum(o[who], p * STEP + STEP - 1), np.maximum((o - n + 1)[who], p * STEP)
                begin, end = sample - p * STEP, sample - p * STEP - STEP + 1 + LENGTH
                core = hashes.of(begin, end)
                left = [text[x:y] for x, y in zip((sample - top).tolist(), begin.tolist(), strict=True)]
                right = [text[x:y] for x, y in zip(end.tolist(), (sample - bottom + LENGTH).tolist(), strict=True)]
                c = np.array([x["c"] for x in q], np.int64)[who]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.array([x["anchor"] for x in q], np.int64)[who]), pa.array(p, pa.int32()), pa.array(core.view(np.int64)), pa.array(c > 1), pa.array(np.full(len(who), b.column(0)[r].as_py())), pa.array(sample - top), pa.array(top - bottom + 1, pa.int32()), pa.array(left, pa.binary()), pa.array(right, pa.binary())],
                    names=["anchor", "part", "core", "again", "k", "first", "n", "left", "right"],
                )

    # a part's windows hold its core; the j-th has the last bytes of `left` and the first of `right` besides
    parts = common.written(met.select("k", "q", "size", "z").mapInArrow(cut, "anchor long, part int, core long, again boolean, k long, first long, n int, left binary, right binary"), "suffix-parts")
    key = ["anchor", "part", "core"]
    whole_part = F.xxhash64("left", "right", F.col("n"))
    cores = parts.groupBy(*key).agg(F.count("*").alias("times"), F.min(whole_part).alias("x"), F.max(whole_part).alias("y")).where("times > 1").select(*key, (F.col("x") != F.col("y")).alias("mixed"))
    cores = common.written(cores, "suffix-cores")
    shared = common.written(parts.join(cores.hint("shuffle_merge"), key), "suffix-shared")
    common.forgotten(parts, cores)
    equal = shared.where("NOT mixed AND NOT again").select("k", F.struct(F.col("first").alias("a"), (F.col("first") + F.col("n") - 1 + LENGTH).alias("b")).alias("span"))
    size = F.length("left")
    i = F.col("i").cast("int")
    # windows of differing parts, by what they have besides the core: how much to the left, and the bytes
    edge = shared.where("mixed").select(*key, "again", "k", "first", "n", "left", "right", F.posexplode(F.sequence(F.lit(1), F.col("n"))).alias("i", "nth"))
    over = F.length("right") - (F.col("n") - 1 - i)
    edge = edge.select(*key, "again", "k", (F.col("first") + i).alias("first"), (size - i).alias("reach"), F.xxhash64(F.expr("substring(left, i + 1, length(left))"), F.expr("substring(right, 1, length(right) - (n - 1 - i))"), size - i, over).alias("w"))
    edge = common.written(edge, "suffix-edges")
    name = [*key, "reach", "w"]
    twice = common.written(edge.groupBy(*name).agg(F.count("*").alias("times"), F.max("again").alias("again")).where("times > 1 OR again").select(*name), "suffix-twice")
    found = edge.where("NOT again").join(twice.hint("shuffle_merge"), name)
    single = found.select("k", F.struct(F.col("first").alias("a"), (F.col("first") + LENGTH).alias("b")).alias("span"))
    return whole.unionByName(equal).unionByName(single).groupBy("k").agg(F.collect_list("span").alias("spans"))


def merged(spans: list) -> list[tuple[int, int]]:
    """Maximal runs of overlapping or touching ranges."""
    out: list[list[int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def _joined(docs: DataFrame, id_column: str, column: str) -> DataFrame:
    """The rows, their text compressed (tp_size, tp_z) and with its repeated ranges (tp_spans)."""
    rows = docs.withColumn("tp_k", F.xxhash64(F.col(id_column).cast("long"), F.coalesce(F.col(column), F.lit(""))))
    spans = repeated(rows.select(F.col("tp_k").alias("k"), F.coalesce(F.col(column), F.lit("")).alias("text")))
    others = [c for c in docs.columns if c != column]
    kind = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in others), "tp_k long, tp_size long, tp_z binary, tp_null boolean"])

    def run(batches):
        for b in batches:
            t = b.column(b.num_columns - 1)
            size = pa.array([x.as_buffer().size if x.is_valid else 0 for x in t], pa.int64())
            z = pa.array([pa.compress(x.as_buffer(), "zstd", asbytes=True) if x.is_valid else b"" for x in t], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], size, z, t.is_null()], names=[*others, "tp_k", "tp_size", "tp_z", "tp_null"])

    zipped = rows.select(*[F.col(f"`{c}`") for c in others], "tp_k", F.col(column)).mapInArrow(run, kind)
    return zipped.join(spans.select(F.col("k").alias("tp_k"), F.col("spans").alias("tp_spans")).hint("shuffle_merge"), "tp_k", "left").drop("tp_k")


def _kept(size: int, z: bytes, spans: list | None) -> tuple[bytes, int]:
    """What is left of a text, and the number of its removed runs."""
    text, at, left = _unzipped(size, z), 0, []
    cuts = merged(spans or [])
    for x, y in cuts:
        left.append(text[at:x])
        at = y
    left.append(text[at:])
    return b"".join(left), len(cuts)


def removed(docs: DataFrame, id_column: str = "doc_id", column: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document.

    Null texts are empty and texts below LENGTH bytes lose nothing; repeated rows lose all if they are longer.
    Strings are judged on the input. An empty table gives no rows. Other columns are not read.
    """
    common.small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(column).alias("text"))

    def run(batches):
        for b in batches:
            out = []
            for i, size, z, spans in zip(*(c.to_pylist() for c in b.columns), strict=True):
                kept, n = _kept(size, z, spans)
                out.append((i, size, size - len(kept), n, hashlib.sha256(kept).hexdigest()))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    out = _joined(rows, "doc_id", "text").select("doc_id", "tp_size", "tp_z", "tp_spans")
    return out.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def cleaned(docs: DataFrame, id_column: str = "doc_id", column: str = "text", count: str = "n_chars") -> DataFrame:
    """The rows of docs with the repeated passages cut out of the text (and parts of characters at the cuts); `count`, if there is such a column, follows the text. Null texts stay null."""
    common.small_batches(docs.sparkSession)
    rows = _joined(docs, id_column, column)
    names = docs.columns
    others = [c for c in names if c != column]

    def run(batches):
        for b in batches:
            size, z, null, spans = (b.column(len(others) + k).to_pylist() for k in range(4))
            text = [None if none else _kept(s, y, p)[0].decode("utf-8", "ignore") for s, y, none, p in zip(size, z, null, spans, strict=True)]
            by = dict(zip(others, b.columns, strict=False)) | {column: pa.array(text, pa.string())}
            if count in by and count != column:
                by[count] = pa.array([None if t is None else len(t) for t in text], by[count].type)
            yield pa.RecordBatch.from_arrays([by[c] for c in names], names=names)

    return rows.select(*[F.col(f"`{c}`") for c in others], "tp_size", "tp_z", "tp_null", "tp_spans").mapInArrow(run, docs.schema)
