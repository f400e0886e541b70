"""Packing of token streams into windows by order-preserving dynamic programming.

Documents keep their order.  A window may end at the end of a document, at the end of a
sentence, or, dearer, between two tokens of a long sentence; the cuts that cost least in
padding and truncation penalties follow from a recurrence over window ends whose minimum
over the last `size` tokens stands at the head of a monotone queue.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrapatch.llm import bpe, common, words

SIZE = 2048
#: Cost of a cut, in tokens of padding: at a document's end, at a sentence's, elsewhere; and of each window.
AT_DOCUMENT, AT_SENTENCE, ELSEWHERE, WINDOW = 0, 4, 24, 8
#: Within longer stretches without a sentence's end, every so many tokens may be cut too.
STRIDE = 32
#: Tokens that are planned together.
BLOCK = 1 << 18
#: The id that ends each document.
END = 1

_STOP = np.zeros(256, bool)
_STOP[[33, 46, 63]] = True


def normal(text: bytes) -> bytes:
    """The tokenizer's normal form but for white space, which its splitter drops: NFC, then each character in lower case."""
    s = text.decode()
    if not unicodedata.is_normalized("NFC", s):
        s = unicodedata.normalize("NFC", s)
    return s.replace("Σ", "σ").lower().encode()


def encoded(encoder: bpe.Encoder, data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, ids, positions after a sentence's end) of each segment of the texts, in order."""
    for rows, bounds, marks in bpe.segments(data, offs, encoder.vocab.special):
        part = data[bounds[0] : bounds[-1]]
        bounds = bounds - bounds[0]
        special = dict(marks)
        if len(part) and part.max() < 128:
            part = words.lowered(part)
        elif len(part):
            raw = part.tobytes()
            pieces = [raw[a:b] if k in special else normal(raw[a:b]) for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))]
            part = np.frombuffer(b"".join(pieces), np.uint8)
            bounds = np.concatenate([[0], np.cumsum([len(x) for x in pieces])])
        start, end = encoder.split(part, bounds)
        ids, counts = encoder.words(part, start, end)
        upto = np.concatenate([[0], np.cumsum(counts)])
        cut = upto[np.searchsorted(start, bounds)]
        stops = upto[1:][_STOP[part[end - 1]]] if len(start) else upto[:0]
        of = np.searchsorted(stops, cut, side="right")
        for k, row in enumerate(rows):
            if k in special:
                yield int(row), np.array([special[k]]), np.zeros(0, np.int64)
            else:
                yield int(row), ids[cut[k] : cut[k + 1]], stops[of[k] : of[k + 1]] - cut[k]


def candidates(ends: np.ndarray, stops: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which a window may end, and the cost of each."""
    cost = np.full(total + 1, -1, np.int16)
    cost[stops] = AT_SENTENCE
    cost[ends] = AT_DOCUMENT
    cost[0] = cost[total] = 0
    at = np.flatnonzero(cost >= 0)
    gap = np.diff(at)
    wide = np.flatnonzero(gap > 2 * STRIDE)
    if len(wide):
        n = (gap[wide] - 1) // STRIDE
        inner = np.repeat(at[wide], n) + STRIDE * (words.gathered(np.zeros(len(n), np.int64), n) + 1)
        inner = inner[cost[inner] < 0]
        cost[inner] = ELSEWHERE
        at = np.flatnonzero(cost >= 0)
    return at, cost[at].astype(np.int64)


def plan(at: np.ndarray, cost: np.ndarray, size: int = SIZE, last: bool = True) -> list[int]:
    """Ends of the windows of least cost over the stream [0, at[-1]); what follows the last of them is shorter than a window and stays for later. Neighbours in `at` are at most `size` apart."""
    pos, pay = at.tolist(), cost.tolist()
    best = [0] * len(pos)
    back = [0] * len(pos)
    queue: deque[int] = deque([0])
    value = [0] * len(pos)  # best + position, by which starts compare
    for j in range(1, len(pos)):
        p = pos[j]
        while pos[queue[0]] < p - size:
            queue.popleft()
        i = queue[0]
        back[j] = i
        best[j] = value[i] + size - p + pay[j] + WINDOW
        value[j] = v = best[j] + p
        while queue and value[queue[-1]] >= v:
            queue.pop()
        queue.append(j)
    # the end is open: the cheapest start of an unfinished window
    j = min((k for k in range(len(pos)) if pos[k] > pos[-1] - size), key=lambda k: (best[k], -pos[k]), default=0)
    out = []
    while j > 0:
        out.append(pos[j])
        j = back[j]
    return out[::-1]


def powers(start: int, end: int) -> list[int]:
    """Cuts of [start, end) into lengths that are powers of two, which need no padding."""
    out = []
    while start < end:
        start += 1 << ((end - start).bit_length() - 1)
        out.append(start)
    return out


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def packed(docs: DataFrame, vocab_path: str, size: int = SIZE, id_column: str = "doc_id", column: str = "text") -> DataFrame:
    """Pack all documents into windows of at most `size` ids; a row for each piece of a document in a window.

    Each input partition is packed on its own, in its order, so nothing is shuffled; a window's id holds the
    partition's number. Only the rest of a partition (less than a window) is cut into powers of two. A null or
    empty text has the end id alone. Repeated rows are packed each; other columns are not read; no rows, no pieces.
    """
    common.small_batches(docs.sparkSession)

    def run(batches):
        encoder = bpe.Encoder(bpe.vocabulary(vocab_path), None, words.split_lower)
        number = TaskContext.get().partitionId() << 33
        names: list = []  # of the documents in the stream: id, tokens before the stream, all tokens
        held: list[np.ndarray] = []
        ends: list[int] = []
        stops: list[np.ndarray] = []
        length = 0

        def flush(last: bool):
            nonlocal names, held, ends, stops, length, number
            ids = np.concatenate(held).astype("<u4") if held else np.zeros(0, "<u4")
            at, cost = candidates(np.array(ends, np.int64), np.concatenate(stops) if stops else np.zeros(0, np.int64), length)
            cuts = plan(at, cost, size)
            done = cuts[-1] if cuts else 0
            if last:
                cuts += powers(done, length)
                done = length
            edges = np.array(cuts, np.int64)
            tops = np.array(ends, np.int64)
            bounds = np.unique(np.concatenate([[0], edges, tops[tops < done]]))
            if done:
                a, b = bounds[:-1], bounds[1:]
                window = np.searchsorted(edges, a, side="right")
                begin = np.concatenate([[0], edges])[window]
                doc = np.searchsorted(tops, a, side="right")
                heads = np.concatenate([[0], tops])[doc]
                name, before, total = ([x[k] for x in names] for k in range(3))
                start = a - heads + np.array(before, np.int64)[doc]
                raw = memoryview(ids.tobytes())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([name[k] for k in doc], pa.int64()),
                        pa.array(start, pa.int64()),
                        pa.array(b - a, pa.int64()),
                        pa.array([zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(a.tolist(), b.tolist(), strict=True)], pa.int64()),
                        pa.array(np.array(total, np.int64)[doc]),
                        pa.array(window + number, pa.int64()),
                        pa.array(a - begin, pa.int64()),
                    ],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
                )
            number += len(cuts)
            first = int(np.searchsorted(tops, done, side="right"))
            if first < len(names):
                head = int(tops[first - 1]) if first else 0
                names[first] = (names[first][0], names[first][1] + done - head, names[first][2])
            names = names[first:]
            rest = np.concatenate(stops) if stops else np.zeros(0, np.int64)
            held, stops, ends = [ids[done:].astype(np.int64)], [rest[rest > done] - done], [x - done for x in ends[first:]]
            length -= done

        for batch in batches:
            data, offs = common.texts(batch, 1)
            keys = batch.column(0).to_pylist()
            row, parts, marks, size_ = -1, [], [], 0
            for k, ids, stop in [*encoded(encoder, data, offs), (len(keys), None, None)]:
                if k != row and row >= 0:
                    tokens = np.concatenate([*parts, [END]])
                    held.append(tokens)
                    stops += [m + length for m in marks]
                    length += len(tokens)
                    names.append((keys[row], 0, len(tokens)))
                    ends.append(length)
                    parts, marks, size_ = [], [], 0
                    if length >= BLOCK:
                        yield from flush(False)
                if ids is None:
                    break
                row = k
                parts.append(ids)
                marks.append(stop + size_)
                size_ += len(ids)
        yield from flush(True)

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(column)).mapInArrow(run, PIECE)
