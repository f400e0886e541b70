"""Language-model scores by a causal self-attention model on subword ids.

The model is trained in numpy: neighbours counted over the whole corpus give the classes of
tokens, a sample gives where the weights begin, then every partition trains on all of its
documents, and the weights are averaged by the tokens they have seen.  A token's
query looks back over a window of earlier tokens; what it gathers, with the token itself and
the one before, predicts the class of the next token, and counts over the whole corpus
predict the token within its class.  Texts are scored in windows that overlap: every token
is scored once, with at least half a window before it where the text has as much.

A word's probability is that of its subwords, mixed (if training has the word) with that of
its first subword times the word's share of all training words that begin so, and with its
relative frequency; the three weights are fitted by EM on all documents that the weights did
not begin with, by counts without the document itself, each word as the network saw it before
it trained on it.  Counts of frequent words are at hand; those of others come by a join, with
the logs that the mixture needs of each occurrence.
"""

from __future__ import annotations

import os
import pickle
import tempfile
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrapatch.llm import bpe, common, words

#: Training documents (of least hash of the id) and subwords of them that the network's weights begin with, at most.
SAMPLE_DOCS, SAMPLE_TOKENS = 3000, 800_000
#: Earlier tokens that are seen at least, and tokens that a window scores.
CONTEXT, SCORED = 32, 32
#: Sizes: attention, the token itself, the token before; classes of which SINGLE hold one token; tokens with an embedding of their own.
DA, DC, DP, SINGLE, OWN = 16, 16, 8, 448, 4096
#: The classes stand in groups: first the group is predicted, then the class in it.
GROUPS, MEMBERS = 24, 24
CLASSES = GROUPS * MEMBERS
EPOCHS, BATCH = 5, 64
#: Step of the pass over the training documents, one in SHARE by hash (1: all), and parts in which sums are made.
PASS_RATE, SHARE, PARTS = 0.004, 1, 64
#: Log ratios of a word's probabilities are counted in cells of this width, from -EDGE to EDGE.
CELL, EDGE = 0.25, 20.0
CELLS = int(2 * EDGE / CELL)
#: Distinct pairs of neighbours that a partition holds before it adds them up.
PAIRS = 4_000_000
#: Windows that are scored together.
TOGETHER = 128


class Encoded:
    """Distinct words of a chunk as subword ids: each word is encoded with a space before it, on its own."""

    def __init__(self, vocab: bpe.Vocabulary, part: np.ndarray, start: np.ndarray, end: np.ndarray, lexicon: bpe.Lexicon | None = None):
        head, self.name = words.distinct(part, start, end)
        self.start, self.size = start[head], (end - start)[head]
        bounds = np.concatenate([[0], np.cumsum(self.size + 1)])
        buf = np.full(int(bounds[-1]), 32, np.uint8)
        buf[words.gathered(bounds[:-1] + 1, self.size)] = part[words.gathered(self.start, self.size)]
        self.rank = lexicon.find(buf, bounds[:-1], bounds[1:]) if lexicon else np.full(len(head), -1, np.int64)
        # words that are not compiled
        rare = np.flatnonzero(self.rank < 0)
        length = self.size[rare] + 1
        edges = np.concatenate([[0], np.cumsum(length)])
        rest = buf[words.gathered(bounds[rare], length)]
        a, b = words.split_bytelevel(rest, edges)
        first, which = words.distinct(rest, a, b)
        ids, n = vocab.merge(rest, a[first], b[first])
        off = np.concatenate([[0], np.cumsum(n)])
        pieces = np.concatenate([[0], np.cumsum(n[which])])
        fresh = ids[words.gathered(off[which], n[which])]
        top = pieces[np.searchsorted(a, edges)]
        offs, count = np.empty(len(head), np.int64), np.empty(len(head), np.int64)
        offs[rare], count[rare] = top[:-1], np.diff(top)
        known = np.flatnonzero(self.rank >= 0)
        if len(known):
            r = self.rank[known]
            offs[known], count[known] = lexicon.offset[r] + len(fresh), lexicon.offset[r + 1] - lexicon.offset[r]
            fresh = np.concatenate([fresh, lexicon.ids])
        self.ids = fresh[words.gathered(offs, count)]
        self.off = np.concatenate([[0], np.cumsum(count)])
        self.buf, self.bounds = buf, bounds


class Model:
    """Parameters and the forward and backward passes; inputs are rows of `table` (own embedding or class)."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        r = lambda *s: rng.normal(0, 0.1, s).astype(np.float32)
        n = OWN + CLASSES
        self.p = {"q": r(n, DA), "k": r(n, DA), "v": r(n, DA), "c": r(n, DC), "l": r(n, DP), "g": r(DA + DC + DP + 1, GROUPS), "m": r(GROUPS, DA + DC + DP + 1, MEMBERS), "d": np.zeros(CONTEXT + SCORED, np.float32)}

    def bias(self, t: int, queries: int) -> np.ndarray:
        """What a query (one of the last of a window of t) adds for each distance; nothing that follows is seen."""
        dist = np.arange(t - queries, t)[:, None] - np.arange(t)[None, :]
        return np.where(dist >= 0, self.p["d"][np.maximum(dist, 0)], np.float32(-1e4))

    def attend(self, x: np.ndarray):
        """x: windows of inputs, each of which looks back (causally). Returns what each gathers, the sum of its weights, and (first query, behind the last, weights before they are divided by the sum) of the earlier and the later half of queries, which alone sees the later half of keys; and the parts."""
        t = x.shape[1]
        q, k = (self.p[name].take(x, 0) for name in "qk")
        v = np.concatenate([self.p["v"], np.ones((len(self.p["v"]), 1), self.p["v"].dtype)], 1).take(x, 0)  # the last column holds the sums
        bias, g, halves = self.bias(t, t), np.empty(v.shape, v.dtype), []
        for a, b in ((0, t // 2), (t // 2, t)):
            for clip in (False, True):
                s = np.matmul(q[:, a:b], k[:, :b].transpose(0, 2, 1))
                s += bias[a:b, :b]
                if clip:
                    np.minimum(s, 60, out=s)
                with np.errstate(over="ignore"):
                    np.exp(s, out=s)
                g[:, a:b] = np.matmul(s, v[:, :b])
                if a == b or g[:, a:b, -1].max() < np.exp(60):
                    break
            halves.append((a, b, s))
        return g[:, :, :-1] / g[:, :, -1:], g[:, :, -1:], halves, q, k, v

    def members(self, sorted_: np.ndarray, group: np.ndarray, out: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Where each group begins among rows in the order of their groups, and the logits of the group's classes."""
        edges = np.concatenate([[0], np.cumsum(np.bincount(group, minlength=GROUPS))]).tolist()
        z = np.empty((len(sorted_), MEMBERS), self.p["m"].dtype) if out is None else out[: len(sorted_)]
        for g in range(GROUPS):
            a, b = edges[g], edges[g + 1]
            if a < b:
                np.matmul(sorted_[a:b], self.p["m"][g], out=z[a:b])
        return edges, z

    def slopes(self, x: np.ndarray, before: np.ndarray, y: np.ndarray, logs: np.ndarray | None = None) -> tuple[float, dict, list]:
        """Loss and gradients over whole windows, of tables as (names, rows, gradients of these rows side by side); the log probability of each class is added to logs."""
        g, sums, halves, q, k, v = self.attend(x)
        n, kind = y.size, g.dtype
        group, member = np.divmod(y.ravel().astype(np.int32), MEMBERS)
        order = np.argsort(group.astype(np.uint8), kind="stable")
        h = np.empty((n, DA + DC + DP + 1), kind)
        h[:, :DA] = g.reshape(n, DA).take(order, 0)
        h[:, DA : DA + DC] = self.p["c"].take(x.ravel().take(order), 0)
        h[:, DA + DC : -1] = self.p["l"].take(before.ravel().take(order), 0)
        h[:, -1] = 1
        z = h @ self.p["g"]
        edges, y2 = self.members(h, group)
        loss, hits = 0.0, np.zeros(n)
        for part, goal in ((z, group), (y2, member)):
            high, low = part.max(), part.min()
            if high > 60 or low < -60:
                part -= part.max(1, keepdims=True) if high - low > 60 else high
            np.exp(part, out=part)
            part *= (1 / (n * (part @ np.ones(part.shape[1], kind))))[:, None]
            at = np.arange(0, part.size, part.shape[1]) + goal.take(order)
            own = part.ravel().take(at)
            hit = np.log(own * kind.type(n) + kind.type(1e-12))
            loss -= float(hit.mean())
            hits += hit
            part.ravel()[at] = own - kind.type(1 / n)
        if logs is not None:
            logs[order] += hits
        dense = {"g": h.T @ z, "m": np.zeros_like(self.p["m"])}
        dh = z @ self.p["g"][:-1].T
        for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            if a < b:
                np.matmul(h[a:b].T, y2[a:b], out=dense["m"][i])
                dh[a:b] += y2[a:b] @ self.p["m"][i, :-1].T
        back = np.empty(n, np.int64)
        back[order] = np.arange(n)
        dh = dh.take(back, 0).reshape(*x.shape, DA + DC + DP)
        # through the softmax of the attention: its sums divide once, in the last column stands what each row takes off
        da = np.empty(v.shape, kind)
        np.divide(dh[:, :, :DA], sums, out=da[:, :, :DA])
        da[:, :, DA] = -np.einsum("ijk,ijk->ij", da[:, :, :DA], g)
        d = np.zeros((*x.shape, 3 * DA + DC), kind)
        t = x.shape[1]
        total = np.zeros((t, t), kind)
        for a, b, s in halves:
            if a < b:
                d[:, :b, 2 * DA : 3 * DA] += np.matmul(s.transpose(0, 2, 1), da[:, a:b, :DA])
                s *= np.matmul(da[:, a:b], v[:, :b].transpose(0, 2, 1))
                np.matmul(s, k[:, :b], out=d[:, a:b, :DA])
                d[:, :b, DA : 2 * DA] += np.matmul(s.transpose(0, 2, 1), q[:, a:b])
                total[a:b, :b] = (np.ones(len(s), kind) @ s.reshape(len(s), -1)).reshape(b - a, b)
        d[:, :, 3 * DA :] = dh[:, :, DA : DA + DC]
        dist = np.arange(t)[:, None] - np.arange(t)[None, :]
        dense["d"] = np.bincount(np.maximum(dist, 0).ravel(), np.where(dist >= 0, total, 0).ravel(), CONTEXT + SCORED).astype(kind)
        tables = []
        for names, at, e in (("qkvc", x, d), ("l", before, dh[:, :, DA + DC :])):
            row = at.ravel().astype(np.uint16)
            order = np.argsort(row, kind="stable")
            row = row.take(order)
            first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            pairs = e.reshape(n, -1).take(order, 0).view(np.result_type(kind, np.complex64))  # two columns in one sum
            tables.append((names, row[first].astype(np.int64), np.add.reduceat(pairs, first).view(kind)))
        return loss, dense, tables

    def step(self, x: np.ndarray, before: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Loss and gradients over whole windows."""
        loss, grad, tables = self.slopes(x, before, y)
        for names, rows, total in tables:
            for name, part in zip(names, np.split(total, np.cumsum([self.p[x].shape[1] for x in names])[:-1], 1), strict=True):
                grad[name] = np.zeros_like(self.p[name])
                grad[name][rows] = part
        return loss, grad


class Adam:
    """Steps down the gradient of a model. A row of a table that a step's windows do not hold waits: what its means would have moved it by meanwhile is made up for when it is met again, or by settle()."""

    #: What is left of the means after as many steps, and what all steps until then have moved a row that waits, in units of the last one.
    LEFT = tuple(np.power(share, np.arange(4096)).astype(np.float32) for share in (0.9, 0.99))
    LATE = np.concatenate([[0, 0], np.cumsum(np.power(0.9 / 0.99**0.5, np.arange(1, 4095)))]).astype(np.float32)

    def __init__(self, model: Model):
        self.model, self.t, self.rate = model, 0, 0.0
        self.mean = {k: np.zeros((2, *model.p[k].shape), np.float32) for k in "gmd"}
        self.mean |= {names: np.zeros((2, len(model.p[names[0]]), sum(model.p[k].shape[1] for k in names)), np.float32) for names in ("qkvc", "l")}
        self.met = {names: np.zeros(len(self.mean[names][0]), np.int64) for names in ("qkvc", "l")}

    def step(self, rate: float, x: np.ndarray, before: np.ndarray, y: np.ndarray, logs: np.ndarray | None = None) -> None:
        _, dense, tables = self.model.slopes(x, before, y, logs)
        self.t += 1
        rate *= min(1.0, self.t / 20)
        self.rate = np.float32(rate * np.sqrt(1 - 0.99**self.t) / (1 - 0.9**self.t))
        for k, g in dense.items():
            m1, m2 = self.mean[k]
            m1 *= np.float32(0.9)
            m2 *= np.float32(0.99)
            self.model.p[k] -= self.moved(g, m1, m2)
        for names, rows, g in tables:
            change, m1, m2 = self.late(names, rows)
            change += self.moved(g, m1, m2)
            self.mean[names][0, rows], self.mean[names][1, rows] = m1, m2
            self.move(names, rows, change)

    def late(self, names: str, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What these rows have not moved by since they were met, and their means by now."""
        gap = np.minimum(self.t - self.met[names][rows], 4095)[:, None]
        self.met[names][rows] = self.t
        m1, m2 = (m.take(rows, 0) for m in self.mean[names])
        change = np.sqrt(m2)
        change += np.float32(1e-8)
        np.divide(m1, change, out=change)
        change *= self.LATE[gap] * self.rate
        m1 *= self.LEFT[0][gap]
        m2 *= self.LEFT[1][gap]
        return change, m1, m2

    def move(self, names: str, rows: np.ndarray, change: np.ndarray) -> None:
        at = 0
        for k in names:
            width = self.model.p[k].shape[1]
            self.model.p[k][rows] -= change[:, at : at + width]
            at += width

    def settle(self) -> None:
        """Move every row by what it waits for; no step follows."""
        self.t += 1
        for names, met in self.met.items():
            rows = np.arange(len(met))
            self.move(names, rows, self.late(names, rows)[0])

    def moved(self, g: np.ndarray, m1: np.ndarray, m2: np.ndarray) -> np.ndarray:
        """The change that takes the place of the gradient g, which enters the means."""
        m1 += np.float32(0.1) * g
        np.multiply(g, g, out=g)
        m2 += np.float32(0.01) * g
        np.sqrt(m2, out=g)
        g += np.float32(1e-8)
        np.divide(m1, g, out=g)
        g *= self.rate
        return g


def inputs(ids: np.ndarray, bounds: np.ndarray, table: np.ndarray, cls: np.ndarray, last: int) -> np.ndarray:
    """(3, n): the input of each id, that before it, and the id's class."""
    x = table[np.concatenate([[last], ids[:-1]])]
    heads = bounds[:-1][bounds[:-1] < bounds[1:]]
    x[heads] = table[last]
    before = np.concatenate([x[:1], x[:-1]])
    before[heads] = table[last]
    return np.stack([x, before, cls[ids]])


def training(scorer: Scorer, streams):
    """Train the scorer's model in place, once over streams (3, n) of inputs, all of them; yields the log probabilities of the ids' classes, in order, each as it was before the step that it takes part in."""
    adam, width = Adam(scorer.model), CONTEXT + SCORED
    rest = np.zeros((3, 0), np.int64)
    for stream in streams:
        rest = np.concatenate([rest, stream], 1)
        many = rest.shape[1] // (width * BATCH)
        for part in np.split(rest[:, : many * width * BATCH], many, 1) if many else ():
            logs = np.zeros(part.shape[1])
            adam.step(PASS_RATE, *part.reshape(3, BATCH, width), logs)
            yield logs
        rest = rest[:, many * width * BATCH :]
    cut = rest.shape[1] // width * width
    for part in (rest[:, :cut].reshape(3, -1, width), rest[:, None, cut:]):
        if part.size:
            logs = np.zeros(part[0].size)
            adam.step(PASS_RATE * part[0].size / (width * BATCH), *part, logs)
            yield logs
    adam.settle()


def trained_on(scorer: Scorer, streams) -> int:
    """training() to its end; returns the number of ids."""
    return sum(len(logs) for logs in training(scorer, streams))


def cell_of(whole: np.ndarray, first: np.ndarray, c: np.ndarray, n: int) -> np.ndarray:
    """Cell of each word by the log ratios of its second and third probability to the first. whole: log probability of its subwords; first: of the first one, less the log of heads; c: the word's count, or 0."""
    log = np.log(np.maximum(c, 1))
    i, j = (np.clip(np.floor((x - whole + EDGE) / CELL), 0, CELLS - 1).astype(np.int64) for x in (first + log, log - np.log(max(n, 1))))
    return np.where(c > 0, i * CELLS + j, 0)


def fitted(cells: np.ndarray) -> np.ndarray:
    """Weights of the mixture by EM, from the number of words in each cell."""
    weights = np.array([0.5, 0.3, 0.2])
    at = np.flatnonzero(cells)
    if not len(at):
        return weights
    many = cells[at] / cells.sum()
    parts = np.exp(np.stack([np.zeros(len(at)), *((x + 0.5) * CELL - EDGE for x in np.divmod(at, CELLS))], 1))
    for _ in range(40):
        share = parts * weights
        weights = np.clip(many @ (share / share.sum(1, keepdims=True)), 0.01, 1)
        weights /= weights.sum()
    return weights


def sliced(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    """Slices of data as an array of bytes."""
    raw = data[words.gathered(start, size)]
    return pa.BinaryArray.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int32).tobytes()), pa.py_buffer(raw.tobytes())])


def spelled(e: Encoded, w: np.ndarray) -> pa.Array:
    """The words of these numbers, as bytes."""
    return sliced(e.buf, e.bounds[w] + 1, e.size[w])


def added(batches):
    """Rows (part, n, sums) with the sums of each part added up."""
    total: dict = {}
    for batch in batches:
        for part, n, sums in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            old = total.get(part, (0, 0.0))
            total[part] = (old[0] + n, old[1] + np.frombuffer(sums))
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array([n for n, _ in total.values()]), pa.array([x.tobytes() for _, x in total.values()], pa.binary())], names=["part", "n", "sums"])


def passed(train: DataFrame, name: str, vocab_path: str, scorer: Scorer, counts: DataFrame, cells: np.ndarray) -> None:
    """Put into the scorer the average of its model as trained by each partition of (text, fresh) on its documents; the words of fresh ones are counted in cells.

    The model to begin with, the lexicon and its counts are files of the session. A word's count is without its
    occurrences in the text itself (of a text above CHUNK_BYTES: in the same part of it).
    """
    kind = pa.schema([("part", pa.int64()), ("n", pa.int64()), ("sums", pa.binary()), ("word", pa.binary()), ("whole", pa.float32()), ("first", pa.float32()), ("own", pa.int64())])

    def run(batches):
        vocab, lexicon = bpe.vocabulary(vocab_path), bpe.Lexicon(SparkFiles.get(f"{name}.words"))
        with open(SparkFiles.get(f"{name}.first"), "rb") as f:
            mine, last, freq, heads, ends, total = pickle.load(f)  # noqa: S301 - a file of this run
        waiting, sure = deque(), np.zeros(CELLS * CELLS)

        def streams():
            for batch in batches:
                data, offs = common.texts(batch, 0)
                fresh = batch.column(1).to_numpy(False)
                for rows, e, name_, ids, edge, top in sequences(vocab, data, offs, last, lexicon):
                    if len(ids):
                        waiting.append((fresh[rows], e, name_, ids, edge, top))
                        yield inputs(ids, edge[top], mine.table, mine.cls, last)

        def counted(logs, fresh, e, name_, ids, edge, top):
            """Count the words whose counts are at hand; a batch of the others."""
            seg = np.repeat(np.arange(len(top) - 1), np.diff(top))
            _, same, times = np.unique(seg * (len(e.size) + 1) + name_, return_inverse=True, return_counts=True)
            own, head = times[same], edge[:-1]
            logs = logs + mine.inner[ids]
            whole, first = np.add.reduceat(logs, head), logs[head] - np.log(np.maximum(heads[ids[head]], 1))
            c = np.append(np.where(e.rank >= 0, freq[np.maximum(e.rank, 0)] if len(freq) else 0, 0), ends)[name_]
            rare = np.append(e.rank < 0, False)[name_]
            at = np.flatnonzero(fresh[seg] & ~rare)
            sure[:] += np.bincount(cell_of(whole[at], first[at], (c - own)[at], total), minlength=len(sure))
            at = np.flatnonzero(fresh[seg] & rare)
            none = pa.nulls(len(at), pa.int64())
            return pa.RecordBatch.from_arrays([none, none, pa.nulls(len(at), pa.binary()), spelled(e, name_[at]), pa.array(whole[at].astype(np.float32)), pa.array(first[at].astype(np.float32)), pa.array(own[at])], schema=kind)

        n, heard, size = 0, [], 0
        for logs in training(mine, streams()):
            heard.append(logs)
            size += len(logs)
            n += len(logs)
            while waiting and size >= len(waiting[0][3]):
                chunk, logs = waiting.popleft(), np.concatenate(heard)
                heard, size = [logs[len(chunk[3]) :]], size - len(chunk[3])
                yield counted(logs[: len(chunk[3])], *chunk)
        if n:
            flat = np.array_split(np.concatenate([v.ravel() for v in mine.model.p.values()]).astype(np.float64) * n, PARTS)
            sums = [x.tobytes() for x in (*flat, sure)]
            none = pa.nulls(len(sums), pa.float32())
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums))), pa.array(np.full(len(sums), n)), pa.array(sums, pa.binary()), pa.nulls(len(sums), pa.binary()), none, none, pa.nulls(len(sums), pa.int64())], schema=kind)

    out = common.written(train.mapInArrow(run, "part long, n long, sums binary, word binary, whole float, first float, own long"), "lm-pass")
    found = out.where("part IS NOT NULL").select("part", "n", "sums").repartition(PARTS, "part").mapInArrow(added, "part long, n long, sums binary").collect()  # one model's size, and the cells
    if not found:
        return
    *found, last = sorted(found, key=lambda r: r["part"])
    flat, at = np.concatenate([np.frombuffer(r["sums"]) / r["n"] for r in found]), 0
    for k, v in scorer.model.p.items():
        scorer.model.p[k] = flat[at : at + v.size].reshape(v.shape).astype(np.float32)
        at += v.size
    cells += np.frombuffer(last["sums"])
    # the same cells of the words whose counts come by a join
    rare = out.where("word IS NOT NULL").select("word", "whole", "first", "own").join(counts.withColumnRenamed("n", "all").hint("shuffle_merge"), "word")
    c = F.col("all") - F.col("own")
    n = counts.agg(F.sum("n")).first()[0]
    i, j = (F.greatest(F.lit(0), F.least(F.lit(CELLS - 1), F.floor((x - F.col("whole").cast("double") + EDGE) / CELL))) for x in (F.col("first").cast("double") + F.log(c.cast("double")), F.log(c / F.lit(float(n)))))
    for r in rare.groupBy(F.when(c > 0, i * CELLS + j).otherwise(0).alias("cell")).agg(F.count("*").alias("n")).collect():  # CELLS squared at most
        cells[r["cell"]] += r["n"]
    common.forgotten(out)


def ranked(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids by falling count, and the rank of each if among the SINGLE first, else -1."""
    order = np.argsort(-counts, kind="stable")
    rank = np.full(len(counts), -1, np.int64)
    rank[order[:SINGLE]] = np.arange(len(order[:SINGLE]))
    return order, rank


def neighbours(ids: np.ndarray, before: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """A key for each frequent token next to a token: id * 2 * SINGLE + rank, plus SINGLE if the frequent one stands after it."""
    a, b = np.flatnonzero(rank[before] >= 0), np.flatnonzero(rank[ids] >= 0)
    return np.concatenate([ids[a] * (2 * SINGLE) + rank[before[a]], before[b] * (2 * SINGLE) + SINGLE + rank[ids[b]]])


def summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their numbers."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(n[order], first) if len(key) else n


def neighbour_counts(train: DataFrame, name: str, vocab_path: str, rank: np.ndarray, last: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of neighbours() over all texts and how often each occurs; their number is bounded by the vocabulary."""

    def run(batches):
        vocab, lexicon = bpe.vocabulary(vocab_path), bpe.Lexicon(SparkFiles.get(f"{name}.words"))
        key, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        fresh, size = [], 0

        def merged():
            each = [np.unique(x, return_counts=True) for x in fresh]
            return summed(np.concatenate([key, *(k for k, _ in each)]), np.concatenate([n, *(c for _, c in each)]))

        for batch in batches:
            data, offs = common.texts(batch, 0)
            row, tail = -1, last
            for rows, _, _, ids, edge, top in sequences(vocab, data, offs, last, lexicon):
                if len(ids):
                    before = np.concatenate([[last], ids[:-1]])
                    tops = edge[top]
                    before[tops[:-1][tops[:-1] < tops[1:]]] = last
                    if rows[0] == row:  # the text goes on
                        before[0] = tail
                    row, tail = int(rows[-1]), int(ids[-1])
                    fresh.append(neighbours(ids, before, rank))
                    size += len(fresh[-1])
                if size > PAIRS:
                    key, n = merged()
                    fresh, size = [], 0
        key, n = merged()
        part = key // (2 * SINGLE) % PARTS
        order = np.argsort(part, kind="stable")
        edges = np.searchsorted(part[order], np.arange(PARTS + 1))
        cuts = [order[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(PARTS)), pa.array([key[x].tobytes() for x in cuts], pa.binary()), pa.array([n[x].tobytes() for x in cuts], pa.binary())], names=["part", "keys", "n"])

    def together(batches):
        found: dict = {}
        for batch in batches:
            for part, keys, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                new = np.frombuffer(keys, np.int64), np.frombuffer(n, np.int64)
                found[part] = summed(*(np.concatenate(x) for x in zip(found[part], new, strict=True))) if part in found else new
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(list(found)), pa.array([k.tobytes() for k, _ in found.values()], pa.binary()), pa.array([c.tobytes() for _, c in found.values()], pa.binary())], names=["part", "keys", "n"])

    kind = "part long, keys binary, n binary"
    rows = train.mapInArrow(run, kind).repartition(PARTS, "part").mapInArrow(together, kind).toLocalIterator()
    found = [(np.frombuffer(r["keys"], np.int64).astype(np.int32 if len(rank) * 2 * SINGLE < 2**31 else np.int64), np.frombuffer(r["n"], np.int64).astype(np.float32)) for r in rows]
    if not found:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def classified(pairs: tuple[np.ndarray, np.ndarray], counts: np.ndarray) -> np.ndarray:
    """Class of each token id: frequent ones have their own, others share one with tokens that follow alike. pairs: keys of neighbours() and their numbers; counts: of each id."""
    order, rank = ranked(counts)
    out = np.zeros(len(counts), np.int64)
    out[order[:SINGLE]] = np.arange(SINGLE)
    rest = order[SINGLE:]
    key, n = pairs
    own, col = np.divmod(key, 2 * SINGLE)
    # of the rest that occur: how often each frequent token stands before and after them, as roots on the sphere
    spot = np.full(len(counts), -1, np.int64)
    spot[rest] = np.arange(len(rest))
    at = np.flatnonzero(rank[own] < 0)
    at = at[np.argsort(spot[own[at]], kind="stable")]
    known, row = np.unique(spot[own[at]], return_inverse=True)
    f_col, f = col[at], np.sqrt(n[at] / np.bincount(row, n[at], len(known))[row]).astype(np.float32)
    group = np.arange(len(rest)) % (CLASSES - SINGLE)
    if len(known) > CLASSES:
        top = np.searchsorted(row, np.arange(len(known) + 1))

        def dense(a: int, b: int) -> np.ndarray:
            held = np.zeros((b - a, 2 * SINGLE), np.float32)
            held[row[top[a] : top[b]] - a, f_col[top[a] : top[b]]] = f[top[a] : top[b]]
            return held

        centre = dense(0, CLASSES - SINGLE)
        for _ in range(8):  # k-means on the sphere
            near = np.concatenate([np.argmax(dense(a, min(a + 4096, len(known))) @ centre.T, 1) for a in range(0, len(known), 4096)])
            centre = np.bincount(near[row] * (2 * SINGLE) + f_col, f, centre.size).reshape(centre.shape).astype(np.float32)
            centre /= np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-9)
        group[known] = near
    out[rest] = SINGLE + group
    # classes that neighbour alike stand in a group: along the main axis of their neighbours
    profile = np.bincount(out[own] * (2 * SINGLE) + col, n, CLASSES * 2 * SINGLE).reshape(CLASSES, 2 * SINGLE)
    profile = np.sqrt(profile / np.maximum(profile.sum(1, keepdims=True), 1)).astype(np.float32)
    profile -= profile.mean(0)
    axis = np.random.default_rng(3).normal(size=profile.shape[1]).astype(np.float32)
    for _ in range(20):
        axis = profile.T @ (profile @ axis)
        axis /= max(float(np.linalg.norm(axis)), 1e-12)
    place = np.empty(CLASSES, np.int64)
    place[np.argsort(profile @ axis, kind="stable")] = np.arange(CLASSES)
    return place[out]


def _chosen(z: np.ndarray, goal: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Log softmax of the chosen column of each row."""
    hit = z.ravel().take(row * z.shape[1] + goal)
    total = np.exp(z) @ np.ones(z.shape[1], np.float32)
    if not np.isfinite(total).all() or total.min() <= 0:  # beyond single precision
        top = z.max(1).astype(np.float64)
        return (hit - top - np.log(np.exp(z.astype(np.float64) - top[:, None]).sum(1))).astype(np.float32)
    return hit - np.log(total)


class Scorer:
    """A trained model with the corpus' counts; scores subword sequences."""

    def __init__(self, model: Model, cls: np.ndarray, inner: np.ndarray, table: np.ndarray):
        self.model, self.cls, self.inner, self.table = model, cls, inner, table

    def logs(self, ids: np.ndarray, bounds: np.ndarray, last: int, lead: np.ndarray | None = None) -> np.ndarray:
        """Natural log probability of each id; the sequences that bounds delimits begin after the id `last`, the first one after the ids `lead` if there are any."""
        if lead is not None and len(lead):
            return self.logs(np.concatenate([lead, ids]), np.concatenate([[0], bounds[1:] + len(lead)]), last)[len(lead) :]
        n = len(ids)
        if not n:
            return np.zeros(0, np.float32)
        x = self.table[np.concatenate([[last], ids[:-1]])]
        start = np.zeros(n, bool)
        heads = bounds[:-1][bounds[:-1] < bounds[1:]]
        x[heads] = self.table[last]
        before = np.concatenate([x[:1], x[:-1]])
        before[heads] = self.table[last]
        start[heads] = True
        size = np.diff(np.append(heads, n))
        blocks = -(-size // SCORED)
        first = words.gathered(np.zeros(len(blocks), np.int64), blocks) * SCORED + np.repeat(heads, blocks)
        low, high = np.repeat(heads, blocks), np.repeat(heads + size, blocks)
        out = np.empty(n, np.float32)
        goal = self.cls[ids].astype(np.int32)
        p = self.model.p
        keys, values = p["k"], np.concatenate([p["v"], np.ones((len(p["v"]), 1), np.float32)], 1)
        bias = self.model.bias(CONTEXT + SCORED, SCORED)
        norms = (float(np.sqrt((p[name] ** 2).sum(1).max())) for name in "qk")
        tame = np.prod(list(norms)) + float(p["d"].max()) < 60
        h = np.ones((TOGETHER * SCORED, DA + DC + DP + 1), np.float32)
        space = np.empty((TOGETHER * SCORED, MEMBERS), np.float32)
        row, steps = np.arange(TOGETHER * SCORED), np.arange(-CONTEXT, SCORED)
        # windows that lie within their text need no masks
        inner = (first - CONTEXT >= low) & (first + SCORED <= high)
        for whole, which in ((True, np.flatnonzero(inner)), (False, np.flatnonzero(~inner))):
            for a in range(0, len(which), TOGETHER):
                w = which[a : a + TOGETHER]
                at = first[w][:, None] + steps
                if not whole:
                    valid = (at >= low[w][:, None]) & (at < high[w][:, None])
                    at = np.minimum(np.maximum(at, 0), n - 1)
                own, m = at[:, CONTEXT:].ravel(), len(w) * SCORED
                inside = x.take(at)
                ask = inside[:, CONTEXT:]
                s = np.matmul(p["q"].take(ask, 0), keys.take(inside, 0).transpose(0, 2, 1))
                s += bias
                if not whole:
                    s += np.where(valid, np.float32(0), np.float32(-1e4))[:, None, :]
                if not tame:
                    np.minimum(s, 60, out=s)
                np.exp(s, out=s)
                g = np.matmul(s, values.take(inside, 0))  # the last column holds the sums
                group, member = np.divmod(goal.take(own), MEMBERS)
                order = np.argsort(group.astype(np.uint8), kind="stable")  # rows stand in the order of their groups
                g = g.reshape(m, DA + 1).take(order, 0)
                np.divide(g[:, :DA], g[:, DA:], out=h[:m, :DA])
                h[:m, DA : DA + DC] = p["c"].take(ask.ravel().take(order), 0)
                own = own.take(order)
                h[:m, DA + DC : -1] = p["l"].take(before.take(own), 0)
                z = self.model.members(h[:m], group, space)[1]
                log = _chosen(h[:m] @ p["g"], group.take(order), row[:m])
                log += _chosen(z, member.take(order), row[:m])
                if whole:
                    out[own] = log
                else:
                    use = valid[:, CONTEXT:].ravel().take(order)
                    out[own[use]] = log[use]
        return out + self.inner[ids]


def trained(ids: np.ndarray, bounds: np.ndarray, size: int, counts: np.ndarray, last: int, pairs: tuple[np.ndarray, np.ndarray] | None = None) -> Scorer:
    """Train on the sequences of a sample; counts: of each id over the whole training corpus; pairs: of neighbours there, else of the sample."""
    order, rank = ranked(counts)
    if pairs is None:
        pairs = np.unique(neighbours(ids, np.concatenate([[last], ids[:-1]]), rank), return_counts=True) if len(ids) else (np.zeros(0, np.int64), np.zeros(0))
    cls = classified(pairs, counts)
    mass = np.bincount(cls, counts + 1.0, CLASSES)
    inner = np.log((counts + 1.0) / mass[cls]).astype(np.float32)
    table = OWN + cls
    table[order[:OWN]] = np.arange(len(order[:OWN]))
    model = Model()
    width = CONTEXT + SCORED
    starts = np.arange(0, max(len(ids) - width, 0) + 1, width)
    if not len(ids) or len(ids) < width:
        return Scorer(model, cls, inner, table)
    x, before, y = inputs(ids, bounds, table, cls, last)
    rng = np.random.default_rng(11)
    adam = Adam(model)
    total = max(EPOCHS * -(-len(starts) // BATCH), 1)
    for _ in range(EPOCHS):
        rng.shuffle(starts)
        for a in range(0, len(starts), BATCH):
            at = np.minimum(starts[a : a + BATCH, None] + np.arange(width), len(ids) - 1)
            adam.step(0.02 * (1 - 0.9 * (adam.t + 1) / total), x[at], before[at], y[at])
    adam.settle()
    return Scorer(model, cls, inner, table)


def mixture(logs: np.ndarray, edge: np.ndarray, c: np.ndarray, heads: np.ndarray, n: int) -> np.ndarray:
    """Log probabilities of words (rows) by the three models. logs: of their subwords; c: the word's count, or 0; heads: count of words with its first subword."""
    logs = logs.astype(np.float64)
    out = np.full((len(c), 3), -700.0)
    out[:, 0] = np.add.reduceat(logs, edge[:-1])
    some = c > 0
    out[some, 1] = logs[edge[:-1][some]] + np.log(c[some] / heads[some])
    out[some, 2] = np.log(c[some] / n)
    return out


def gathered_batches(batches, rows: int):
    """Batches of about so many rows, from smaller ones."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def token_counts(counts: DataFrame, vocab_path: str) -> DataFrame:
    """(id, n, heads): occurrences of subword ids, and of words that begin with them, from those of words."""

    def run(batches):
        vocab = bpe.vocabulary(vocab_path)
        total, heads = np.zeros(vocab.size, np.int64), np.zeros(vocab.size, np.int64)
        for b in gathered_batches(batches, 50_000):
            data, offs = common.texts(b, 0)
            n = b.column(1).to_numpy(False)
            e = Encoded(vocab, data, offs[:-1], offs[1:])
            each = np.bincount(e.name, n, len(e.off) - 1).astype(np.int64)
            np.add.at(total, e.ids, np.repeat(each, np.diff(e.off)))
            np.add.at(heads, e.ids[e.off[:-1]], each)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at]), pa.array(heads[at])], names=["id", "n", "heads"])

    return counts.select("word", "n").mapInArrow(run, "id long, n long, heads long").groupBy("id").agg(F.sum("n").alias("n"), F.sum("heads").alias("heads"))


def word_counts(docs: DataFrame, column: str = "text", keep: int = 400_000) -> DataFrame:
    """(word, n) over all texts, in lower case; the empty word stands for the end of a text."""

    def count(batches):
        held, size, ends = [], 0, 0

        def together():
            return pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum")]).select(["word", "n_sum"]).rename_columns(["word", "n"])

        for batch in batches:
            data, offs = common.texts(batch, 0)
            ends += len(offs) - 1
            for _, bounds in common.pieces(data, offs):
                part = words.lowered(data[bounds[0] : bounds[-1]])
                start, end, _ = words.split_blank(part, bounds)
                head, name = words.distinct(part, start, end)
                held.append(pa.table({"word": sliced(part, start[head], (end - start)[head]), "n": np.bincount(name, minlength=len(head))}))
                size += max(len(head), held[-1].nbytes // 64)
                if size > 2 * keep:
                    held = [together()]
                    size = max(len(held[0]), held[0].nbytes // 64)
                    if size > keep:
                        yield from held[0].to_batches()
                        held, size = [], 0
        held.append(pa.table({"word": pa.array([b""], pa.binary()), "n": [ends]}))
        yield from together().to_batches()

    return docs.select(column).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 0")


def sequences(vocab: bpe.Vocabulary, data: np.ndarray, offs: np.ndarray, last: int, lexicon: bpe.Lexicon | None = None):
    """Chunks of texts: (rows, words' segment, encoded words, ids, bounds of words in ids, bounds of segments in words, whether each segment ends its text)."""
    for rows, bounds in common.pieces(data, offs):
        part = words.lowered(data[bounds[0] : bounds[-1]])
        start, end, seg = words.split_blank(part, bounds)
        e = Encoded(vocab, part, start, end, lexicon)
        ends = bounds[1:] >= offs[rows + 1]
        # the words of each segment, and the end of the text after them as one more
        count = np.bincount(seg, minlength=len(rows))
        size = count + ends
        top = np.concatenate([[0], np.cumsum(size)])
        name = np.full(int(top[-1]), len(e.size), np.int64)
        name[words.gathered(top[:-1], count)] = e.name
        off, length = np.append(e.off[:-1], len(e.ids)), np.append(np.diff(e.off), 1)
        ids = np.append(e.ids, last)[words.gathered(off[name], length[name])]
        yield rows, e, name, ids, np.concatenate([[0], np.cumsum(length[name])]), top


def learned(train: DataFrame, counts: DataFrame, vocab_path: str, n: int, id_column: str, column: str) -> str:
    """Train on all texts, from where a sample lets the weights begin, and compile the frequent words with their counts; returns the name of the file that holds all."""
    spark = train.sparkSession
    vocab = bpe.vocabulary(vocab_path)
    last = max(vocab.special.values(), default=vocab.size - 1)
    frequent = counts.where(F.col("n") >= F.lit(max(2, n * bpe.SHARE / 2))).where(F.length("word") < bpe.LONGEST).toPandas()
    found = sorted(zip((bytes(w) for w in frequent["word"]), frequent["n"].tolist(), strict=True))
    found = [(w, c) for w, c in found if w]
    tokens, heads = np.zeros(vocab.size, np.int64), np.zeros(vocab.size, np.int64)
    for r in token_counts(counts.where(F.length("word") > 0), vocab_path).collect():  # an entry of the vocabulary each
        tokens[r["id"]], heads[r["id"]] = r["n"], r["heads"]
    end = counts.where(F.length("word") == 0).first()
    ends = int(end["n"]) if end else 0
    tokens[last] = heads[last] = ends
    folder = tempfile.mkdtemp(prefix="lm-")
    name = f"lm-{os.urandom(8).hex()}"
    bpe.compile_lexicon([b" " + w for w, _ in found], vocab, f"{folder}/{name}.words")
    spark.sparkContext.addFile(f"{folder}/{name}.words")
    pairs = neighbour_counts(train.select(column), name, vocab_path, ranked(tokens)[1], last)
    # where the network begins: the first documents by hash, but for a tenth
    sample = train.select(column, F.xxhash64(F.col(id_column).cast("string")).alias("h"), F.xxhash64(id_column, column).alias("own")).orderBy("h", F.length(column)).limit(SAMPLE_DOCS)
    kept, tops, names, total = [], [0], [], 0
    for r in sample.select(column, "own").toLocalIterator():
        if total >= SAMPLE_TOKENS:
            break
        data = np.frombuffer((r[0] or "").encode(), np.uint8)
        for _, _, _, ids, _, _ in sequences(vocab, data, np.array([0, len(data)]), last):
            kept.append(ids)
            total += len(ids)
        names.append(r[1])
        tops.append(total)
    ids, tops = np.concatenate(kept) if kept else np.zeros(0, np.int64), np.array(tops, np.int64)
    cut = int(0.9 * total)
    scorer = trained(ids[:cut], np.append(tops[tops < cut], cut), vocab.size, tokens, last, pairs)
    begun = [h for h, top in zip(names, tops[:-1].tolist(), strict=True) if top < cut]
    freq = np.array([c for _, c in found], np.int64)
    with open(f"{folder}/{name}.first", "wb") as f:
        pickle.dump((scorer, last, freq, heads, ends, n), f)
    spark.sparkContext.addFile(f"{folder}/{name}.first")
    own = F.xxhash64(id_column, column)
    cells = np.zeros(CELLS * CELLS)
    passed(train.where(F.pmod(own, F.lit(SHARE)) == 0).select(column, (~own.isin(begun)).alias("fresh")), name, vocab_path, scorer, counts, cells)
    weights = fitted(cells)
    with open(f"{folder}/{name}.model", "wb") as f:
        pickle.dump((scorer, freq, heads, ends, weights, last), f)
    spark.sparkContext.addFile(f"{folder}/{name}.model")
    return name


_loaded: dict = {}


def _load(name: str):
    if name not in _loaded:
        _loaded.clear()
        with open(SparkFiles.get(f"{name}.model"), "rb") as f:
            _loaded[name] = (bpe.Lexicon(SparkFiles.get(f"{name}.words")), *pickle.load(f))  # noqa: S301 - a file of this run
    return _loaded[name]


def scored(docs: DataFrame, vocab_path: str, train=None, id_column: str = "doc_id", column: str = "text") -> DataFrame:
    """Scores of all texts by a model learned from those where the condition `train` holds (all, if none is given).

    doc_id, n_tokens (words and one end), n_known (those that occur in training), train_tokens, base_score (add-one
    unigram), score (the model's log10 probability). Null texts are empty: an end alone. Repeated rows are scored
    each. Without training rows all counts are zero. Texts above CHUNK_BYTES are scored in parts; each sees the last ids of
    the part before.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(column).alias("text"))
    learn = docs.where(train) if train is not None else docs
    learn = learn.select(F.col(id_column).cast("long").alias("doc_id"), F.col(column).alias("text"))
    counts = common.written(word_counts(learn), "lm-counts")
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    name = learned(learn, counts, vocab_path, n, "doc_id", "text")
    whole = float(n + (v + 1))

    def run(batches):
        vocab = bpe.vocabulary(vocab_path)
        lexicon, scorer, freq, heads, ends, weights, last = _load(name)
        number = TaskContext.get().partitionId() << 33
        kind = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("word", pa.binary()), ("alone", pa.float32()), ("each", pa.float32())])
        for batch in batches:
            data, offs = common.texts(batch, 1)
            k = len(offs) - 1
            tokens, known, base, score = np.zeros(k, np.int64), np.zeros(k, np.int64), np.zeros(k), np.zeros(k)
            lead, lead_row = None, -1
            for rows_, e, name_, ids, edge, top in sequences(vocab, data, offs, last, lexicon):
                rank = e.rank
                c = np.append(np.where(rank >= 0, freq[np.maximum(rank, 0)] if len(freq) else 0, 0), ends)
                rare = np.append(rank < 0, False)
                seg = np.repeat(np.arange(len(rows_)), np.diff(top))
                tops = edge[top]
                lead = lead if lead_row == rows_[0] else None
                logs = scorer.logs(ids, tops, last, lead)
                # the last ids of a text that goes on in the next piece (else its row does not come again)
                ended = ids[tops[-2] :] if len(rows_) > 1 or lead is None else np.concatenate([lead, ids])
                lead, lead_row = ended[-(CONTEXT + SCORED) :], int(rows_[-1])
                if len(name_):
                    parts = mixture(logs, edge, c[name_], heads[ids[edge[:-1]]], n) + np.log(weights)
                    big = parts.max(1)
                    p = (big + np.log(np.exp(parts - big[:, None]).sum(1))) / np.log(10)
                    b = np.where(rare[name_], 0.0, np.log10((c[name_] + 1) / whole))
                    np.add.at(tokens, rows_, np.diff(top))
                    np.add.at(score, rows_, np.bincount(seg, np.where(rare[name_], 0.0, p), len(rows_)))
                    np.add.at(base, rows_, np.bincount(seg, b, len(rows_)))
                    np.add.at(known, rows_, np.bincount(seg, (~rare & (c > 0))[name_], len(rows_)).astype(np.int64))
                    at = np.flatnonzero(rare[name_])
                    if len(at):  # words whose counts are looked up by a join
                        # what a count c makes of an occurrence: exp(alone) + c * exp(each)
                        w, first = name_[at], edge[:-1][at]
                        alone = parts[at, 0]
                        each = np.logaddexp(np.log(weights[1]) + logs[first] - np.log(np.maximum(heads[ids[first]], 1)), np.log(weights[2] / max(n, 1)))
                        none = pa.nulls(len(w), pa.int64())
                        yield pa.RecordBatch.from_arrays([pa.array(number + rows_[seg[at]]), none, none, none, pa.nulls(len(w), pa.float64()), pa.nulls(len(w), pa.float64()), spelled(e, w), pa.array(alone.astype(np.float32)), pa.array(each.astype(np.float32))], schema=kind)
            yield pa.RecordBatch.from_arrays([pa.array(number + np.arange(k)), batch.column(0), pa.array(tokens), pa.array(known), pa.array(base), pa.array(score), pa.nulls(k, pa.binary()), pa.nulls(k, pa.float32()), pa.nulls(k, pa.float32())], schema=kind)
            number += k

    out = common.written(rows.mapInArrow(run, "uid long, doc_id long, n_tokens long, n_known long, base double, score double, word binary, alone float, each float"), "lm-scores")
    rare = out.where("word IS NOT NULL").select("uid", "word", "alone", "each").join(counts.withColumnRenamed("n", "c").hint("shuffle_merge"), "word", "left")
    c = F.coalesce("c", F.lit(0))
    alone, counted = F.col("alone").cast("double"), F.col("each").cast("double") + F.log(c.cast("double"))
    mixed = F.when(c > 0, F.greatest(alone, counted) + F.log1p(F.exp(-F.abs(alone - counted)))).otherwise(alone)
    rare = rare.groupBy("uid").agg(F.sum(F.log10((c + 1) / F.lit(whole))).alias("rare_base"), F.sum(F.when(c > 0, 1).otherwise(0)).alias("rare_known"), F.sum(mixed / np.log(10)).alias("rare_score"))
    docs_ = out.where("word IS NULL").drop("word", "alone", "each").join(rare, "uid", "left")
    return docs_.select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("rare_score", F.lit(0.0))).alias("score"),
    )
