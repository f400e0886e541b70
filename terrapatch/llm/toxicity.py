"""Toxic spans by a linear-chain conditional random field.

Documents are labelled, tokens are not: a lexicon of words and word beginnings that mark
toxic documents labels the tokens of the training documents (a lexicon token of a toxic
document is inside a span, every other token outside).  The field has two states; its
features are a token's lexicon weights, and its transitions join neighbouring tokens.
Tokens outside the lexicon are alike, so a run of r of them acts as the r-th power of one
2 x 2 matrix: forward and backward messages step from lexicon token to lexicon token and are
exact all the same.  Marginals give the spans, and their sums a calibrated document score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrapatch.llm import common, words

#: Labelled documents of each class, at most, that the field is fitted on (those of least hash).
SAMPLE = 5000
#: A feature is in the lexicon if so many toxic documents of the sample, and such a share of them, have it, and its log odds of toxic to other documents are above ODDS.
SUPPORT, SHARE, ODDS = 3, 0.004, 2.5
#: Bytes of the word beginnings that are features; 0 is the whole word.
LENGTHS = (0, 4, 5, 6)
#: A span is reported where the marginal reaches this.
SPAN_AT = 0.5
_TRIM = np.zeros(256, bool)
_TRIM[[ord(c) for c in ".,;:!?\"'()[]{}<>*_-%&$#|/"]] = True


def tokens(data: np.ndarray, bounds: np.ndarray):
    """Lower-case words without punctuation at their edges: start, end, segment, and the features' codes (one column for each of LENGTHS; 0: none)."""
    part = words.lowered(data)
    start, end, seg = words.split_blank(part, bounds)
    for _ in range(4):
        live = end > start
        end = end - (live & _TRIM[part[np.maximum(end - 1, 0)]])
        live = end > start
        start = start + (live & _TRIM[part[np.minimum(start, len(part) - 1)]]) if len(start) else start
    codes = np.zeros((len(start), len(LENGTHS)), np.uint64)
    codes[:, 0] = words.word_hashes(part, start, end)
    for k, n in enumerate(LENGTHS[1:], 1):
        codes[:, k] = np.where(end - start > n, words.word_hashes(part, start, np.minimum(start + n, end)) + np.uint64(n), np.uint64(0))
    codes[end <= start] = 0
    return start, end, seg, codes


@dataclass
class Field:
    """A fitted field: lexicon (sorted codes and weights), transitions, emission weights, and the calibration of scores."""

    codes: np.ndarray
    weights: np.ndarray
    kinds: np.ndarray
    theta: np.ndarray
    scale: np.ndarray

    def __post_init__(self):
        self.bloom = np.zeros(1 << 18, bool)
        self.bloom[(self.codes & np.uint64((1 << 18) - 1)).astype(np.int64)] = True

    def features(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which tokens have lexicon features, and those: weight of the whole word, greatest weight of its beginnings."""
        maybe = self.bloom[(codes & np.uint64((1 << 18) - 1)).astype(np.int64)]
        at, col = np.nonzero(maybe)
        if not len(at) or not len(self.codes):
            return np.zeros(0, np.int64), np.zeros((0, 2))
        c = codes[at, col]
        i = np.minimum(np.searchsorted(self.codes, c), len(self.codes) - 1)
        hit = (self.codes[i] == c) & (c != 0)
        at, i = at[hit], i[hit]
        token, first = np.unique(at, return_inverse=True)
        out = np.zeros((len(token), 2))
        np.maximum.at(out, (first, self.kinds[i]), self.weights[i])
        return token, out


def _matrices(theta: np.ndarray):
    """Transitions (from, to) as factors, and the neutral token's matrix."""
    a = np.exp(np.array([[0.0, theta[0]], [theta[1], theta[2]]]))
    return a, a * np.exp([0.0, theta[3]])


def _powers(neutral: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """neutral ** r over the r-th power of its greatest eigenvalue, and the logarithm of that."""
    tr, det = np.trace(neutral), np.linalg.det(neutral)
    root = np.sqrt(max(tr * tr / 4 - det, 1e-30))
    big, small = tr / 2 + root, tr / 2 - root
    one = (neutral - small * np.eye(2)) / (big - small)
    two = (big * np.eye(2) - neutral) / (big - small)
    return one + ((small / big) ** r)[:, None, None] * two, np.log(big) * r


def passes(theta: np.ndarray, doc: np.ndarray, gap: np.ndarray, tail: np.ndarray, x: np.ndarray):
    """Marginals of the toxic state at the lexicon tokens, and each document's log partition.

    doc: the document of each such token (ascending), gap: neutral tokens before it since the last one, tail: neutral tokens after a document's last.
    """
    a, neutral = _matrices(theta)
    n, m = len(tail), len(doc)
    count = np.bincount(doc, minlength=n)
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    step = np.arange(m) - first[doc] if m else np.zeros(0, np.int64)
    run, log_run = _powers(neutral, gap.astype(np.float64))
    end, log_end = _powers(neutral, tail.astype(np.float64))
    emit = np.exp(np.stack([np.zeros(m), theta[3] + x @ theta[4:6]], 1))
    forth, back = np.zeros((m, 2)), np.ones((m, 2))
    logz = log_end.copy()
    order = np.argsort(step, kind="stable")
    edges = np.concatenate([[0], np.cumsum(np.bincount(step))]) if m else [0]
    state = np.tile([1.0, 0.0], (n, 1))  # before the first token: outside
    for k in range(len(edges) - 1):
        e = order[edges[k] : edges[k + 1]]
        d = doc[e]
        v = np.einsum("ij,ijk->ik", state[d], run[e]) @ a * emit[e]
        total = v.sum(1)
        state[d] = forth[e] = v / total[:, None]
        logz[d] += np.log(total) + log_run[e]
    last = np.einsum("ij,ijk->i", state, end)
    logz += np.log(last)
    message = end.sum(2)  # what follows each document's last lexicon token
    for k in range(len(edges) - 2, -1, -1):
        e = order[edges[k] : edges[k + 1]]
        d = doc[e]
        back[e] = message[d]
        v = np.einsum("ijk,ik->ij", run[e], (emit[e] * message[d]) @ a.T)
        message[d] = v / v.sum(1)[:, None]
    p = forth * back
    return p[:, 1] / np.maximum(p.sum(1), 1e-300), logz


def path_score(theta: np.ndarray, doc: np.ndarray, gap: np.ndarray, tail: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Log potential of the given states of the lexicon tokens (all others outside), by document."""
    out = np.zeros(len(tail))
    if not len(doc):
        return out
    joined = np.zeros(len(doc), bool)
    joined[1:] = (doc[1:] == doc[:-1]) & (gap[1:] == 0) & y[:-1]
    into = np.where(y, np.where(joined, theta[2], theta[0]) + theta[3] + x @ theta[4:6], 0.0)
    np.add.at(out, doc, into)
    follows = np.zeros(len(doc), bool)
    follows[:-1] = (doc[1:] == doc[:-1]) & (gap[1:] == 0)
    after_all = np.append(doc[1:] != doc[:-1], True) & (tail[doc] == 0)
    left = y & ~after_all & ~(follows & np.append(y[1:], False))
    np.add.at(out, doc, np.where(left, theta[1], 0.0))
    return out


def sums(marginal: np.ndarray, doc: np.ndarray, size: np.ndarray) -> np.ndarray:
    """What the calibration looks at: greatest marginal, log of their sum, their share of the tokens."""
    n = len(size)
    total, most = np.bincount(doc, marginal, n), np.zeros(n)
    np.maximum.at(most, doc, marginal)
    return np.stack([np.ones(n), most, np.log1p(total), np.minimum(100 * total / np.maximum(size, 1), 20.0)], 1)


def fit(lexicon: list[tuple[int, float, int]], rows: list[tuple[int, float, np.ndarray, np.ndarray, int]]) -> Field:
    """rows: (label, weight, gaps, features, tail) of the training documents; gaps and features are arrays of their lexicon tokens."""
    lexicon = sorted(lexicon)
    field = Field(np.array([c for c, _, _ in lexicon], np.uint64), np.array([w for _, w, _ in lexicon]), np.array([k for _, _, k in lexicon], np.int64), np.zeros(6), np.array([-4.0, 0.0, 0.0, 0.0]))
    if not rows:
        return field
    label = np.array([r[0] for r in rows])
    weight = np.array([r[1] for r in rows])
    doc = np.repeat(np.arange(len(rows)), [len(r[2]) for r in rows])
    gap = np.concatenate([np.asarray(r[2], np.int64) for r in rows])
    x = np.concatenate([np.asarray(r[3], np.float64).reshape(-1, 2) for r in rows])
    tail = np.array([r[4] for r in rows], np.int64)
    y = label[doc] == 1
    theta = np.array([-2.0, 0.0, 0.0, -2.0, 0.5, 0.5])

    def loss(t):
        return -float(((path_score(t, doc, gap, tail, x, y) - passes(t, doc, gap, tail, x)[1]) * weight).sum() / weight.sum()) + 1e-3 * float((t * t).sum())

    m1, m2 = np.zeros(6), np.zeros(6)
    for k in range(1, 61):
        g = np.array([(loss(theta + d) - loss(theta - d)) / 2e-4 for d in np.eye(6) * 1e-4])
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        theta = theta - 0.15 * m1 / (1 - 0.9**k) / (np.sqrt(m2 / (1 - 0.99**k)) + 1e-9)
    field.theta = theta
    z = sums(passes(theta, doc, gap, tail, x)[0], doc, tail + np.bincount(doc, gap + 1, len(tail)))
    scale = np.zeros(4)
    for _ in range(30):  # Newton's method for the logistic calibration
        p = 1 / (1 + np.exp(-np.clip(z @ scale, -30, 30)))
        h = (z * (weight * p * (1 - p))[:, None]).T @ z + np.diag([1e-3, 1.0, 1.0, 1.0])
        scale = scale + np.linalg.solve(h, z.T @ (weight * (label - p)) - np.array([1e-3, 1.0, 1.0, 1.0]) * scale)
    field.scale = scale
    return field


def chains(field: Field, data: np.ndarray, offs: np.ndarray):
    """Lexicon tokens of the texts: doc, gap, features, byte start and end in the text; and all tokens, neutral tokens after the last, by text."""
    n = len(offs) - 1
    size, since = np.zeros(n, np.int64), np.zeros(n, np.int64)
    found = []
    for rows, bounds in common.pieces(data, offs):
        start, end, seg, codes = tokens(data[bounds[0] : bounds[-1]], bounds)
        at, x = field.features(codes)
        row = rows[seg[at]]
        count = np.bincount(seg, minlength=len(rows))
        first = np.concatenate([[0], np.cumsum(count)[:-1]])
        place = at - first[seg[at]]
        gap = place.copy()
        same = np.zeros(len(at), bool)
        same[1:] = seg[at][1:] == seg[at][:-1]
        gap[same] = place[same] - place[np.flatnonzero(same) - 1] - 1
        gap[~same] += since[row[~same]]
        found.append((row, gap, x, start[at] + bounds[0] - offs[row], end[at] + bounds[0] - offs[row]))
        size[rows] += count
        rest = since[rows] + count
        if len(at):
            lastly = np.flatnonzero(~np.append(same[1:], False))
            rest[seg[at][lastly]] = count[seg[at][lastly]] - place[lastly] - 1
        since[rows] = rest
    doc, gap, x, a, b = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 2)), np.zeros(0, np.int64), np.zeros(0, np.int64))
    return doc, gap, x, a, b, size, since


def score(field: Field, data: np.ndarray, offs: np.ndarray):
    """Scores of the texts, and their lexicon tokens' marginals with document, start and end."""
    doc, gap, x, a, b, size, tail = chains(field, data, offs)
    marginal, _ = passes(field.theta, doc, gap, tail, x)
    z = sums(marginal, doc, size)
    return 1 / (1 + np.exp(-np.clip(z @ field.scale, -30, 30))), (doc, gap, a, b, marginal)


def learned(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", column: str = "text", label: str = "toxic") -> Field:
    """Fit a field on labelled documents: at most SAMPLE of each class, those of least hash of the id; equal texts count once.

    Rows of labels with a null id or label are left out; of repeated ids any toxic one decides. Without labelled rows
    every text scores 0.018: nothing is known to be toxic.
    """
    ids = labels.where(F.col(id_column).isNotNull() & F.col(label).isNotNull()).groupBy(id_column).agg(F.max(label).cast("int").alias("y"))
    ids = ids.select(F.col(id_column).cast("long").alias("doc_id"), "y")
    known = {int(r["y"]): r["n"] for r in ids.groupBy("y").agg(F.count("*").alias("n")).collect()}
    picked = None
    for y in (0, 1):
        one = ids.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
        picked = one if picked is None else picked.unionByName(one)
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(column), F.lit("")).alias("text"))
    sample = rows.join(F.broadcast(picked), "doc_id")  # 2 * SAMPLE ids at most
    sample = common.written(sample.withColumn("h", F.xxhash64("text")), "toxicity-sample")
    keep = sample.groupBy("h").agg(F.max("y").alias("y"), F.min("doc_id").alias("doc_id"))
    sample = common.written(sample.drop("y").join(keep, ["h", "doc_id"]).dropDuplicates(["h"]).select("y", "text"), "toxicity-sample")

    def occur(batches):
        for batch in batches:
            data, offs = common.texts(batch, 1)
            y = batch.column(0).to_numpy(False)
            for row_set, bounds in common.pieces(data, offs):
                _, _, seg, codes = tokens(data[bounds[0] : bounds[-1]], bounds)
                kind = np.tile(np.arange(len(LENGTHS)), len(codes))
                key = np.stack([row_set[np.repeat(seg, len(LENGTHS))].astype(np.uint64), codes.ravel(), kind.astype(np.uint64)])
                key = np.unique(key[:, key[1] != 0], axis=1)
                pair, n = np.unique(np.stack([key[1], key[2], y[key[0].astype(np.int64)].astype(np.uint64)]), axis=1, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(pair[0].view(np.int64)), pa.array(pair[1].astype(np.int32)), pa.array(pair[2].astype(np.int32)), pa.array(n)], names=["code", "kind", "y", "n"])

    seen = {int(r["y"]): r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n0, n1 = seen.get(0, 0), seen.get(1, 0)
    counts = sample.mapInArrow(occur, "code long, kind int, y int, n long").groupBy("code", "kind").agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("c1"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("c0"))
    odds = F.log((F.col("c1") + 0.5) / F.lit(n1 + 1.0)) - F.log((F.col("c0") + 0.5) / F.lit(n0 + 1.0))
    # all of them: the sample is bounded, and so few features have the support
    marked = counts.where((F.col("c1") >= max(SUPPORT, SHARE * n1)) & (odds > ODDS)).withColumn("w", odds).collect()
    lexicon = [(int(np.int64(r["code"]).view(np.uint64)), float(r["w"]), int(r["kind"] > 0)) for r in marked]
    empty = fit(lexicon, [])

    def chain(batches):
        for batch in batches:
            data, offs = common.texts(batch, 1)
            doc, gap, x, _, _, _, tail = chains(empty, data, offs)
            cut = np.searchsorted(doc, np.arange(len(offs)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([a[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)], pa.binary()) for a in (gap, x.astype(np.float32))), pa.array(tail)],
                names=["y", "gap", "x", "tail"],
            )

    found = sample.mapInArrow(chain, "y int, gap binary, x binary, tail long").collect()
    share = {0: known.get(0, 0) / max(n0, 1), 1: known.get(1, 0) / max(n1, 1)}
    norm = len(found) / max(sum(share[int(r["y"])] for r in found), 1e-9)
    return fit(lexicon, [(int(r["y"]), share[int(r["y"])] * norm, np.frombuffer(r["gap"], np.int64), np.frombuffer(r["x"], np.float32), r["tail"]) for r in found])


TAGGED = "doc_id long, score double, n_spans long, spans array<struct<start:long,end:long,marginal:double>>"


def tagged(docs: DataFrame, field: Field, id_column: str = "doc_id", column: str = "text") -> DataFrame:
    """Score and toxic spans (byte offsets) of every document. Null, empty and blank texts have the score of a text without lexicon tokens and no spans; repeated rows are scored each."""
    common.small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            data, offs = common.texts(batch, 1)
            s, (doc, gap, a, b, marginal) = score(field, data, offs)
            spans: list[list] = [[] for _ in range(len(offs) - 1)]
            for d, g, i, j, m in zip(doc.tolist(), gap.tolist(), a.tolist(), b.tolist(), marginal.tolist(), strict=True):
                if m >= SPAN_AT:
                    if spans[d] and g == 0 and spans[d][-1]["open"]:
                        spans[d][-1] |= {"end": j, "marginal": max(m, spans[d][-1]["marginal"])}
                    else:
                        spans[d].append({"start": i, "end": j, "marginal": m, "open": True})
                elif spans[d]:
                    spans[d][-1]["open"] = False
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("marginal", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array([len(x) for x in spans], pa.int64()), pa.array([[{k: y[k] for k in ("start", "end", "marginal")} for y in x] for x in spans], kind)], names=["doc_id", "score", "n_spans", "spans"])

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(column)).mapInArrow(run, TAGGED)


def below(docs: DataFrame, field: Field, at: float, column: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text scores below `at`.

    Null, empty and blank texts have the score of a text without lexicon tokens; repeated rows stay or go together. An
    empty table stays empty.
    """
    common.small_batches(docs.sparkSession)
    where = docs.columns.index(column)

    def run(batches):
        for batch in batches:
            data, offs = common.texts(batch, where)
            yield batch.filter(pa.array(score(field, data, offs)[0] < at))

    return docs.mapInArrow(run, docs.schema)
