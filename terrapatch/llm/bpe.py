"""BPE encoding and decoding over a minimal acyclic transducer.

The frequent words of the corpus and their ids are compiled into an automaton whose equal
suffixes share states; arcs carry numbers that add up to a word's rank, and the rank leads
to its ids.  The automaton is one file that all Python workers of an executor map into
memory.  Words that it does not hold are merged exactly, many at a time, with the
vocabulary's merge ranks.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import mmap
import os
import tempfile
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrapatch.llm import common, words

#: A word is compiled if it makes up at least this share of all words; so at most 2**20 words are.
SHARE = 2.0**-20
#: Longer words (bytes) are never compiled.
LONGEST = 40
#: Longer words are merged one by one with a heap.
HEAP_FROM = 256


@functools.cache
def byte_chars() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Ids, bytes and merge ranks of a byte-level BPE tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, chars = spec["model"], byte_chars()
        self.suffix = model.get("end_of_word_suffix") or ""
        vocab: dict[str, int] = model["vocab"]
        self.special = {x["content"].encode(): x["id"] for x in spec["added_tokens"]}
        self.size = 1 + max([*vocab.values(), *self.special.values()])
        self.bytes: list[bytes] = [b""] * self.size
        for text, i in vocab.items():
            if self.suffix and text.endswith(self.suffix):
                text = text[: -len(self.suffix)]
            self.bytes[i] = bytes(chars[c] for c in text)
        for text, i in self.special.items():
            self.bytes[i] = text
        inverse = {b: c for c, b in chars.items()}
        self.byte_id = np.array([vocab[inverse[b]] for b in range(256)], np.int64)
        self.last_id = np.array([vocab[inverse[b] + self.suffix] for b in range(256)], np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        self.made = np.array([vocab[a + (b[: -len(self.suffix)] + self.suffix if self.suffix and b.endswith(self.suffix) else b)] for a, b in merges], np.int64)
        self.rank = {(int(a), int(b)): i for i, (a, b) in reversed(list(enumerate(zip(left, right, strict=True))))}
        # open addressing: pair of ids -> rank
        self.bits = 18
        size = 1 << self.bits
        self.keys, self.ranks = np.full(size, -1, np.int64), np.zeros(size, np.int64)
        for (a, b), r in self.rank.items():
            k = a << 17 | b
            at = self._slot(k)
            while self.keys[at] >= 0:
                at = (at + 1) & (size - 1)
            self.keys[at], self.ranks[at] = k, r
        lens = np.array([len(x) for x in self.bytes], np.int64)
        self.token_len, self.token_off = lens, np.concatenate([[0], np.cumsum(lens)[:-1]])
        self.token_data = np.frombuffer(b"".join(self.bytes), np.uint8)

    def _slot(self, k: int) -> int:
        return ((k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> (64 - self.bits)) & ((1 << self.bits) - 1)

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair; a large number where it merges never."""
        k = a << 17 | b
        at = ((k.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)
        out = np.full(len(k), 1 << 40, np.int64)
        live = np.arange(len(k))
        while len(live):
            seen = self.keys[at[live]]
            hit = seen == k[live]
            out[live[hit]] = self.ranks[at[live[hit]]]
            live = live[~hit & (seen >= 0)]
            at[live] = (at[live] + 1) & ((1 << self.bits) - 1)
        return out

    def merge(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words data[start:end], one after the other, and how many each has. Always the pair of least rank, leftmost first, merges."""
        n = len(start)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        lens = end - start
        out: list[np.ndarray | None] = [None] * n
        huge = np.flatnonzero(lens > HEAP_FROM)
        for i in huge:
            out[i] = np.array(self.merge_one(data[start[i] : end[i]].tobytes()), np.int64)
        live = np.flatnonzero(lens <= HEAP_FROM)
        lens = lens[live]
        sym = self.byte_id[data[words.gathered(start[live], lens)]]
        if self.suffix and len(sym):
            ends = np.cumsum(lens)
            sym[ends - 1] = self.last_id[data[end[live] - 1]]
        done_word, done_sym = [], []
        big = 1 << 40
        offs = np.concatenate([[0], np.cumsum(lens)])
        rank = np.full(len(sym), big, np.int64)
        inner = np.ones(len(sym), bool)
        inner[offs[1:] - 1] = False
        at = np.flatnonzero(inner)
        rank[at] = self.pair_ranks(sym[at], sym[at + 1])
        while len(live):
            best = np.minimum.reduceat(rank, offs[:-1])
            over = best >= big
            if over.any():
                word_of = np.repeat(over, lens)
                done_word.append((live[over], lens[over]))
                done_sym.append(sym[word_of])
                keep = ~word_of
                sym, rank = sym[keep], rank[keep]
                live, lens, best = live[~over], lens[~over], best[~over]
                offs = np.concatenate([[0], np.cumsum(lens)])
                if not len(live):
                    break
            hits = np.flatnonzero(rank == np.repeat(best, lens))
            owner = np.searchsorted(offs, hits, side="right") - 1
            lead = np.ones(len(hits), bool)
            lead[1:] = owner[1:] != owner[:-1]
            hits, owner = hits[lead], owner[lead]
            sym[hits] = self.made[best]
            keep = np.ones(len(sym), bool)
            keep[hits + 1] = False
            sym, rank = sym[keep], rank[keep]
            lens = lens - 1
            offs = np.concatenate([[0], np.cumsum(lens)])
            hits = hits - owner
            # new pairs to the right and to the left of what was made
            tail = hits == offs[1:] - 1
            rank[hits[tail]] = big
            some = hits[~tail]
            rank[some] = self.pair_ranks(sym[some], sym[some + 1])
            some = hits[hits > offs[:-1]]
            rank[some - 1] = self.pair_ranks(sym[some - 1], sym[some])
        counts = np.zeros(n, np.int64)
        for w, k in done_word:
            counts[w] = k
        for i in huge:
            counts[i] = len(out[i])
        total = np.concatenate([[0], np.cumsum(counts)])
        ids = np.empty(total[-1], np.int64)
        for (w, k), s in zip(done_word, done_sym, strict=True):
            ids[words.gathered(total[w], k)] = s
        for i in huge:
            ids[total[i] : total[i + 1]] = out[i]
        return ids, counts

    def merge_one(self, word: bytes) -> list[int]:
        """Ids of one word, by a heap of pairs: for words of any length."""
        sym = [int(self.byte_id[b]) for b in word]
        if not sym:
            return []
        sym[-1] = int(self.last_id[word[-1]])
        n = len(sym)
        nxt, prv, rank = [*range(1, n), -1], [*range(-1, n - 1)], self.rank
        heap = [(r, i, sym[i], sym[i + 1]) for i in range(n - 1) if (r := rank.get((sym[i], sym[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = nxt[i] if sym[i] == a else -1
            if j < 0 or sym[j] != b:
                continue
            sym[i], sym[j] = int(self.made[r]), -1
            nxt[i] = nxt[j]
            if nxt[j] >= 0:
                prv[nxt[j]] = i
            for p, q in ((prv[i], i), (i, nxt[i])):
                if p >= 0 and q >= 0 and (r := rank.get((sym[p], sym[q]))) is not None:
                    heapq.heappush(heap, (r, p, sym[p], sym[q]))
        return [s for s in sym if s >= 0]

    def decode(self, ids: np.ndarray) -> bytes:
        """The tokens' bytes, one after the other."""
        return self.token_data[words.gathered(self.token_off[ids], self.token_len[ids])].tobytes()


@functools.lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


# --- the automaton ---------------------------------------------------------------------------


def _slots(key: np.ndarray, bits: int) -> np.ndarray:
    return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


class Lexicon:
    """A mapped file: the table of arcs (state and byte, target, number) and, by rank, the ids."""

    NAMES = ("final", "check", "target", "number", "offset", "ids")

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        head = np.frombuffer(self.map, np.int64, len(self.NAMES))
        at = 8 * len(self.NAMES)
        for name, size in zip(self.NAMES, head, strict=True):
            setattr(self, name, np.frombuffer(self.map, np.int32, int(size), at))
            at += 4 * int(size)

    @classmethod
    def write(cls, path: str, arrays: dict[str, np.ndarray]) -> None:
        with open(path, "wb") as f:
            f.write(np.array([len(arrays[k]) for k in cls.NAMES], np.int64).tobytes())
            for k in cls.NAMES:
                f.write(arrays[k].astype(np.int32).tobytes())

    def find(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Rank of each word, -1 where it is not compiled: all words take a step together."""
        out = np.full(len(start), -1, np.int64)
        live = np.flatnonzero(end - start <= LONGEST)
        if len(self.offset) < 2:
            return out
        size = len(self.check)
        bits = size.bit_length() - 1
        state, total, pos, stop = np.zeros(len(live), np.int32), np.zeros(len(live), np.int32), start[live], end[live]
        while len(live):
            over = pos == stop
            if over.any():
                good = over & (self.final[state] > 0)
                out[live[good]] = total[good]
                go = ~over
                live, state, total, pos, stop = live[go], state[go], total[go], pos[go], stop[go]
                if not len(live):
                    break
            key = state << 8 | data[pos]
            slot = _slots(key, bits)
            seen = self.check[slot]
            lost = np.flatnonzero((seen != key) & (seen >= 0))
            while len(lost):
                slot[lost] = (slot[lost] + 1) & (size - 1)
                now = self.check[slot[lost]]
                seen[lost] = now
                lost = lost[(now != key[lost]) & (now >= 0)]
            ok = seen == key
            slot = slot[ok]
            live, pos, stop = live[ok], pos[ok] + 1, stop[ok]
            total = total[ok] + self.number[slot]
            state = self.target[slot]
        return out


def compile_lexicon(found: list[bytes], vocab: Vocabulary, path: str) -> int:
    """Write the minimal automaton of the given words; returns its number of states."""
    found = sorted({w for w in found if 0 < len(w) <= LONGEST})
    # incremental construction from sorted words: states are frozen into a register of equal suffixes
    register: dict[tuple, int] = {}
    arcs: list[tuple] = []  # of a frozen state: (final, byte, target, byte, target, ...)
    counts: list[int] = []

    def freeze(node: list) -> int:
        key = (node[0], *node[1])
        if (at := register.get(key)) is None:
            at = register[key] = len(arcs)
            arcs.append(key)
            counts.append(key[0] + sum(counts[t] for t in key[2::2]))
        return at

    path_: list[list] = [[0, []]]  # open states along the last word: [final, arcs]
    last = b""
    for w in found:
        k = 0
        top = min(len(w), len(last))
        while k < top and w[k] == last[k]:
            k += 1
        while len(path_) > k + 1:
            node = path_.pop()
            path_[-1][1][-1] = freeze(node)
        for b in w[k:]:
            path_[-1][1] += [b, -1]
            path_.append([0, []])
        path_[-1][0] = 1
        last = w
    while len(path_) > 1:
        node = path_.pop()
        path_[-1][1][-1] = freeze(node)
    root = freeze(path_[0])
    # states in new order, the root first; all arcs in one table, by hash of (state, byte)
    n = len(arcs)
    name = np.arange(n)
    name[root], name[0] = 0, root
    flat: list[int] = []
    for s, row in enumerate(arcs):
        add = row[0]
        for c, g in zip(row[1::2], row[2::2], strict=True):
            flat += (s, c, g, add)
            add += counts[g]
    arc = np.array(flat, np.int64).reshape(-1, 4)
    bits = max(10, int(3 * len(arc)).bit_length())
    size = 1 << bits
    check, target, number = np.full(size, -1, np.int64), np.zeros(size, np.int64), np.zeros(size, np.int64)
    key = name[arc[:, 0]] << 8 | arc[:, 1]
    slot, left = _slots(key, bits), np.arange(len(arc))
    while len(left):  # all arcs try their slot at once; of those that meet, one stays
        free = left[check[slot[left]] < 0]
        _, lead = np.unique(slot[free], return_index=True)
        put = free[lead]
        check[slot[put]], target[slot[put]], number[slot[put]] = key[put], name[arc[put, 2]], arc[put, 3]
        left = np.setdiff1d(left, put, assume_unique=True)
        slot[left] = (slot[left] + 1) & (size - 1)
    final = np.zeros(n, np.int64)
    final[name] = [row[0] for row in arcs]
    data = np.frombuffer(b"".join(found), np.uint8)
    ends = np.cumsum([len(w) for w in found], dtype=np.int64) if found else np.zeros(0, np.int64)
    starts = np.concatenate([[0], ends[:-1]]) if found else ends
    a, b = words.split_bytelevel(data, np.append(starts, len(data)))  # a word may be several to the tokenizer
    ids, each = vocab.merge(data, a, b)
    upto = np.concatenate([[0], np.cumsum(each)])
    offset = upto[np.searchsorted(a, np.append(starts, len(data)))]
    Lexicon.write(path, {"final": final, "check": check, "target": target, "number": number, "offset": offset, "ids": ids})
    return n


_open: dict[str, Lexicon] = {}


def mapped(name: str) -> Lexicon:
    """The lexicon of that name, mapped once by a Python worker."""
    if name not in _open:
        _open.clear()
        _open[name] = Lexicon(SparkFiles.get(name))
    return _open[name]


# --- encoding --------------------------------------------------------------------------------


class Encoder:
    """Encodes chunks: compiled words by the automaton, others by merges."""

    def __init__(self, vocab: Vocabulary, lexicon: Lexicon | None, split=words.split_bytelevel):
        self.vocab, self.lexicon, self.split = vocab, lexicon, split

    def chunk(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the segments of data that bounds (from 0) delimits, and where in them each segment begins and the last ends."""
        start, end = self.split(data, bounds)
        ids, counts = self.words(data, start, end)
        upto = np.concatenate([[0], np.cumsum(counts)])
        return ids, upto[np.searchsorted(start, bounds)]

    def words(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the given words, and how many each has."""
        n = len(start)
        rank = self.lexicon.find(data, start, end) if self.lexicon else np.full(n, -1, np.int64)
        unseen = np.flatnonzero(rank < 0)
        head, name = words.distinct(data, start[unseen], end[unseen])
        fresh, sizes = self.vocab.merge(data, start[unseen[head]], end[unseen[head]])
        fresh_off = np.concatenate([[0], np.cumsum(sizes)])
        known = np.flatnonzero(rank >= 0)
        pool = np.concatenate([fresh, self.lexicon.ids]) if self.lexicon else fresh
        off, counts = np.empty(n, np.int64), np.empty(n, np.int64)
        off[unseen], counts[unseen] = fresh_off[name], sizes[name]
        if len(known):
            r = rank[known]
            off[known] = self.lexicon.offset[r] + len(fresh)
            counts[known] = self.lexicon.offset[r + 1] - self.lexicon.offset[r]
        return pool[words.gathered(off, counts)], counts


def segments(data: np.ndarray, offs: np.ndarray, special: dict[bytes, int]) -> Iterator[tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]]:
    """The pieces of the texts, cut at special tokens as well: (rows, bounds, (segment, id) of those that are special tokens)."""
    raw = data.tobytes() if special else b""
    at: list[tuple[int, int, int]] = []
    for token, i in special.items():
        k = raw.find(token)
        while k >= 0:
            at.append((k, k + len(token), i))
            k = raw.find(token, k + len(token))
    at.sort()
    del raw
    for rows, bounds in common.pieces(data, offs):
        inside = [x for x in at if bounds[0] <= x[0] < bounds[-1]]
        if not inside:
            yield rows, bounds, []
            continue
        new_rows, new_bounds, marks = [], [int(bounds[0])], []
        for k, row in enumerate(rows):
            a, b = int(bounds[k]), int(bounds[k + 1])
            while inside and inside[0][0] < b:
                s, e, i = inside.pop(0)
                if a <= s and e <= b:
                    if s > new_bounds[-1]:
                        new_rows.append(row)
                        new_bounds.append(s)
                    marks.append((len(new_rows), i))
                    new_rows.append(row)
                    new_bounds.append(e)
            if b > new_bounds[-1] or a == b:
                new_rows.append(row)
                new_bounds.append(b)
        yield np.array(new_rows, np.int64), np.array(new_bounds, np.int64), marks


def encode_rows(encoder: Encoder, data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(row, ids) of each segment of the texts, in order; a long text has several."""
    for rows, bounds, marks in segments(data, offs, encoder.vocab.special):
        ids, cut = encoder.chunk(data[bounds[0] : bounds[-1]], bounds - bounds[0])
        special = dict(marks)
        for k, row in enumerate(rows):
            yield int(row), np.array([special[k]]) if k in special else ids[cut[k] : cut[k + 1]]


def word_counts(docs: DataFrame, column: str = "text", split=words.split_bytelevel, keep: int = 400_000) -> DataFrame:
    """word (binary), n: how often each word occurs in all texts. Tasks add up their own counts first; `keep` bounds the words that one holds at once."""

    def count(batches):
        held: Counter = Counter()
        for batch in batches:
            data, offs = common.texts(batch, column)
            for _, bounds in common.pieces(data, offs):
                part = data[bounds[0] : bounds[-1]]
                start, end = split(part, bounds)[:2]
                ok = end - start <= LONGEST
                start, end = start[ok], end[ok]
                head, name = words.distinct(part, start, end)
                raw, n = part.tobytes(), np.bincount(name, minlength=len(head))
                for a, b, k in zip(start[head].tolist(), end[head].tolist(), n.tolist(), strict=True):
                    held[raw[a:b]] += k
                if len(held) > keep:
                    yield pa.RecordBatch.from_pydict({"word": pa.array(held.keys(), pa.binary()), "n": pa.array(held.values(), pa.int64())})
                    held = Counter()
        yield pa.RecordBatch.from_pydict({"word": pa.array(held.keys(), pa.binary()), "n": pa.array(held.values(), pa.int64())})

    return docs.select(column).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def lexicon_for(docs: DataFrame, vocab_path: str, column: str = "text", share: float = SHARE) -> str:
    """Compile the words that make up at least `share` of all words of the texts (so 1 / share words at most) and hand the file to all executors; returns its name."""
    spark = docs.sparkSession
    counts = common.written(word_counts(docs, column), "word-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    frequent = counts.where(F.col("n") >= F.lit(max(2, total * share))).select("word")
    found = [bytes(x) for x in frequent.toPandas()["word"]]
    name = f"lexicon-{os.urandom(8).hex()}"
    local = os.path.join(tempfile.mkdtemp(prefix="lexicon-"), name)
    compile_lexicon(found, vocabulary(vocab_path), local)
    spark.sparkContext.addFile(local)
    return name


RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def round_trip(docs: DataFrame, vocab_path: str, id_column: str = "doc_id", column: str = "text") -> DataFrame:
    """Encode every text and decode its ids again; per document the number of ids and digests of the ids and of the decoded text.

    Null and empty texts have no ids, and the digests of no bytes. Repeated rows are encoded each. Special
    tokens' strings within a text become the special ids. An empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    name = lexicon_for(docs, vocab_path, column)

    def run(batches):
        vocab = vocabulary(vocab_path)
        encoder = Encoder(vocab, mapped(name))
        for batch in batches:
            data, offs = common.texts(batch, 1)
            n = len(offs) - 1
            sha, text = [hashlib.sha256() for _ in range(n)], [[] for _ in range(n)]
            count = np.zeros(n, np.int64)
            decoded = [""] * n
            row, held = -1, []

            def close():
                if row >= 0:
                    decoded[row] = hashlib.sha256(b"".join(held).decode("utf-8", "replace").encode()).hexdigest()

            for k, ids in encode_rows(encoder, data, offs):
                if k != row:
                    close()
                    row, held = k, []
                sha[k].update(ids.astype("<u4").tobytes())
                count[k] += len(ids)
                held.append(vocab.decode(ids))
            close()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count), pa.array([x.hexdigest() for x in sha]), pa.array(decoded)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(column)).mapInArrow(run, RESULT)
