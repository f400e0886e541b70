"""SimHash near-duplicates by pigeonring filtering.

A fingerprint of 64 bits is a ring of segments.  If two fingerprints differ in at most t
bits, then from some segment on every chain of consecutive segments keeps its proportional
share of the budget: l segments differ in at most l * t / m bits.  With t = 4 and m = 5 the
first segment of such a chain is equal and the first two differ in at most one bit, which
makes two segments the key of an equi-join: the index holds each fingerprint under its own
key, the probes hold it under its key and under those with one set bit of the second segment
cleared, so two fingerprints meet at a chain's start from exactly one side.  Longer chains
are checked before the full distance is.

A key that many fingerprints share goes on by the third segment, then by the fourth: each member is
dealt to the variants of its segment with few bits flipped, so that those within the chain's budget
meet in one.

Fingerprints that share a key are not paired.  Each key's members are searched as a graph,
and only the links by which the search reaches a member come out, one at most for each.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrapatch.llm import common, graph, words

SHINGLE = 4
BUDGET = 4
SEED = 42
#: First bit and width of each segment.
WIDTHS = (13, 13, 13, 13, 12)
STARTS = (0, 13, 26, 39, 52)
#: Keys hold two segments of 13 bits, the number of the first in three more, and from this bit on the view.
VIEW = 29
#: Members of one key that one task holds; a larger key is dealt out in blocks that meet in pairs. Keys of more than
#: EXTEND members are first extended by the next segments of the ring, so that a member has a bounded number of rows.
KEY_BLOCK, EXTEND = 2048, 16 * 2048
#: Shingles whose bits are added up at once.
BITS = 1 << 15


def shingle_bounds(data: np.ndarray, bounds: np.ndarray, n: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The segments' words joined by single spaces, start and end of each run of n words (of all where there are fewer), the segment of each run, and each segment's number of words."""
    start, end, seg = words.split_blank(data, bounds)
    size = end - start
    joined = np.full(int(size.sum()) + len(size), 32, np.uint8)
    at = np.concatenate([[0], np.cumsum(size + 1)[:-1]]) if len(size) else size
    joined[words.gathered(at, size)] = data[words.gathered(start, size)]
    count = np.bincount(seg, minlength=len(bounds) - 1)
    runs = np.where(count > 0, np.maximum(count - n + 1, 1), 0)
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    head = words.gathered(first, runs)
    of = np.repeat(np.arange(len(runs)), runs)
    tail = np.minimum(head + n - 1, (first + count)[of] - 1)
    return joined.tobytes(), at[head] if len(head) else head, (at + size)[tail] if len(head) else head, of, count


def shingle_hashes(data: np.ndarray, offs: np.ndarray, n: int):
    """(row of each segment, hash of each shingle of n words, its segment) of each piece of the texts."""
    digest = xxhash.xxh64_intdigest
    carry, carry_row = b"", -1
    for seg_rows, bounds in common.pieces(data, offs):
        goes_on = bounds[-1] < offs[seg_rows[-1] + 1]
        part = data[bounds[0] : bounds[-1]]
        bounds = bounds - bounds[0]
        if carry_row == seg_rows[0]:  # the last words of the piece before lead over
            lead = np.frombuffer(carry + b" ", np.uint8)
            part = np.concatenate([lead, part])
            bounds = np.concatenate([[0], bounds[1:] + len(lead)])
        part = words.lowered(part)
        joined, a, b, of, count = shingle_bounds(part, bounds, n)
        if goes_on and count[-1] < n:  # no whole shingle yet
            keep = of < len(seg_rows) - 1
            a, b, of = a[keep], b[keep], of[keep]
        yield seg_rows, np.array([digest(joined[x:y], SEED) for x, y in zip(a.tolist(), b.tolist(), strict=True)], np.uint64), of
        # the last n - 1 words begin shingles that end in the next piece of a long text
        take = min(n - 1, int(count[-1])) if goes_on else 0
        carry, carry_row = (joined[:-1].rsplit(b" ", take)[-take:], int(seg_rows[-1])) if take else ([], -1)
        carry = b" ".join(carry)


def prints_of(data: np.ndarray, offs: np.ndarray, n: int = SHINGLE) -> np.ndarray:
    """The fingerprint of each text, as signed 64 bits."""
    rows = len(offs) - 1
    ones, total = np.zeros((rows, 64), np.int64), np.zeros(rows, np.int64)
    for seg_rows, hashes, segments in shingle_hashes(data, offs, n):
        for a in range(0, len(hashes), BITS):
            h, of = hashes[a : a + BITS], segments[a : a + BITS]
            heads = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            row = seg_rows[of[heads]]
            bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones[row] += np.add.reduceat(bits, heads, axis=0, dtype=np.int64)
            total[row] += np.diff(np.append(heads, len(of)))
    mark = (2 * ones > total[:, None]).astype(np.uint8)
    value = np.packbits(mark, axis=1, bitorder="little").view("<u8")[:, 0] if rows else np.zeros(0, np.uint64)
    return value.view(np.int64)


def fingerprints(batches, column: int = 1, n: int = SHINGLE):
    """Rows (id, fingerprint as signed 64 bits) of batches (id, text)."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints_of(*common.texts(batch, column), n))], names=["doc_id", "fp"])


def _ring(x):
    """Bits of difference by segment of the ring, x being two fingerprints' difference."""
    return [np.bitwise_count((x >> np.uint64(s)) & np.uint64((1 << w) - 1)).astype(np.int16) for s, w in zip(STARTS, WIDTHS, strict=True)]


def linked(one: np.ndarray, many: np.ndarray, i: int) -> np.ndarray:
    """Which of `many` keep the budgets along the ring from segment i, then the whole budget."""
    x = many ^ one
    m = len(WIDTHS)
    parts = _ring(x)
    ok = np.ones(len(many), bool)
    total = np.zeros(len(many), np.int16)
    for k in range(m):
        total = total + parts[(i + k) % m]
        ok &= total <= (k + 1) * BUDGET // m
    return ok


def links(prints: DataFrame, column: str = "fp") -> DataFrame:
    """Pairs (a, b) of distinct fingerprints within the budget: enough of them to connect all that such pairs connect."""
    return links_of_views(prints.select(F.lit(0).alias("view"), F.col(column).alias("fp"))).select("a", "b")


def links_of_views(prints: DataFrame) -> DataFrame:
    """Links (view, a, b) of distinct fingerprints (view, fp), those of each view on their own."""
    found = []
    for i in range(len(WIDTHS)):
        j = (i + 1) % len(WIDTHS)
        key = f"(shiftleft({_bits(i)}, 13) | {_bits(j)} | {i << VIEW - 3}L | shiftleft(CAST(view AS BIGINT), {VIEW}))"
        found.append(f"named_struct('key', {key}, 'probe', 0)")
        found += [f"IF(shiftrightunsigned(fp, {STARTS[j] + b}) % 2 <> 0, named_struct('key', {key} - {1 << b}L, 'probe', 1), NULL)" for b in range(WIDTHS[j])]
    rows = prints.select("fp", F.explode(F.expr(f"array_compact(array({', '.join(found)}))")).alias("k")).select("fp", "k.key", "k.probe", F.lit(0).cast("long").alias("cell"))
    made = [common.written(rows, "simhash-keys")]
    # keys of one member link nothing
    sizes = made[0].groupBy("key", "cell").agg(F.count("*").alias("n"), F.sum(F.lit(1) - F.col("probe")).alias("own")).where("n > 1 AND own > 0").drop("own")
    done = None
    for level in range(1, len(WIDTHS) - 1):
        made.append(common.written(sizes, "simhash-sizes"))
        met = made[-2].join(made[-1].hint("shuffle_merge"), ["key", "cell"]).select("fp", "key", "cell", "n")
        few = met.where(F.col("n") <= EXTEND)
        done = few if done is None else done.unionByName(few)
        if not made[-1].agg(F.coalesce(F.max("n"), F.lit(0)) > EXTEND).first()[0]:
            break
        # a large key goes on along the ring: members whose next segments keep the budget share a variant of them
        made.append(common.written(met.where(F.col("n") > EXTEND).select("fp", "key", F.explode(_variants(level)).alias("cell")), "simhash-keys"))
        sizes = made[-1].groupBy("key", "cell").agg(F.count("*").alias("n")).where("n > 1")
    else:
        made.append(common.written(sizes, "simhash-sizes"))
        done = done.unionByName(made[-2].join(made[-1].hint("shuffle_merge"), ["key", "cell"]).select("fp", "key", "cell", "n"))
    # what is still large is dealt out in blocks: every two, and each with itself, meet
    blocks = F.ceil(F.col("n") / KEY_BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("fp"), blocks).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), blocks - 1), lambda other: F.least(mine, other) * blocks + F.greatest(mine, other))
    cells = done.select("fp", "key", "cell", F.explode(F.when(blocks > 1, pairs).otherwise(F.array(F.lit(0)))).alias("block"))
    n = prints.sparkSession.conf.get("spark.sql.shuffle.partitions")
    dealt = cells.repartition(int(n), "key", "cell", "block").sortWithinPartitions("key", "cell", "block")

    def run(batches):
        for view, *key_rows in _groups(batches):
            out = _search(*key_rows)
            if out is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(out.num_rows, view, np.int32)), *out.columns], names=["view", "a", "b"])

    out = common.written(dealt.mapInArrow(run, "view int, a long, b long").distinct(), "simhash-links")
    common.forgotten(*made)
    return out


def _variants(level: int) -> Column:
    """The cells of `fp` when its key goes on by one segment: the cell so far, and the segment as it is or with few bits flipped. Differences up to the chain's budget have a variant in common."""
    cases = []
    for i in range(len(WIDTHS)):
        at = (i + 1 + level) % len(WIDTHS)
        flips = -(-((level + 2) * BUDGET // len(WIDTHS)) // 2)
        masks = [sum(1 << b for b in c) for r in range(flips + 1) for c in itertools.combinations(range(WIDTHS[at]), r)]
        cases.append(f"WHEN {i} THEN transform(array({', '.join(f'{m}L' for m in masks)}), m -> shiftleft(cell, 13) | ({_bits(at)} ^ m))")
    return F.expr(f"CASE (shiftrightunsigned(key, {VIEW - 3}) & 7) {' '.join(cases)} END")


def _bits(i: int) -> str:
    """SQL of a segment of `fp`."""
    return f"(shiftrightunsigned(fp, {STARTS[i]}) & {(1 << WIDTHS[i]) - 1}L)"


def _groups(batches):
    """(view, fingerprints, number of the first segment) of each key, cell and block of sorted rows."""
    rest = None
    for batch in batches:
        cols = [batch.column(k).to_numpy() for k in range(4)]
        if rest is not None:
            cols = [np.concatenate([x, y]) for x, y in zip(rest, cols, strict=True)]
        fp, key = cols[:2]
        new = np.flatnonzero(np.any([x[1:] != x[:-1] for x in cols[1:]], axis=0)) + 1
        edges = np.concatenate([[0], new])
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            yield int(key[a]) >> VIEW, fp[a:b], int(key[a]) >> VIEW - 3 & 7
        rest = [x[edges[-1] :] for x in cols] if len(key) else None
    if rest is not None and len(rest[0]):
        yield int(rest[1][0]) >> VIEW, rest[0], int(rest[1][0]) >> VIEW - 3 & 7


def _search(fp: np.ndarray, i: int):
    """Links by which a search from each unreached fingerprint reaches others of the key."""
    if len(fp) < 2:
        return None
    fp = np.unique(fp.view(np.uint64))
    if len(fp) < 2:
        return None
    left, found = fp, []
    while len(left):
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            one = frontier.pop()
            hit = linked(one, left, i)
            if hit.any():
                new = left[hit]
                found.append(np.stack([np.full(len(new), one), new]))
                frontier.extend(new)
                left = left[~hit]
    if not found:
        return None
    pairs = np.concatenate(found, 1).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(pairs.min(0)), pa.array(pairs.max(0))], names=["a", "b"])


def components(distinct: DataFrame) -> DataFrame:
    """Distinct fingerprints (fp and other columns) with the root of their component."""
    distinct = common.written(distinct, "simhash-distinct")
    members = graph.components(links(distinct.select("fp")), "a", "b")  # node, root
    return distinct.join(members.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", column: str = "text", n: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint, component_id of every document; fingerprints at a distance of at most 4 are linked.

    A null or blank text has fingerprint zero and is linked like any other. Rows with a null id get the component
    of their fingerprint; a component's id is the smallest that is not null. Repeated rows repeat in the result.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(column))
    prints = common.written(rows.mapInArrow(lambda b: fingerprints(b, 1, n), "doc_id long, fp long"), "simhash-prints")
    classes = components(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    least = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = common.written(classes.select("fp", "root").join(least, "root").select("fp", "component_id"), "simhash-classes")
    out = prints.join(classes.hint("shuffle_merge"), "fp")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: Of the corpus pipeline: words of a shingle; copies are alike (Jaccard, of the sets of shingles) by 4/5 or more.
COPY_SHINGLE, ALIKE = 5, (4, 5)
#: Keys of a set and least hashes in each: two sets that are 0.8 alike share no key with a probability of 8e-8.
BANDS, LEAST = 16, 2
#: Bytes of shingle sets of one key that one task holds (about); see KEY_BLOCK.
SET_BYTES = 16 << 20


def shingle_sets(data: np.ndarray, offs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text in order, and where each text's begin (rows + 1)."""
    rows = len(offs) - 1
    found = [(seg_rows[of], h) for seg_rows, h, of in shingle_hashes(data, offs, n)]
    of, h = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
    order = np.lexsort((h, of))
    of, h = of[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (of[1:] != of[:-1]) | (h[1:] != h[:-1])
    return h[new], np.searchsorted(of[new], np.arange(rows + 1))


def set_keys(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """BANDS keys for each text that has shingles: hashes of LEAST least hashes each, under as many orders of the shingles."""
    heads = bounds[:-1][bounds[:-1] < bounds[1:]]
    out = np.empty((len(heads), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(heads), band + 1, np.uint64)
        for k in range(LEAST):
            salt = np.uint64((band * LEAST + k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
            key = words.mixed(key * np.uint64(0x9FB21C651E98DF25) + np.minimum.reduceat(words.mixed(h ^ salt), heads))
        out[:, band] = key
    return out


def alike(one: int, many: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes that share so many are alike by ALIKE or more, in whole numbers."""
    a, b = ALIKE
    return shared * (a + b) >= a * (one + many)


def _alike_links(node: np.ndarray, sets: list[bytes]) -> np.ndarray | None:
    """Links (2, n) by which a search from each unreached set reaches others that are alike."""
    node, at = np.unique(node, return_index=True)
    if len(node) < 2:
        return None
    held = [np.frombuffer(sets[i], np.uint64) for i in at.tolist()]
    size = np.array([len(x) for x in held])
    if len(node) == 2:
        shared = len(np.intersect1d(held[0], held[1], assume_unique=True))
        return node[:, None] if alike(int(size[0]), size[1:], np.array([shared]))[0] else None
    # for each shingle, the sets that hold it
    of = np.repeat(np.arange(len(held)), size)
    _, name = np.unique(np.concatenate(held), return_inverse=True)
    order = np.argsort(name, kind="stable")
    holders, top = of[order], np.concatenate([[0], np.cumsum(np.bincount(name))])
    bounds = np.concatenate([[0], np.cumsum(size)])
    left, found = np.ones(len(held), bool), []
    for first in range(len(held)):
        frontier = [first] if left[first] else []
        left[first] = False
        while frontier:
            one = frontier.pop()
            mine = name[bounds[one] : bounds[one + 1]]
            shared = np.bincount(holders[words.gathered(top[mine], top[mine + 1] - top[mine])], minlength=len(held))
            hit = np.flatnonzero(left & (shared > 0) & alike(int(size[one]), size, shared))
            if len(hit):
                left[hit] = False
                found.append(np.stack([np.full(len(hit), node[one]), node[hit]]))
                frontier.extend(hit.tolist())
    return np.concatenate(found, 1) if found else None


def _cells(batches):
    """(nodes, their sets) of each key and cell of sorted rows (key, cell, node, set)."""
    at, node, sets = None, [], []
    for batch in batches:
        keys = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
        for now, n, x in zip(keys, batch.column(2).to_pylist(), batch.column(3), strict=True):
            if now != at:
                if len(node) > 1:
                    yield np.array(node, np.int64), sets
                at, node, sets = now, [], []
            node.append(n)
            sets.append(x.as_py())
    if len(node) > 1:
        yield np.array(node, np.int64), sets


def alike_links(keys: DataFrame, rows: DataFrame, n: int) -> DataFrame:
    """Links (a, b) of sets that are alike: enough of them to connect all that pairs with a key in common connect.

    keys: node, uid of a row that has its text, size of its set, key. rows: uid, text. Sets are made anew for nodes that
    share a key. Keys that have the same members are searched once.
    """
    sizes = keys.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("all"), F.min("node").alias("least"), F.bit_xor(F.xxhash64("node")).alias("members")).where("n > 1")
    sizes = sizes.groupBy("n", "all", "least", "members").agg(F.min("key").alias("key"))
    blocks = F.ceil(F.greatest(F.col("n") / KEY_BLOCK, F.col("all") * 8 / SET_BYTES)).cast("int")
    sizes = common.written(sizes.select("key", F.greatest(F.lit(1), F.least(blocks, F.col("n"))).alias("blocks")), "copies-sizes")
    met = common.written(keys.join(sizes.hint("shuffle_merge"), "key").select("node", "uid", "key", "blocks"), "copies-met")
    live = met.select("uid").distinct()

    def made(batches):
        for batch in batches:
            h, bounds = shingle_sets(*common.texts(batch, 1), n)
            held = [h[a:b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held, pa.binary())], names=["uid", "shingles"])

    sets = common.written(rows.join(live.hint("shuffle_merge"), "uid", "left_semi").select("uid", "text").mapInArrow(made, "uid long, shingles binary"), "copies-sets")
    # every two blocks of a large key, and each with itself, meet in a cell
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda other: F.least(mine, other) * F.col("blocks").cast("long") + F.greatest(mine, other))
    dealt = met.select("node", "uid", "key", F.explode(cells).alias("cell")).join(sets.hint("shuffle_merge"), "uid").select("key", "cell", "node", "shingles")
    dealt = dealt.repartition(int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key", "cell").sortWithinPartitions("key", "cell")

    def run(batches):
        for node, held in _cells(batches):
            out = _alike_links(node, held)
            if out is not None:
                yield pa.RecordBatch.from_arrays([pa.array(out.min(0)), pa.array(out.max(0))], names=["a", "b"])

    out = common.written(dealt.mapInArrow(run, "a long, b long").distinct(), "copies-links")
    common.forgotten(sizes, met, sets)
    return out


def print_links(rows: DataFrame) -> DataFrame:
    """Links (a, b) of nodes (node, fp) whose fingerprints are equal or within the budget: each fingerprint's least node stands for it."""
    rows = common.written(rows.distinct(), "copies-prints")
    first = common.written(rows.groupBy("fp").agg(F.min("node").alias("least")), "copies-first")
    equal = rows.join(first.hint("shuffle_merge"), "fp").where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    one, other = (first.select(F.col("fp").alias(c), F.col("least").alias(f"of_{c}")).hint("shuffle_merge") for c in "ab")
    near = links(first.select("fp")).join(one, "a").join(other, "b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))
    out = common.written(equal.unionByName(near), "copies-links")
    common.forgotten(rows, first)
    return out


def representatives(docs: DataFrame, id_column: str = "doc_id", column: str = "text", n: int = COPY_SHINGLE, by_prints: bool = False) -> DataFrame:
    """One row, with all its columns, of each group: that of the smallest id (null ids last; of repeated ids, any one).

    Documents are linked if their sets of n-word shingles are 0.8 alike or more and, if by_prints, also as near_duplicates()
    links them: by fingerprints at a distance of at most 4. They are in a group if links of either kind connect them. Null,
    empty and blank texts have no words and are one group; a text of fewer words than n is one shingle. Repeated rows are
    copies. An empty table stays empty.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    names = [*docs.columns, "tp_fp", "tp_node", "tp_size", "tp_keys"]
    where, schema = docs.columns.index(column), T.StructType([*docs.schema]).add("tp_fp", "long").add("tp_node", "long").add("tp_size", "long").add("tp_keys", T.ArrayType(T.LongType()))

    def run(batches):
        for batch in batches:
            data, offs = common.texts(batch, where)
            fp = prints_of(data, offs) if by_prints else np.zeros(batch.num_rows, np.int64)
            h, bounds = shingle_sets(data, offs, n)
            node = [xxhash.xxh64_intdigest(h[a:b].tobytes(), SEED) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            keys, size = set_keys(h, bounds), np.diff(bounds)
            tops = np.concatenate([[0], np.cumsum(np.where(size > 0, BANDS, 0))]).astype(np.int32)
            keys = pa.ListArray.from_arrays(pa.array(tops), pa.array(keys.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fp), pa.array(np.array(node, np.uint64).view(np.int64)), pa.array(size.astype(np.int64)), keys], names=names)

    rows = common.written(docs.mapInArrow(run, schema).withColumn("tp_uid", F.monotonically_increasing_id()), "copies-rows")
    name = F.struct(F.coalesce(F.col(id_column).cast("long"), F.lit(2**63 - 1)).alias("id"), F.col("tp_uid").alias("uid"))
    nodes = common.written(rows.groupBy(F.col("tp_node").alias("node")).agg(F.min(name).alias("least")), "copies-nodes")
    # equal sets have equal keys: those of the least row stand for all
    first = nodes.select("node", F.col("least.uid").alias("tp_uid"))
    keys = rows.select("tp_uid", "tp_size", "tp_keys").join(first.hint("shuffle_merge"), "tp_uid")
    keys = common.written(keys.select("node", F.col("tp_uid").alias("uid"), F.col("tp_size").alias("size"), F.explode("tp_keys").alias("key")), "copies-keys")
    links_ = alike_links(keys, rows.select(F.col("tp_uid").alias("uid"), F.col(f"`{column}`").alias("text")), n)
    common.forgotten(keys)
    if by_prints:
        links_ = links_.unionByName(print_links(rows.select(F.col("tp_node").alias("node"), F.col("tp_fp").alias("fp"))))
    groups = graph.components(links_, "a", "b")
    keep = nodes.join(groups.hint("shuffle_merge"), "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("least").alias("least"))
    keep = common.written(keep.select(F.col("least.uid").alias("tp_uid")), "copies-kept")
    return rows.join(keep.hint("shuffle_merge"), "tp_uid", "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
