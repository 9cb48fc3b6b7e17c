"""SimHash near-duplicates by a binary trie self-join.

A document's fingerprint has bit b set if over half of its word shingles' hashes have it
set.  Equal fingerprints form one class.  Classes within ``max_bits`` differing bits are
linked by a self-join of binary tries: the 64 bits are turned so that each of
``max_bits + 1`` blocks leads once; two fingerprints within the budget agree on one block
at least, so each trie is cut below its leading block and the parts are joined
independently.  Inside a part, pairs of trie nodes are traversed together, level by level:
differing bits add up along the way, a pair over the budget is dropped with everything
below it, and pairs of small nodes are compared bit by bit.  A part that holds more than
``PART_LIMIT`` classes is first dealt out as pairs of deeper nodes that are still within
the budget.  A part returns the links of a spanning forest, not all its pairs.

Defined cases: null, empty and wordless texts have fingerprint zero and are linked like
any other; texts with fewer words than a shingle are one shingle; equal rows each keep
their row; a component of null ids only has a null ``component_id``; an empty table gives
no row; other columns of the input are not read.  Texts are read whole, in any length.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import document_columns, materialize, shuffle_partitions, slices
from .components import connected_components

SEED = 42
PART_LIMIT = 1 << 16
LEAF_PAIRS = 1024
COMPARE_AT_ONCE = 1 << 21


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """SimHash of one UTF-8 text: ASCII lower case, words by ASCII white space."""
    from xxhash import xxh64_intdigest as h
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = len(words)
    if n <= shingle:
        hashes = [h(joined, SEED)]
    else:
        ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
        starts = [0, *(e + 1 for e in ends)]
        hashes = [h(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1:])]
    set_bits = np.zeros(64, np.int64)
    values = np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8)
    for i in range(0, len(values), 1 << 16):
        set_bits += np.unpackbits(values[i:i + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(set_bits * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3, tie: bool = False) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long; with ``tie``, a hash of the text as well."""
    rows = document_columns(docs, binary=True)
    if tie:
        rows = rows.withColumn("tie", F.xxhash64("text"))

    def run(batches):
        for batch in slices(batches, 512):
            fps = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64)), *batch.columns[2:]],
                                             names=["doc_id", "fp", "tie"][:batch.num_columns])

    return rows.mapInArrow(run, "doc_id long, fp long" + ", tie long" * tie)


def join_parts(values: np.ndarray, first: np.ndarray, middle: np.ndarray, depth: np.ndarray,
               max_bits: int) -> np.ndarray:
    """Join the tries of several parts; returns each value's representative (its index).

    ``values``: unsigned, ascending within a part; ``first``: where parts begin (and the
    end); ``middle``: -1 to join a part with itself, else where its second node begins;
    ``depth``: bits that all values of a node share.
    """
    label = np.arange(len(values))
    lo, hi = first[:-1], first[1:]
    cross = middle >= 0
    split = np.where(cross, middle, hi)
    start = np.stack([lo, split, np.where(cross, split, lo), hi], axis=1)
    # differing bits of the shared prefixes of a crossed pair
    shared = np.where(depth >= 64, ~np.uint64(0), ~(~np.uint64(0) >> depth.astype(np.uint64)))
    other = np.minimum(start[:, 2], len(values) - 1)
    diff = np.where(cross, np.bitwise_count((values[lo] ^ values[other]) & shared), 0).astype(np.int64)
    pairs = np.zeros((0, 5), np.int64)  # a_lo, a_hi, b_lo, b_hi, differing bits so far
    for d in range(int(depth.min()) if len(depth) else 64, 65):
        new = depth == d
        if new.any():
            pairs = np.concatenate([pairs, np.column_stack([start[new], diff[new]])])
        if not len(pairs):
            if d > (int(depth.max()) if len(depth) else 0):
                break
            continue
        size_a, size_b = pairs[:, 1] - pairs[:, 0], pairs[:, 3] - pairs[:, 2]
        same = pairs[:, 0] == pairs[:, 2]
        live = (size_a > 0) & (size_b > 0) & (pairs[:, 4] <= max_bits) & ~(same & (size_a < 2))
        pairs, size_a, size_b = pairs[live], size_a[live], size_b[live]
        small = size_a * size_b <= LEAF_PAIRS if d < 64 else np.ones(len(pairs), bool)
        _compare(values, pairs[small], max_bits, label)
        pairs = pairs[~small]
        if not len(pairs):
            continue
        zeros = np.concatenate([[0], np.cumsum((values >> np.uint64(63 - d) & np.uint64(1)) == 0)])
        a0, a1, b0, b1, k = pairs.T
        am, bm = a0 + zeros[a1] - zeros[a0], b0 + zeros[b1] - zeros[b0]
        same = a0 == b0
        left = np.column_stack([a0, am, b0, bm, k])
        right = np.column_stack([am, a1, bm, b1, k])
        apart = np.column_stack([a0, am, bm, b1, k + 1])
        back = np.column_stack([am, a1, b0, bm, k + 1])[~same]
        pairs = np.concatenate([left, right, apart, back])
    return label


def _compare(values, pairs, max_bits, label) -> None:
    """Compare all values of small node pairs bit by bit and unite those within the budget."""
    sizes = (pairs[:, 1] - pairs[:, 0]) * (pairs[:, 3] - pairs[:, 2])
    total = np.cumsum(sizes)
    begin = 0
    while begin < len(pairs):
        base = total[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(total, base + COMPARE_AT_ONCE, "right")))
        part, size = pairs[begin:end], sizes[begin:end]
        which = np.repeat(np.arange(len(part)), size)
        at = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
        width = (part[:, 3] - part[:, 2])[which]
        i, j = part[which, 0] + at // width, part[which, 2] + at % width
        near = (i != j) & (np.bitwise_count(values[i] ^ values[j]) <= max_bits)
        unite(label, i[near], j[near])
        begin = end


def unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give linked entries the smaller representative of the two, in place."""
    while len(a):
        ra, rb = label[a], label[b]
        apart = ra != rb
        if not apart.any():
            return
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(label, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label[:] = up


def _turned(max_bits: int):
    """The fingerprint turned left so that block j of ``max_bits + 1`` leads, and its width."""
    blocks = max_bits + 1
    edges = [64 * j // blocks for j in range(blocks + 1)]
    return [(edges[j], edges[j + 1] - edges[j]) for j in range(blocks)]


def trie_parts(classes: DataFrame, max_bits: int, limit: int = PART_LIMIT) -> DataFrame:
    """(block, lead, sub, depth, v): each class once per block; crowded parts as node pairs."""
    turns = F.array(*[F.struct(
        F.lit(j).alias("block"), F.lit(width).alias("depth"),
        (F.shiftleft("fp", shift).bitwiseOR(F.shiftrightunsigned("fp", 64 - shift)) if shift
         else F.col("fp")).alias("v")) for j, (shift, width) in enumerate(_turned(max_bits))])
    rows = classes.select(F.explode(turns).alias("t")).select("t.*")
    rows = rows.withColumn("lead", F.expr("shiftrightunsigned(v, 64 - depth)"))
    crowded = materialize(rows.groupBy("block", "lead").count().where(F.col("count") > limit)
                          .select("block", "lead", F.least(F.lit(12), F.ceil(F.log2(F.col("count") / limit)) + 2)
                                  .cast("int").alias("more")), "crowded")
    rows = rows.join(crowded, ["block", "lead"], "left")
    plain = rows.where("more is null").select("block", "lead", F.lit(-1).cast("long").alias("sub"), "depth", "v")
    own = F.expr("shiftrightunsigned(v, 64 - depth - more) & (shiftleft(1L, more) - 1)")
    masks = F.expr(f"filter(sequence(0L, shiftleft(1L, more) - 1), m -> bit_count(m) <= {max_bits})")
    deep = (rows.where("more is not null").withColumn("own", own)
            .select("block", "lead", "depth", "more", "v", "own", F.explode(masks).alias("m"))
            .withColumn("peer", F.col("own").bitwiseXOR(F.col("m")))
            .select("block", "lead", F.expr("shiftleft(least(own, peer), more) | greatest(own, peer)").alias("sub"),
                    F.expr("depth + more").alias("depth"), "v"))
    return plain.unionByName(deep)


LINKS = "a long, b long"


def near_links(classes: DataFrame, max_bits: int = 3, limit: int = PART_LIMIT) -> DataFrame:
    """Links (a, b) between fingerprints that keep every pair within ``max_bits`` connected."""
    parts = trie_parts(classes, max_bits, limit)
    widths = _turned(max_bits)

    def join(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= 2 * PART_LIMIT:
                table = _columns(held)
                cut = _last_part(table)
                if cut:
                    yield from _links(table[:, :cut])
                held = [table[:, cut:]]
                size = table.shape[1] - cut
        if size:
            yield from _links(_columns(held))

    def _columns(held):
        return np.concatenate([h if isinstance(h, np.ndarray) else
                               np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in h.columns])
                               for h in held], axis=1)

    def _last_part(table):
        change = np.flatnonzero((table[:3, 1:] != table[:3, :-1]).any(axis=0))
        return int(change[-1]) + 1 if len(change) else 0

    def _links(table):
        block, lead, sub, depth, v = table
        order = np.lexsort((v.view(np.uint64), sub, lead, block))
        block, lead, sub, depth, v = (x[order] for x in (block, lead, sub, depth, v))
        values = v.view(np.uint64)
        edge = np.flatnonzero(np.r_[True, (block[1:] != block[:-1]) | (lead[1:] != lead[:-1])
                                    | (sub[1:] != sub[:-1])])
        first = np.r_[edge, len(values)]
        middle = np.full(len(edge), -1)
        for i in np.flatnonzero(sub[edge] >= 0).tolist():  # only crowded parts
            a, b = first[i], first[i + 1]
            node = values[a:b] >> np.uint64(64 - int(depth[a]))
            if node[0] != node[-1]:
                middle[i] = a + int(np.searchsorted(node, node[-1]))
            else:
                more = int(depth[a]) - widths[int(block[a])][1]
                p, q = int(sub[a]) >> more, int(sub[a]) & ((1 << more) - 1)
                if p != q:
                    middle[i] = b  # the other node of the pair is empty
        label = join_parts(values, first, middle, depth[edge], max_bits)
        linked = np.flatnonzero(label != np.arange(len(label)))
        if len(linked):
            shift = np.array([s for s, _ in widths], np.uint64)[block[linked]]

            def back(x):
                return np.where(shift == 0, x, x >> shift | x << (np.uint64(64) - shift) % np.uint64(64))

            yield pa.RecordBatch.from_pydict({
                "a": pa.array(back(values[linked]).view(np.int64)),
                "b": pa.array(back(values[label[linked]]).view(np.int64))})

    n = shuffle_partitions(classes.sparkSession)
    dealt = parts.repartition(n, "block", "lead", "sub").sortWithinPartitions("block", "lead", "sub")
    return dealt.select("block", "lead", "sub", "depth", "v").mapInArrow(join, LINKS).distinct()


def rooted(docs: DataFrame, shingle: int = 3, max_bits: int = 3, tie: bool = False) -> DataFrame:
    """Per row: doc_id, fp, component_id and root, which names a component without ids as well; ``tie`` if asked."""
    fps = materialize(fingerprints(docs, shingle, tie), "fingerprints")
    classes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("low_id")), "classes")
    roots = connected_components(near_links(classes.select("fp"), max_bits))
    of_root = (classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
               .withColumn("root", F.coalesce("root", "fp")))
    lowest = materialize(of_root.groupBy("root").agg(F.min("low_id").alias("component_id")), "lowest")
    of_class = of_root.select("fp", "root").join(lowest, "root").select("fp", "root", "component_id")
    return fps.join(of_class, "fp")


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """Per row: doc_id, fp (signed long), component_id (smallest doc_id reachable)."""
    return rooted(docs, shingle, max_bits).select("doc_id", "fp", "component_id")


def op7_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents: 3-word shingles, 3 bits."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), 3, 3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
