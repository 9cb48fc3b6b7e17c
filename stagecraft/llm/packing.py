"""Sequence packing: first-fit decreasing with a tournament tree of free space.

Documents are tokenised once.  Every full sequence that lies inside a document is a piece
of its own at once; only the rest of each document (shorter than a sequence) takes part
in packing.  Rests are dealt to randomised groups of about ``group_docs`` documents (by a
hash of id, text, input partition and, for equal rows, their number in it), and each group is packed on its own: longest piece first, each into
the first sequence with room, found by a tournament tree whose leaves are the sequences'
free space.  Sequences that keep more than ``max_padding`` free places are emptied again;
their pieces are cut freely into full sequences, and what is left at the end into
sequences whose lengths are powers of two, which need no padding.

Defined cases: a null or empty text is its end id alone; an empty table gives no row;
equal rows are packed as separate documents; a null ``doc_id`` stays null; other columns
of the input are not read.  A document's pieces cover its ids exactly once.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import document_columns, slices
from .library_ids import encode_rows

SEQUENCE = 4096
GROUP_DOCS = 4096
MAX_PADDING = 32

PIECES = ("group long, doc_id long, tie long, start long, length long, crc long, "
          "doc_tokens long, ids binary")
PACKED = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long, sequence_length long")


class FreeSpace:
    """Tournament tree: the leftmost of ``n`` sequences with at least ``size`` free places."""

    def __init__(self, n: int, capacity: int):
        self.leaves = 1
        while self.leaves < n:
            self.leaves *= 2
        self.best = [capacity] * (2 * self.leaves)

    def take(self, size: int) -> int:
        best, node, leaves = self.best, 1, self.leaves
        if best[1] < size:
            raise ValueError("no sequence has room")
        while node < leaves:
            node *= 2
            if best[node] < size:
                node += 1
        best[node] -= size
        leaf = node - leaves
        node //= 2
        while node:
            left, right = best[2 * node], best[2 * node + 1]
            best[node] = left if left >= right else right
            node //= 2
        return leaf


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The sequence of each piece; ``sizes`` are in descending order."""
    if not sizes:
        return []
    tree = FreeSpace(len(sizes), capacity)
    return [tree.take(s) for s in sizes]


def recut(sizes: list[int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Cut pieces freely: (piece, from, length, sequence, offset), sequences full or powers of two."""
    left = sum(sizes)
    rooms = [capacity] * (left // capacity)
    rest = left % capacity
    rooms += [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
    out, seq, used = [], 0, 0
    for i, size in enumerate(sizes):
        at = 0
        while at < size:
            n = min(size - at, rooms[seq] - used)
            out.append((i, at, n, seq, used))
            at += n
            used += n
            if used == rooms[seq]:
                seq, used = seq + 1, 0
    return out


def document_pieces(docs: DataFrame, tokenizer: str, end_id: int | None, groups: int,
                    capacity: int = SEQUENCE) -> DataFrame:
    """Full sequences inside documents (no ids kept) and each document's rest with its ids."""
    tail = b"" if end_id is None else struct.pack("<I", end_id)
    rows = document_columns(docs).select("doc_id", F.xxhash64("doc_id", "text").alias("tie"), "text")

    def cut(batches):
        from pyspark import TaskContext
        step = 4 * capacity
        part_id, seen = TaskContext.get().partitionId(), {}
        for batch in slices(batches, 512):
            out: dict[str, list] = {k: [] for k in ("group", "doc_id", "tie", "start", "length", "crc",
                                                    "doc_tokens", "ids")}
            ids_of = encode_rows(tokenizer, batch.column(2).to_pylist())
            for doc, tie, ids in zip(*(batch.column(i).to_pylist() for i in range(2)), ids_of):
                # equal rows are numbered, so that they spread over the groups; whichever comes
                # first, the same numbers are given, so a task that runs again deals the same rows
                number = seen[tie] = seen.get(tie, -1) + 1
                group = _dealt(tie, number, part_id) % groups
                ids += tail
                total = len(ids) // 4
                for at in range(0, len(ids), step):
                    part = ids[at:at + step]
                    small = np.frombuffer(part, dtype="<u4")
                    full = len(part) == step
                    for k, v in zip(out, (group, doc, tie, at // 4, len(part) // 4, zlib.crc32(part), total,
                                          None if full else _narrow(small))):
                        out[k].append(v)
            yield pa.RecordBatch.from_pydict(
                {k: pa.array(v, pa.binary() if k == "ids" else pa.int64()) for k, v in out.items()})

    return rows.mapInArrow(cut, PIECES)


def _dealt(*keys: int) -> int:
    """A well-spread number of the keys."""
    h = 0
    for k in keys:
        h = (h ^ k) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF
        h ^= h >> 32
    return h


def _narrow(ids: np.ndarray) -> bytes:
    """Ids as uint16 behind a marker when they fit, as most vocabularies' do."""
    if ids.size and int(ids.max()) > 0xFFFF:
        return b"\x04" + ids.tobytes()
    return b"\x02" + ids.astype("<u2").tobytes()


def _wide(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype="<u4" if data[:1] == b"\x04" else "<u2", offset=1).astype("<u4")


def pack_group(table: pa.Table, capacity: int = SEQUENCE, max_padding: int = MAX_PADDING) -> pa.Table:
    """Pack one group's pieces; sequence ids are the group number and a counter."""
    col = {k: table.column(k).to_pylist() for k in table.column_names}
    group = col["group"][0] if table.num_rows else 0
    n = table.num_rows
    order = sorted(range(n), key=lambda i: (-col["length"][i], col["doc_id"][i] is not None,
                                            col["doc_id"][i] or 0, col["tie"][i], col["start"][i]))
    rests = [i for i in order if col["ids"][i] is not None]
    out: list[tuple] = []
    seq = 0
    for i in order:
        if col["ids"][i] is None:
            out.append((col["doc_id"][i], col["start"][i], col["length"][i], col["crc"][i],
                        col["doc_tokens"][i], seq, 0, col["length"][i]))
            seq += 1
    place = first_fit_decreasing([col["length"][i] for i in rests], capacity)
    bins: dict[int, list[int]] = {}
    for i, b in zip(rests, place):
        bins.setdefault(b, []).append(i)
    loose: list[int] = []
    for b in sorted(bins):
        used = sum(col["length"][i] for i in bins[b])
        if capacity - used > max_padding and used & (used - 1):
            loose.extend(bins[b])
            continue
        at = 0
        for i in bins[b]:
            out.append((col["doc_id"][i], col["start"][i], col["length"][i], col["crc"][i],
                        col["doc_tokens"][i], seq, at, used))
            at += col["length"][i]
        seq += 1
    cuts = recut([col["length"][i] for i in loose], capacity)
    held: dict[int, int] = {}
    for _, _, length, s, _ in cuts:
        held[s] = held.get(s, 0) + length
    for k, a, length, s, at in cuts:
        i = loose[k]
        crc = col["crc"][i] if length == col["length"][i] else zlib.crc32(
            _wide(col["ids"][i])[a:a + length].tobytes())
        out.append((col["doc_id"][i], col["start"][i] + a, length, crc, col["doc_tokens"][i],
                    seq + s, at, held[s]))
    names = [f.split()[0] for f in PACKED.split(", ")]
    cols = list(zip(*out)) if out else [()] * len(names)
    cols[5] = [(group << 32) + s for s in cols[5]]
    return pa.Table.from_arrays([pa.array(list(c), pa.int64()) for c in cols], names=names)


def pack(docs: DataFrame, tokenizer: str, end_id: int | None = 2, capacity: int = SEQUENCE,
         group_docs: int = GROUP_DOCS, max_padding: int = MAX_PADDING) -> DataFrame:
    """Pack every document into sequences of at most ``capacity`` ids; one row per piece."""
    groups = max(1, -(-docs.count() // group_docs))
    pieces = document_pieces(docs, tokenizer, end_id, groups, capacity)

    def group(table: pa.Table) -> pa.Table:
        return pack_group(table, capacity, max_padding)

    return pieces.groupBy("group").applyInArrow(group, PACKED)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents (word vocabulary, end id 2) into sequences of 4,096."""
    from .library_ids import tokenizer_path
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path("word_bpe_49k.json"))
