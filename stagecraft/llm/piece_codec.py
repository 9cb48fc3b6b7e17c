"""SentencePiece BPE encoding with source offsets, and decoding.

Normalisation walks the text by longest prefixes of the model's compiled character map
and notes, for every normalised byte, the source bytes it came from; white space becomes
the model's space symbol.  The normalised text falls into stretches (space symbols, then
anything else) across which no piece of the vocabulary reaches; each stretch is merged
once (:mod:`bpe_merge`, best score first, leftmost of equals), symbols outside the
vocabulary become byte pieces, and every piece is projected to the span of source bytes
it covers.  Decoding is the sentencepiece library's own ``decode(ids)``.

Defined cases: a null or empty text is encoded as the begin and end ids alone and decodes
to the empty text; an empty table gives no row; equal rows each keep their row; other
columns of the input are not read; texts of any length are encoded whole.
"""

from __future__ import annotations

import hashlib
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .bpe_merge import PairTable, merge_ragged
from .common import document_columns, slices

#: Fixed values of the model format: the space symbol and the piece types.
SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


class CharacterMap:
    """The compiled character map: a double-array trie and the texts it maps to."""

    def __init__(self, blob: bytes):
        self.units: list[int] = []
        self.texts = b""
        if blob:
            (size,) = struct.unpack_from("<I", blob)
            self.units = np.frombuffer(blob, dtype="<u4", count=size // 4, offset=4).tolist()
            self.texts = blob[4 + size:]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes]:
        """Length and replacement of the longest mapped prefix of ``data[at:]`` (0: none)."""
        units = self.units
        if not units:
            return 0, b""
        found = (0, b"")
        unit = units[0]
        pos = (unit >> 10) << ((unit & 0x200) >> 6)
        for i in range(at, len(data)):
            pos ^= data[i]
            unit = units[pos]
            if unit & 0x800000FF != data[i]:
                break
            pos ^= (unit >> 10) << ((unit & 0x200) >> 6)
            if unit >> 8 & 1:
                start = units[pos] & 0x7FFFFFFF
                found = (i + 1 - at, self.texts[start:self.texts.index(b"\0", start)])
        return found


class Normalizer:
    """Normalised text and, for each of its bytes (and its end), the source byte offset."""

    def __init__(self, spec):
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.dummy_prefix = spec.add_dummy_prefix
        self.trim = spec.remove_extra_whitespaces
        self.escape = spec.escape_whitespaces

    @property
    def plain(self) -> bool:
        """Nothing but spaces changes, so alignment is known without walking the text."""
        return not self.map.units and not self.trim and self.escape

    def steps(self, data: bytes):
        """(source length, normalised bytes) of each longest prefix."""
        at = 0
        while at < len(data):
            n, text = self.map.longest(data, at)
            if not n:
                n = 1
                while at + n < len(data) and data[at + n] & 0xC0 == 0x80:
                    n += 1
                text = data[at:at + n]
            yield n, text
            at += n

    def normalize(self, data: bytes) -> tuple[bytes, list[int]]:
        space = SPACE.encode() if self.escape else b" "
        out, source, at = bytearray(), [], 0
        steps = list(self.steps(data))
        if self.trim:  # spaces before the first other character go
            lead = 0
            while lead < len(steps) and not steps[lead][1].strip(b" "):
                at += steps[lead][0]
                lead += 1
            steps = steps[lead:]
        if not steps:
            return b"", [at]
        if self.dummy_prefix:
            out += space
            source += [at] * len(space)
        after_space = self.trim
        for n, text in steps:
            if self.trim and after_space:
                text = text.lstrip(b" ")
            for ch in text:
                new = space if ch == 0x20 else bytes([ch])
                out += new
                source += [at] * len(new)
            if text:
                after_space = text.endswith(b" ")
            at += n
        if self.trim:  # and those after the last one
            while out.endswith(space):
                cut = len(out) - len(space)
                at = source[cut]
                del out[cut:], source[cut:]
        return bytes(out), [*source, at]


class PieceCodec:
    """Encoder of one BPE model file."""

    def __init__(self, path: str, limit: int = 300_000, limit_bytes: int = 24 << 20):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        if model.trainer_spec.model_type != pb.TrainerSpec.BPE or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("the codec is for BPE models with leading spaces")
        if any(p.type == USER_DEFINED for p in model.pieces):
            raise ValueError("models with user-defined pieces are not supported")
        self.normalizer = Normalizer(model.normalizer_spec)
        self.bos, self.eos, self.unk = (self.library.bos_id(), self.library.eos_id(), self.library.unk_id())
        self.fallback = model.trainer_spec.byte_fallback
        usable = {p.piece: (i, p.score) for i, p in enumerate(model.pieces) if p.type == NORMAL}
        if any(SPACE in p.lstrip(SPACE) for p in usable):
            raise ValueError("a piece reaches across a space")
        self.byte_id = [self.library.piece_to_id(f"<0x{b:02X}>") for b in range(256)] if self.fallback else []
        # symbols: vocabulary pieces by id; characters outside it by code point above all ids
        self.base = len(model.pieces)
        scores = sorted({s for _, s in usable.values()}, reverse=True)
        rank = {s: r for r, s in enumerate(scores)}
        left, right, ranks, merged = [], [], [], []
        for piece, (i, score) in usable.items():
            for k in range(1, len(piece)):
                a, b = self._symbol(piece[:k], usable), self._symbol(piece[k:], usable)
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    ranks.append(rank[score])
                    merged.append(i)
        self.table = PairTable(left, right, ranks, merged)
        self.char_id = {p: i for p, (i, _) in usable.items() if len(p) == 1}
        self.stretch = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.bytes_of = np.array([len(p.piece.encode()) for p in model.pieces])
        for b in self.byte_id:
            self.bytes_of[b] = 1
        self.space_id = self.char_id.get(SPACE)
        #: stretch -> (ids, normalised bytes of each piece)
        self.cache: dict[str, tuple[bytes, bytes]] = {}
        self.limit, self.limit_bytes, self.held = limit, limit_bytes, 0

    def _symbol(self, text: str, usable: dict) -> int | None:
        found = usable.get(text)
        if found:
            return found[0]
        return self.base + ord(text) if len(text) == 1 else None

    def _learn(self, stretches: set[str]) -> None:
        new = list(stretches.difference(self.cache))
        if not new:
            return
        self.held += sum(map(len, new))
        chars = "".join(new)
        code = np.frombuffer(chars.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
        kinds, where = np.unique(code, return_inverse=True)
        ids = np.array([self.char_id.get(chr(k), self.base + k) for k in kinds.tolist()], np.int64)
        symbols, counts = merge_ragged(ids[where], np.array([len(s) for s in new]), self.table)
        ends = np.cumsum(counts)
        known = symbols < self.base
        sizes = np.where(known, self.bytes_of[np.where(known, symbols, 0)], 0)
        for s, a, b in zip(new, (ends - counts).tolist(), ends.tolist()):
            part, size = symbols[a:b], sizes[a:b]
            if not known[a:b].all():
                part, size = self._spell(part.tolist())
            self.cache[s] = (part.astype("<u4").tobytes(), size.astype("<u4").tobytes())

    def _spell(self, symbols: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Characters outside the vocabulary as byte pieces (or runs of them as unknown)."""
        ids, sizes, unknown = [], [], False
        for s in symbols:
            if s < self.base:
                ids.append(s)
                sizes.append(int(self.bytes_of[s]))
                unknown = False
                continue
            raw = chr(s - self.base).encode("utf-8", "surrogatepass")
            if self.fallback:
                ids.extend(self.byte_id[b] for b in raw)
                sizes.extend([1] * len(raw))
            elif unknown:
                sizes[-1] += len(raw)
            else:
                ids.append(self.unk)
                sizes.append(len(raw))
                unknown = True
        return np.array(ids), np.array(sizes)

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per text: all ids with begin and end, and each id's (from, to) source byte span."""
        normal = [self._normal(t) for t in texts]
        parts = [self.stretch.findall(n) for n, _ in normal]
        if len(self.cache) > self.limit or self.held > self.limit_bytes:
            self.cache.clear()
            self.held = 0
        self._learn(set().union(*parts))
        out = []
        for text, (_, source), p in zip(texts, normal, parts):
            found = [self.cache[s] for s in p]
            ids = np.frombuffer(b"".join([f[0] for f in found]), dtype="<u4")
            ends = np.cumsum(np.frombuffer(b"".join([f[1] for f in found]), dtype="<u4"), dtype=np.int64)
            spans = self._spans(text, ids, ends, source)
            n = int(spans[-1, 1]) if len(spans) else 0
            out.append((np.concatenate([[self.bos], ids, [self.eos]]).astype("<u4"),
                        np.concatenate([[[0, 0]], spans, [[n, n]]])))
        return out

    def _normal(self, text: str) -> tuple[str, list[int] | None]:
        if not self.normalizer.plain:
            data, source = self.normalizer.normalize(text.encode("utf-8", "surrogatepass"))
            return data.decode("utf-8", "surrogatepass"), source
        if text and self.normalizer.dummy_prefix:
            text = " " + text
        return text.replace(" ", SPACE), None

    def _spans(self, text: str, ids: np.ndarray, ends: np.ndarray, source) -> np.ndarray:
        """Project pieces from normalised to source bytes."""
        if source is None:
            # only spaces changed: a space symbol of the normalised text is one source byte,
            # unless the source itself holds that symbol; the dummy prefix is none
            if SPACE in text:
                _, source = self.normalizer.normalize(text.encode("utf-8", "surrogatepass"))
            else:
                spaces = np.cumsum(self.spaces_of[ids], dtype=np.int64)
                to = ends - 2 * spaces - (1 if self.normalizer.dummy_prefix and len(ids) else 0)
                return np.stack([np.concatenate([[0], to[:-1]]), to], axis=1) if len(ids) else np.zeros((0, 2), int)
        source = np.asarray(source, np.int64)
        return np.stack([source[np.concatenate([[0], ends[:-1]])], source[ends]], axis=1) \
            if len(ids) else np.zeros((0, 2), int)

    @property
    def spaces_of(self) -> np.ndarray:
        if not hasattr(self, "_spaces"):
            self._spaces = np.array([self.library.id_to_piece(i).count(SPACE) for i in range(self.base)])
        return self._spaces

    def decode(self, ids: np.ndarray) -> str:
        return self.library.decode(ids.tolist())


_CODECS: dict[str, PieceCodec] = {}


def codec(path: str) -> PieceCodec:
    if path not in _CODECS:
        _CODECS[path] = PieceCodec(path)
    return _CODECS[path]


def chunked(texts: list[str], chars: int = 1 << 20):
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size > chars:
            yield part
            part, size = [], 0
    if part:
        yield part


def encode_documents(docs: DataFrame, model: str) -> DataFrame:
    """Per row: doc_id, ids, and the source byte span [span_from, span_to) of each id."""
    def encode(batches):
        c = codec(model)
        for batch in slices(batches, 256):
            ids, spans = [], []
            for part in chunked(batch.column(1).to_pylist()):
                for i, s in c.encode(part):
                    ids.append(i)
                    spans.append(s)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0),
                "ids": pa.array([i.astype(np.int32) for i in ids], pa.list_(pa.int32())),
                "span_from": pa.array([s[:, 0] for s in spans], pa.list_(pa.int64())),
                "span_to": pa.array([s[:, 1] for s in spans], pa.list_(pa.int64()))})

    return document_columns(docs).mapInArrow(
        encode, "doc_id long, ids array<int>, span_from array<long>, span_to array<long>")


def round_trip(docs: DataFrame, model: str) -> DataFrame:
    """Digests of each text's ids and of what they decode to; ``n_source_bytes`` is the
    number of source bytes that the pieces' spans cover."""
    def digest(batches):
        c = codec(model)
        for batch in slices(batches, 256):
            rows = []
            for part in chunked(batch.column(1).to_pylist()):
                for ids, spans in c.encode(part):
                    rows.append((len(ids), hashlib.sha256(ids.tobytes()).hexdigest(),
                                 hashlib.sha256(c.decode(ids).encode()).hexdigest(),
                                 int((spans[:, 1] - spans[:, 0]).sum())))
            n, sha, text, covered = zip(*rows)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": list(sha),
                "decoded_sha256": list(text), "n_source_bytes": pa.array(covered, pa.int64())})

    return document_columns(docs).mapInArrow(
        digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_source_bytes long")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode all documents with the piece vocabulary."""
    from .library_ids import tokenizer_path
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path("piece_bpe_32k.model"))
