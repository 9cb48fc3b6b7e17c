"""Token store, token counts, SentencePiece codec and packing, against their libraries."""

import hashlib
import zlib

import numpy as np
import pytest

from stagecraft.llm import packing, piece_codec, token_counts, token_store
from stagecraft.llm.bpe_merge import PairTable, merge_long, merge_ragged
from stagecraft.llm.common import work_dir
from stagecraft.llm.library_ids import LibraryIds, tokenizer_path

from .common_rows import documents, no_documents, odd_documents, odd_rows, texts

BYTE, WORD, PIECE = (tokenizer_path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
TRICKY = ["", " ", "  a  b\n\n c", "foo's bar,baz <|endoftext|>  x", "a\x1cb c", "İstanbul ΣΑΣ été é x\xa0y",
          "​﻿ z", "日本語テスト 123 4567", "<|ENDOFTEXT|> <|startoftext|>hi", "a ́b",
          "tab\tx \x0b y \x85 z  q", "\n\nfoo\n bar \n", "\U0001f600\U0001f600 <|endoftext|>", "ab" * 700, "a" * 1000,
          "<s> </s> <unk> <0x41> hi", "▁x ▁▁ y▁", " " * 50 + "x" + " " * 17, "\x00a\x00"]


def library_ids(path, text):
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_cached_ids_equal_the_library(spark, path):
    some = TRICKY + list(texts(spark).values())[:60]
    enc = LibraryIds(path, limit=500)  # a small table, so that it is emptied on the way
    got = [np.frombuffer(b, "<u4").tolist() for _ in range(2) for b in enc.encode(some)]
    assert got[:len(some)] == got[len(some):] == [np.frombuffer(b, "<u4").tolist() for b in enc.whole(some)]
    assert enc.kind != "whole"


def test_very_long_text_in_blocks():
    text = "alpha beta  gamma\n" * 90_000
    enc = LibraryIds(BYTE)
    assert enc.encode([text]) == enc.whole([text])


def test_counts_equal_the_library(spark):
    some = TRICKY + list(texts(spark).values())
    c = token_counts.TokenCounter(WORD, limit=3000)
    data = [t.encode() for t in some]
    c.prepare(data)
    assert c.count(data) == [len(b) // 4 for b in LibraryIds(WORD).whole(some)]


def test_merge_ragged_equals_a_queue():
    rng = np.random.default_rng(3)
    left, right = np.divmod(rng.permutation(36)[:20], 6)
    table = PairTable(left, right, rng.permutation(20), np.arange(6, 26) % 12)
    seqs = [rng.integers(0, 8, n).tolist() for n in rng.integers(0, 30, 200)] + [[1] * 400]
    out, sizes = merge_ragged(np.array([s for q in seqs for s in q]), np.array([len(q) for q in seqs]), table)
    ends = np.cumsum(sizes)
    assert [out[e - n:e].tolist() for e, n in zip(ends, sizes)] == [merge_long(q, table) for q in seqs]


def test_token_store_round_trip(spark):
    docs = documents(spark)
    manifest = token_store.write_store(docs, work_dir(spark, "store"), BYTE, end_id=2, shards=5)
    got = sorted(tuple(r) for r in token_store.read_store(manifest).collect())
    at, want = 0, []
    for doc, text in sorted(texts(spark).items()):
        ids = np.array(library_ids(BYTE, text) + [2], "<u4")
        want.append((doc, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want
    some = spark.createDataFrame([(want[3][0],), (want[7][0],), (-5,)], "doc_id long")
    found = {r["doc_id"]: r["ids"] for r in token_store.read_documents(manifest, some).collect()}
    assert found == {want[i][0]: library_ids(BYTE, texts(spark)[want[i][0]]) + [2] for i in (3, 7)}


def test_reader_takes_only_the_frames_it_needs_and_checks_them(tmp_path):
    from pyarrow import fs
    local, path = fs.LocalFileSystem(), str(tmp_path / "x.zst")
    data = [bytes([i]) * 1000 for i in range(50)]
    with open(path, "wb") as f:
        w = token_store.SeekWriter(f, frame_bytes=4000)
        for d in data:
            w.write(d)
        w.write(b"z" * 9000)  # longer than a frame
        w.close()
    r = token_store.SeekReader(local, path)
    assert r.read(25_000, 1000) == data[25] and r.frames_read == 1
    assert r.read(50_000, 9000) == b"z" * 9000
    import io

    import zstandard
    plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(open(path, "rb").read()), read_across_frames=True)
    assert plain.read() == b"".join(data) + b"z" * 9000  # an ordinary reader takes the file too
    raw = bytearray(open(path, "rb").read())
    raw[-9 - 12 * len(r.sums) + 8] ^= 1  # the first frame's checksum in the seek table
    open(path, "wb").write(raw)
    with pytest.raises(ValueError, match="checksum"):
        token_store.SeekReader(local, path).read(0, 10)


def test_piece_ids_and_spans_equal_the_library(spark):
    some = TRICKY + list(texts(spark).values())[:80]
    c = piece_codec.PieceCodec(PIECE)
    got = c.encode(some)
    assert [i.tolist() for i, _ in got] == c.library.encode(some, add_bos=True, add_eos=True)
    for text, (ids, spans) in zip(some, got):
        raw = text.encode()
        assert spans[0, 0] == 0 and (spans[1:, 0] == spans[:-1, 1]).all() and spans[-1, 1] == len(raw)
        for i, (a, b) in zip(ids.tolist()[1:-1], spans[1:-1].tolist()):
            piece = c.library.id_to_piece(i)
            shown = bytes([int(piece[3:5], 16)]) if piece.startswith("<0x") else piece.replace("▁", " ").encode()
            assert raw[a:b].replace("▁".encode(), b" ") in (shown, shown[1:])


def test_character_map_normalisation_equals_the_library():
    sentencepiece = pytest.importorskip("sentencepiece")
    from sentencepiece import sentencepiece_model_pb2 as pb
    if not hasattr(sentencepiece, "SentencePieceNormalizer"):
        pytest.skip("this library has no normaliser of its own")
    options = {"add_dummy_prefix": True, "escape_whitespaces": True, "remove_extra_whitespaces": True}
    lib = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc", **options)
    model = pb.ModelProto()
    model.ParseFromString(lib.serialized_model_proto())
    own = piece_codec.Normalizer(model.normalizer_spec)
    assert own.map.units
    for text in ["Ⅷ ｱｲｳ ﬁne  x ", "  ａｂｃ　ｄ", "é é x", "①②", "㌔メートル", "plain text", "   ", ""]:
        data, source = own.normalize(text.encode())
        assert data.decode() == lib.normalize(text)
        assert len(source) == len(data) + 1 and source == sorted(source) and source[-1] <= len(text.encode())


def test_round_trip_query_on_odd_rows(spark):
    got = piece_codec.round_trip(odd_documents(spark), PIECE).collect()
    lib = piece_codec.PieceCodec(PIECE).library
    want = []
    for row in odd_rows():
        ids = lib.encode(row[1] or "", add_bos=True, add_eos=True)
        want.append((row[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256(lib.decode(ids).encode()).hexdigest()))
    assert sorted(map(str, want)) == sorted(str(tuple(r)[:4]) for r in got)


def brute_pieces(rows, docs):
    for r in rows:
        part = docs[r["doc_id"]][r["start"]:r["start"] + r["length"]]
        assert zlib.crc32(part.tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(docs[r["doc_id"]])
    for doc, ids in docs.items():
        cover = sorted((r["start"], r["length"]) for r in rows if r["doc_id"] == doc)
        assert [c[0] for c in cover] == np.cumsum([0] + [c[1] for c in cover])[:-1].tolist()
        assert sum(c[1] for c in cover) == len(ids)


@pytest.mark.parametrize("capacity", [64, 4096])
def test_packing_covers_each_id_once_with_little_padding(spark, capacity):
    rows = packing.pack(documents(spark), WORD, 2, capacity, group_docs=64).collect()
    docs = {d: np.array(library_ids(WORD, t) + [2], "<u4") for d, t in texts(spark).items()}
    brute_pieces(rows, docs)
    seqs = {}
    for r in rows:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    padding = 0
    for parts in seqs.values():
        parts.sort()
        assert [o for o, _ in parts] == np.cumsum([0] + [n for _, n in parts])[:-1].tolist()
        total = sum(n for _, n in parts)
        assert total <= capacity
        padding += 0 if total & (total - 1) == 0 else capacity - total
    assert padding <= 0.01 * sum(map(len, docs.values())) + packing.MAX_PADDING


def test_first_fit_decreasing_equals_a_scan():
    sizes = sorted(np.random.default_rng(5).integers(1, 100, 300).tolist(), reverse=True)
    free, want = [100] * len(sizes), []
    for s in sizes:
        b = next(i for i, f in enumerate(free) if f >= s)
        free[b] -= s
        want.append(b)
    assert packing.first_fit_decreasing(sizes, 100) == want


def test_odd_rows_and_empty_tables(spark):
    odd, none = odd_documents(spark), no_documents(spark)
    counts = sorted(str(tuple(r)) for r in token_counts.count_tokens(odd, WORD).collect())
    want = [(r[0], len((r[1] or "").encode()), len(library_ids(WORD, r[1] or ""))) for r in odd_rows()]
    assert counts == sorted(str((*w, w[2] > 2048)) for w in want)
    store = token_store.read_store(token_store.write_store(odd, work_dir(spark, "odd"), BYTE, 2)).collect()
    assert len(store) == len(odd_rows()) and store[0]["doc_id"] is None or len(store) == len(odd_rows())
    assert sum(r["n_tokens"] for r in store) == sum(len(library_ids(BYTE, r[1] or "")) + 1 for r in odd_rows())
    packed = packing.pack(odd, WORD).collect()
    assert sum(r["length"] for r in packed) == sum(w[2] + 1 for w in want)
    assert token_counts.count_tokens(none, WORD).count() == 0
    assert token_store.read_store(token_store.write_store(none, work_dir(spark, "none"), BYTE, 2)).count() == 0
    assert packing.pack(none, WORD).count() == 0
    assert piece_codec.round_trip(none, PIECE).count() == 0
