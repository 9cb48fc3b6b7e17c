"""Phrase collocations by SON partitioning: local mining, union, exact global counts.

A text's ASCII letters are lower-cased; it is cut at ``.,;:!?`` and line ends into pieces and
those at blanks and tabs into words.  Everything is counted per language.

The documents are dealt into ``SHARDS`` shards (input partitions by number).  A phrase that
occurs ``support`` times has ``ceil(support / SHARDS)`` occurrences in one shard at least, so
each shard is mined completely at that local support, level by level: its words, then the
pairs of words that are locally frequent in some shard, then triples and quadruples whose
pairs are.  A shard is as many tasks as its input needs; they count hashes of phrases, partial
sums meet in one aggregate by (phrase, shard).  The union of the locally frequent phrases is
kept as a bitmap of ``FILTER_BITS`` hash places, so what goes to the tasks has a fixed size;
a crowded bitmap only lets more phrases be counted.

Last, every phrase of one to four words in that union is counted globally as text.  Hashes
decide nothing there: within a block of text equal hashes are compared byte by byte.  The
scores are decimal arithmetic of 38 digits.

Defined cases: a null text is empty and a null language is ``und``; a language without a
phrase of two words that is frequent enough has no row; repeated rows count each time; equal
scores and counts go by the phrase's bytes; phrases of any length and texts of any length are
whole (a text is worked on in blocks that end where a piece ends); an empty table gives no row;
other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, slices

SHARDS = 8
FILTER_BITS = 26
BLOCK = 1 << 20
HELD = 1 << 21
KEPT_PHRASES = 120_000
WORDS = 4

_WORD, _BLANK, _CUT = 0, 1, 2
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = _BLANK
_KIND[list(b".,;:!?\n\x0b\x0c\r")] = _CUT
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_P = 0x9E3779B97F4A7C15 | 1
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(length: int) -> list[np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2^64."""
    if len(_powers[0]) < length:
        for i, base in enumerate((_P, pow(_P, -1, 1 << 64))):
            table = np.full(length, base, np.uint64)
            table[0] = 1
            _powers[i] = np.cumprod(table, dtype=np.uint64)
    return _powers


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def blocks(texts: list[bytes], size: int = BLOCK):
    """The lower-cased texts in blocks of about ``size`` bytes that end where a piece ends."""
    def cut(buffer: bytes):
        at = 0
        while len(buffer) - at > size:
            kind = _KIND[np.frombuffer(buffer, np.uint8, size, at)]
            ends = np.flatnonzero(kind == _CUT)
            if len(ends):
                end = at + int(ends[-1]) + 1
            else:  # a piece longer than a block stays whole
                rest = np.flatnonzero(_KIND[np.frombuffer(buffer, np.uint8, -1, at + size)] == _CUT)
                end = at + size + int(rest[0]) + 1 if len(rest) else len(buffer)
            yield buffer[at:end]
            at = end
        yield buffer[at:]

    held, n = [], 0
    for text in texts:
        held.append(text.translate(_LOWER))
        n += len(text) + 1
        if n >= size:
            yield from cut(b"\n".join(held))
            held, n = [], 0
    if held:
        yield from cut(b"\n".join(held))


class Block:
    """Words of a block: where they stand, the piece of each, and a hash with the language in it."""

    def __init__(self, text: bytes, lang: str):
        self.text = text
        self.bytes = np.frombuffer(text, np.uint8)
        kind = _KIND[self.bytes]
        inside = np.zeros(len(kind) + 2, np.int8)
        inside[1:-1] = kind == _WORD
        edge = np.diff(inside)
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.piece = np.cumsum(kind == _CUT, dtype=np.int64)[self.start] if len(self.start) else self.start
        power, inverse = _power_tables(len(kind) + 1)
        total = np.zeros(len(kind) + 1, np.uint64)
        np.cumsum((self.bytes.astype(np.uint64) + np.uint64(1)) * power[:len(kind)], out=total[1:])
        raw = (total[self.end] - total[self.start]) * inverse[self.start]
        from xxhash import xxh64_intdigest
        seed = np.uint64(xxh64_intdigest(lang.encode("utf-8", "surrogatepass")))
        self.hash = _mixed(raw + seed)

    def same_piece(self, n: int) -> np.ndarray:
        """Where a phrase of ``n`` words begins."""
        return self.piece[:-n + 1] == self.piece[n - 1:] if n > 1 else np.ones(len(self.piece), bool)

    def longer(self, of: np.ndarray, n: int) -> np.ndarray:
        """Hashes of ``n`` words from those of ``n - 1``."""
        return _mixed(of[:-1] * np.uint64(_P) + self.hash[n - 1:] + np.uint64(n))

    def word_ids(self, among: np.ndarray) -> np.ndarray:
        """Numbers of the words ``among``, equal exactly for equal words."""
        start, length = self.start[among], (self.end - self.start)[among]
        _, first, number = np.unique(self.hash[among], return_index=True, return_inverse=True)
        head = first[number]
        equal = bool((length == length[head]).all())
        if equal and len(among):
            place = np.repeat(start - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())
            away = np.repeat(start[head] - start, length)
            equal = bool((self.bytes[place] == self.bytes[place + away]).all())
        if not equal:  # two words share a hash
            seen: dict[bytes, int] = {}
            number = np.array([seen.setdefault(self.text[a:a + n], len(seen))
                               for a, n in zip(start.tolist(), length.tolist())], np.int64)
        return number


class Filter:
    """Hash places of the phrases that are frequent in some shard."""

    def __init__(self, bits: np.ndarray, log: int):
        self.bits, self.log = bits, log

    def has(self, h: np.ndarray) -> np.ndarray:
        place = h >> np.uint64(64 - self.log)
        return (self.bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _both(good: np.ndarray, times: int) -> np.ndarray:
    for _ in range(times):
        good = good[:-1] & good[1:]
    return good


def mined(block: Block, level: int, filters: list[Filter]) -> list[np.ndarray]:
    """Hashes of the phrases to count at a level, one for each occurrence."""
    if level == 1:
        return [block.hash]
    if len(block.hash) < 2:
        return []
    words = filters[0].has(block.hash)
    two = block.longer(block.hash, 2)
    pairs = block.same_piece(2) & _both(words, 1)
    if level == 2:
        return [two[pairs]]
    out = []
    pairs &= filters[1].has(two)
    three = block.longer(two, 3)
    if len(three):
        out.append(three[_both(pairs, 1)])
    if len(three) > 1:
        out.append(block.longer(three, 4)[_both(pairs, 2)])
    return out


def _by_language(batches):
    """(language, texts) of each batch of (lang, text binary)."""
    for batch in slices(batches, 1024):
        texts: dict[str, list[bytes]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if text:
                texts.setdefault(lang, []).append(text)
        yield from texts.items()


def _local(rows: DataFrame, level: int, filters: list[Filter], least: int, log: int) -> Filter:
    """Mine the shards at a level: the phrases with ``least`` occurrences in one shard."""
    def count(batches):
        shard = np.uint64(TaskContext.get().partitionId() % SHARDS)
        held, n = [], 0

        def sums():
            key = np.concatenate(held)
            key.sort()
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            yield pa.RecordBatch.from_pydict({"key": pa.array(key[first].view(np.int64)),
                                              "n": pa.array(np.diff(np.append(first, len(key))))})

        for lang, texts in _by_language(batches):
            for text in blocks(texts):
                for h in mined(Block(text, lang), level, filters):
                    # 61 bits of the hash and the shard in one number
                    held.append(h & np.uint64(0xFFFFFFFFFFFFFFF8) | shard)
                    n += len(h)
                if n > HELD:
                    yield from sums()
                    held, n = [], 0
        if n:
            yield from sums()

    counts = rows.mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    place = F.shiftrightunsigned("key", 64 - log)
    found = counts.where(F.col("n") >= least).select(place.alias("place")).distinct()
    page = 15

    def pack(part: pa.Table) -> pa.Table:
        number = part.column("page")[0].as_py()
        bits = np.zeros(1 << page, np.uint8)
        bits[part.column("place").to_numpy() & ((1 << page) - 1)] = 1
        return pa.Table.from_pydict({"page": pa.array([number], pa.int32()),
                                     "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()])})

    pages = materialize(found.withColumn("page", F.shiftright("place", page).cast("int")).groupBy("page")
                        .applyInArrow(pack, "page int, bits binary"), f"level-{level}")
    bits = np.zeros(1 << log - 3, np.uint8)
    for row in pages.toLocalIterator():  # 2^log bits in all
        at = row["page"] << page - 3
        bits[at:at + (1 << page - 3)] = np.frombuffer(row["bits"], np.uint8)
    return Filter(bits, log)


def candidates(block: Block, filters: list[Filter]):
    """(words, times): each phrase of the union in a block, as text with its count."""
    good = filters[0].has(block.hash)
    among = np.flatnonzero(good)
    if not len(among):
        return
    ids = np.zeros(len(good), np.int64)
    ids[among] = block.word_ids(among)
    word_at = np.zeros(int(ids.max()) + 1, np.int64)
    word_at[ids[among]] = among
    word = [block.text[block.start[i]:block.end[i]].decode("utf-8", "surrogatepass") for i in word_at.tolist()]
    times = np.bincount(ids[among])
    yield from ((word[i], t) for i, t in enumerate(times.tolist()) if t)
    width = len(word)
    phrase, text, h, fits = ids, word, block.hash, good
    for n in range(2, WORDS + 1):
        if len(h) < 2:
            return
        h = block.longer(h, n)
        starts = fits[:-1] & good[n - 1:] & block.same_piece(n)
        if n > 2:
            starts &= fits[1:]  # the last n - 1 words are of the union as well
        starts &= filters[min(n, 3) - 1].has(h)
        at = np.flatnonzero(starts)
        if not len(at):
            return
        code, first, number, times = np.unique(phrase[at] * width + ids[at + n - 1], return_index=True,
                                               return_inverse=True, return_counts=True)
        head, last = (code // width).tolist(), (code % width).tolist()
        text = [f"{text[a]} {word[b]}" for a, b in zip(head, last)]
        yield from zip(text, times.tolist())
        phrase = np.zeros(len(h), np.int64)
        phrase[at] = number
        fits = starts


def phrase_counts(rows: DataFrame, filters: list[Filter]) -> DataFrame:
    """(lang, phrase, f): exact counts of the union's phrases; the null phrase counts all words."""
    def count(batches):
        found: dict[str, dict[str, int]] = {}
        words: dict[str, int] = {}
        size = 0

        def rows_of(counts, names):
            for lang, phrases in counts.items():
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(phrases), pa.string()),
                                                  "phrase": pa.array(names(phrases), pa.string()),
                                                  "f": pa.array(list(phrases.values()), pa.int64())})

        for lang, texts in _by_language(batches):
            for text in blocks(texts):
                block = Block(text, lang)
                words[lang] = words.get(lang, 0) + len(block.hash)
                mine = found.setdefault(lang, {})
                size -= len(mine)
                for phrase, times in candidates(block, filters):
                    mine[phrase] = mine.get(phrase, 0) + times
                size += len(mine)
                if size > KEPT_PHRASES:
                    yield from rows_of(found, list)
                    found, size = {}, 0
        yield from rows_of(found, list)
        yield from rows_of({lang: {"": n} for lang, n in words.items()}, lambda _: [None])

    return rows.mapInArrow(count, "lang string, phrase string, f long").groupBy("lang", "phrase").agg(
        F.sum("f").alias("f"))


def _scored(counts: DataFrame) -> DataFrame:
    """(lang, phrase, size, a, l, r, score) of all phrases of two words or more, by their weakest cut."""
    split = F.split("phrase", " ")
    cuts = (counts.withColumn("w", split).withColumn("size", F.size("w")).where("size > 1")
            .withColumn("k", F.explode(F.expr("sequence(1, size - 1)")))
            .selectExpr("lang", "phrase", "size", "f as a", "k", "array_join(slice(w, 1, k), ' ') as head",
                        "array_join(slice(w, k + 1, size - k), ' ') as tail"))
    part = counts.select(F.col("lang").alias("of"), F.col("phrase").alias("part"), F.col("f").alias("l"))
    left = cuts.join(part, (F.col("lang") == F.col("of")) & (F.col("head") == F.col("part"))).drop("of", "part")
    part = counts.select(F.col("lang").alias("of"), F.col("phrase").alias("part"), F.col("f").alias("r"))
    both = left.join(part, (F.col("lang") == F.col("of")) & (F.col("tail") == F.col("part"))).drop("of", "part")
    score = F.expr("cast(cast(2000000 as decimal(18,0)) * cast(a as decimal(19,0)) div "
                   "(cast(l as decimal(20,0)) + cast(r as decimal(20,0))) as bigint)")
    weakest = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")
    return both.groupBy("lang", "phrase", "size", "a").agg(weakest).select(
        "lang", "phrase", "size", "a", "cut.l", "cut.r", "cut.score")


def collocations(docs: DataFrame, support: int = 30, top: int = 2000, covered: int = 80,
                 text_col: str = "text", lang_col: str = "lang", filter_bits: int = FILTER_BITS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases.

    A phrase within a longer one that has ``covered`` per cent of its occurrences is left out.
    """
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    least = -(-support // SHARDS)
    filters: list[Filter] = []
    for level in (1, 2, 3):
        filters.append(_local(rows, level, filters, least, filter_bits))
    counts = materialize(phrase_counts(rows, filters).where((F.col("f") >= support) | F.isnull("phrase")), "phrases")
    frequent = counts.where("phrase is not null")
    totals = counts.where("phrase is null").select(F.col("lang").alias("of"), F.col("f").alias("n"))
    scored = materialize(_scored(frequent), "scored-phrases")
    inner = (scored.where("size > 2").withColumn("w", F.split("phrase", " "))
             .withColumn("part", F.explode(F.expr(
                 "flatten(transform(sequence(2, size - 1), m -> transform(sequence(1, size - m + 1), "
                 "i -> array_join(slice(w, i, m), ' '))))")))
             .groupBy(F.col("lang").alias("of"), "part").agg(F.max("a").alias("most")))
    kept = (scored.join(inner, (F.col("lang") == F.col("of")) & (F.col("phrase") == F.col("part")), "left")
            .where(F.col("most").isNull() | (F.col("most").cast("decimal(19,0)") * 100 < F.col("a").cast("decimal(19,0)") * covered))
            .drop("of", "part", "most"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    best = kept.withColumn("rank", place.cast("long")).where(F.col("rank") <= top)
    return best.join(totals, F.col("lang") == F.col("of")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 strongest collocations of each language."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                                'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
words AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang),
grams AS (
  SELECT lang, m, w[i:i + m - 1] AS g
  FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i
        FROM (SELECT lang, w, unnest(range(1, 5)) AS m FROM words) AS sized WHERE len(w) >= m) AS placed),
f AS (
  SELECT lang, m, array_to_string(g, ' ') AS phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 30),
cuts AS (
  SELECT lang, m, phrase, f AS a, unnest(range(1, m)) AS k, string_split(phrase, ' ') AS w FROM f WHERE m > 1),
scored AS (
  SELECT c.lang, c.m, c.phrase, c.a, c.k, x.f AS l, y.f AS r,
         CAST((2000000::HUGEINT * c.a) // (x.f::HUGEINT + y.f) AS BIGINT) AS score
  FROM cuts c
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.k], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.k + 1:c.m], ' ')),
best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
spans AS (
  SELECT lang, a, w, m, i, unnest(range(2, m)) AS s
  FROM (SELECT lang, a, string_split(phrase, ' ') AS w, m, unnest(range(1, m + 1)) AS i FROM best WHERE m > 2) AS q),
inside AS (
  SELECT lang, array_to_string(w[i:i + s - 1], ' ') AS phrase, max(a) AS most
  FROM spans WHERE i + s - 1 <= m GROUP BY ALL),
kept AS (
  SELECT b.* FROM best b LEFT JOIN inside USING (lang, phrase)
  WHERE inside.most IS NULL OR 100::HUGEINT * inside.most < 80::HUGEINT * b.a)
SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY k.score DESC, k.a DESC, k.phrase) AS rank,
       k.phrase, k.a, k.l, k.r, t.n, k.score
FROM kept k JOIN totals t ON t.lang = k.lang
QUALIFY rank <= 2000
"""
