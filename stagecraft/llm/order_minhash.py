"""Document fingerprints by Order MinHash, in DataFrame and SQL functions only.

A text's tokens are pieces of up to ``TOKEN`` characters of its runs, which hold anything
but ASCII white space; its k-mers are pairs of neighbouring tokens (the last token stands
alone).  A run of up to ``LONG_RUN`` characters is cut every ``TOKEN`` characters, so an edit
changes its own few pieces at most.  Longer runs, a run that is the whole text, and runs with
a character of a script that sets no spaces are cut by what they say, wherever it stands: a
piece ends behind such a character or one of ``CUTS``; where none follows within ``TOKEN``
characters, pieces overlap, one from each character (one from each ``TOKEN`` of a repeated
character).  An edit then changes the pieces around it only.  Repeats of a k-mer
are numbered by occurrence, and each numbered k-mer is hashed once.  The top bits of the
hash choose one of ``BINS`` bins; in each bin the two smallest k-mers are kept (a k-mer alone in
its bin is joined by the next filled bin's smallest), put back in text order, and hashed as a tuple.  The fingerprint lists each filled bin and its tuple
hash, so it changes with what a text says and with the order it says it in.  The likeness
of two fingerprints is the share of bins, among those that either fills, where both have
the same tuple.

All of it is array arithmetic inside a row: sorting k-mers as longs (hash above, position
below) brings repeats together in text order, their run lengths give the occurrence
numbers, and a second sort brings each bin's smallest first.  Positions are kept modulo
2**24, which only decides the order of a tuple in texts of over 16 million tokens.

The next document is found on keys alone: ids are range-partitioned and numbered by
partition, each partition looks one row back, and partition edges are patched from one
row per partition.  A text is shuffled once, the part of it that replaces the end of its
predecessor a second time.

Defined cases: a null text is empty; empty texts have the empty fingerprint, likeness 1 to
each other and 0 to any other; a null ``doc_id`` ranks below all others; rows of equal id
are ordered by a hash of their text; rows equal in id and text count as one document and
each gets its row; a table's only document is its own next; an empty table gives no row;
other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, shuffle_partitions

TOKEN = 8
LONG_RUN = 48
UNSPACED = "".join(rf"\p{{Is{s}}}" for s in (
    "Han", "Hiragana", "Katakana", "Bopomofo", "Thai", "Lao", "Khmer", "Myanmar", "Tibetan", "Yi"))
#: Every fourth ASCII character, so that pieces of Latin text, digits and base64 are about four long.
CUTS = r"!%)\-159=AEIMQUY\]aeimquy}"
BIN_BITS = 7
BINS = 1 << BIN_BITS
POSITION_BITS = 24
NO_ID = -(1 << 63)


def _pieces(text: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all({text}, {_literal(pattern)}, {group})"


def _literal(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\") + "'"


def tokens(text: str) -> str:
    """SQL for the tokens of column ``text``; most texts need the fixed cuts only."""
    fixed = rf"\S{{1,{TOKEN}}}"
    to_cut = rf"[^\s{CUTS}{UNSPACED}]{{0,{TOKEN - 1}}}+[{CUTS}{UNSPACED}]"
    moving = rf"(?=({to_cut}|{fixed}))(?:{to_cut}|{fixed}+(?!\S)|(\S)\2{{1,{TOKEN - 1}}}+|\S)"
    alone = rf"\A\s*\S{{{TOKEN + 1},}}+\s*\z"
    some = rf"\S{{{LONG_RUN + 1}}}|[{UNSPACED}]"
    run = f"if(r rlike {_literal(some)}, {_pieces('r', moving, 1)}, {_pieces('r', fixed)})"
    return (f"case when {text} rlike {_literal(alone)} then {_pieces(text, moving, 1)} "
            f"when {text} rlike {_literal(some)} then flatten(transform({_pieces(text, chr(92) + 'S+')}, r -> {run})) "
            f"else {_pieces(text, fixed)} end")


def signature(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add ``out``: an int per filled bin, (bin << 16) | tuple hash, in ascending hash order."""
    pos = (1 << POSITION_BITS) - 1
    bins = 64 - BIN_BITS
    t, a, h, o, c, p = (f"_{out}_{x}" for x in ("tok", "all", "head", "occ", "own", "min"))
    step = df.withColumn(t, F.expr(tokens(text)))
    step = step.withColumn(a, F.expr(
        f"sort_array(transform({t}, (x, i) -> (xxhash64(x, get({t}, i + 1)) & {~pos}L) | (cast(i as long) & {pos}L)))"))
    step = step.withColumn(h, F.expr(
        f"filter(sequence(0, greatest(size({a}) - 1, 0)), i -> i < size({a}) and "
        f"(i = 0 or (get({a}, i) & {~pos}L) <> (get({a}, i - 1) & {~pos}L)))")).drop(t)
    step = step.withColumn(o, F.expr(
        f"case when size({h}) < size({a}) then flatten(transform({h}, (s, j) -> "
        f"sequence(0, coalesce(get({h}, j + 1), size({a})) - s - 1))) end")).drop(h)
    step = step.withColumn(c, F.expr(
        f"case when {o} is null then {a} else sort_array(transform({a}, (x, i) -> if(get({o}, i) = 0, x, "
        f"(xxhash64(x & {~pos}L, get({o}, i)) & {~pos}L) | (x & {pos}L)))) end")).drop(a, o)
    step = step.withColumn(p, F.expr(
        f"filter({c}, (x, i) -> i < 2 or shiftrightunsigned(x, {bins}) <> shiftrightunsigned(get({c}, i - 2), {bins}))"
    )).drop(c)
    # a bin's second smallest follows its smallest; behind a k-mer alone in its bin stands the next
    # filled bin's smallest (behind the last one the first bin's)
    low, after = f"(x & {~pos}L)", f"get({p}, (i + 1) % size({p}))"
    nxt = f"({after} & {~pos}L)"
    pair = (f"case when size({p}) = 1 then xxhash64({low}) "
            f"when (x & {pos}L) < ({after} & {pos}L) then xxhash64({low}, {nxt}) "
            f"else xxhash64({nxt}, {low}) end")
    first = f"i = 0 or shiftrightunsigned(x, {bins}) <> shiftrightunsigned(get({p}, i - 1), {bins})"
    return step.withColumn(out, F.expr(
        f"filter(transform({p}, (x, i) -> if({first}, "
        f"cast(shiftrightunsigned(x, {bins}) * 65536 + pmod({pair}, 65536) as int), -1)), v -> v >= 0)")).drop(p)


def likeness(a: str, b: str):
    """Share of the bins filled in either signature whose tuples agree."""
    bins = F.size(F.array_union(F.transform(a, lambda v: F.shiftright(v, 16)),
                                F.transform(b, lambda v: F.shiftright(v, 16))))
    return (F.when(bins == 0, F.lit(1.0))
            .otherwise(F.size(F.array_intersect(a, b)).cast("double") / F.greatest(bins, F.lit(1))))


def fingerprint_text(sig: str):
    """Six hexadecimal digits per filled bin."""
    return F.array_join(F.transform(sig, lambda v: F.lower(F.lpad(F.hex(v), 6, "0"))), "")


def _rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), text.alias("text")).select(
        "id", F.xxhash64("text").alias("tie"), "text")


def neighbours(rows: DataFrame) -> DataFrame:
    """Per document key: n (code points), copies, and the key and n of the document before it."""
    n = shuffle_partitions(rows.sparkSession)
    keys = (rows.select("id", "tie", F.char_length("text").cast("long").alias("n"))
            .groupBy("id", "tie").agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("copies")))
    keys = materialize(keys.repartitionByRange(n, "id", "tie").withColumn("part", F.spark_partition_id()), "doc-keys")
    edge = F.struct("id", "tie", "n")
    edges = keys.groupBy("part").agg(F.max(edge).alias("high"))
    all_parts = Window.orderBy("part")  # one row per partition
    whole = all_parts.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    edges = edges.select("part", F.coalesce(F.lag("high").over(all_parts), F.last("high").over(whole)).alias("before"))
    inside = Window.partitionBy("part").orderBy("id", "tie")
    return (keys.select("*", F.lag(edge).over(inside).alias("prev")).join(edges, "part")
            .select("id", "tie", "n", "copies", F.coalesce("prev", "before").alias("prev")))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Signatures of each document, of its edited text and of the next document.

    A document's signature is computed once, in the scan, and travels with its text; its head
    and signature travel together to its predecessor.
    """
    rows = _rows(docs)
    keys = materialize(neighbours(rows), "neighbours")
    # before the texts are shuffled: both sides below read the same shuffled rows
    rows = signature(rows, "text", "sig")
    if keys.where("copies > 1").limit(1).count():
        rows = rows.dropDuplicates(["id", "tie"])
    placed = rows.join(keys, ["id", "tie"])
    own = placed.select("id", "tie", "text", "n", "copies", "sig")
    head = placed.select(
        F.col("prev.id").alias("id"), F.col("prev.tie").alias("tie"),
        F.expr("substring(text, 1, cast(prev.n div 2 as int))").alias("head"), F.col("sig").alias("next_sig"))
    both = own.join(head, ["id", "tie"]).withColumn(
        "edited", F.expr("concat(substring(text, 1, cast(n - n div 2 as int)), head)"))
    both = both.select("id", "n", "copies", "sig", "next_sig", "edited",
                       F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"))
    return signature(both, "edited", "edited_sig").drop("edited")


def compare_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and its edited text, and their likenesses."""
    return fingerprints(docs).withColumn(
        "copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(
        F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), F.col("n").alias("n_chars"), "edited_sha256",
        fingerprint_text("sig").alias("fingerprint"), fingerprint_text("edited_sig").alias("edited_fingerprint"),
        likeness("sig", "edited_sig").alias("near_edited"), likeness("sig", "next_sig").alias("near_next"))


def op8_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return compare_edits(spark.read.parquet(f"{sf_dir}/documents.parquet"))
