"""Rows that every operator must take: nulls, empty and very long texts, ties, repeats."""

SF = "/root/testdata/sf0.001"
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, n_tokens string, `start` string, "
          "fingerprint string, `row` string, rest string, doc string, tie string, body string, `group` string")
EXTRA = ("x",) * 9
PASSAGE = " ".join(f"w{i}" for i in range(60))
LONG = " ".join(f"word{i % 977} and{i % 31}" for i in range(60_000))


def odd_rows():
    rows = [
        (1, "the cat sat on the mat " + PASSAGE, "en"), (2, PASSAGE + " and a tail", "en"), (3, None, None),
        (4, "", "en"), (5, " \t\n ", "de"), (6, LONG, "en"), (7, "der Hund läuft über die Straße", "de"),
        (7, "der Hund läuft über die Straße", "de"), (8, "one", "en"), (9, "123 !!", None),
        (None, "no id here " + PASSAGE, "en"), (10, "\U0001f600 <|endoftext|> 中文 x\x00y", "en"),
        (11, "a" * 3000, "en"), (12, "le chat est sur la table et le chien", "fr")]
    return [(i, t, lang, "s", None if t is None else len(t), *EXTRA) for i, t, lang in rows]


def odd_documents(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in documents(spark).collect()}
