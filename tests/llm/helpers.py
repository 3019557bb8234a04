"""Fixtures shared by the corpus operator tests."""

ODD = [
    (0, "", "en", "s", 0),
    (1, None, None, None, None),
    (2, "The quick brown fox jumps over the lazy dog and runs away from the hunters today", "en", "s", 1),
    (3, "The quick brown fox jumps over the lazy dog and runs away from the hunters today", "en", "s", 1),
    (3, "The quick brown fox jumps over the lazy dog and runs away from the hunters today", "en", "s", 1),
    (4, "word " * 30_000 + "end", "en", "s", 1),
    (5, "é 漢字 🙂 ß İ á \r\n\t x", "fr", "s", 1),
    (None, "A document without an id but with words in it, and a line\n\n", "en", "s", 1),
    (7, "   \n \n", "de", None, 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows=ODD):
    return spark.createDataFrame(rows, SCHEMA)


def clashing(df):
    """The same documents with columns named like the operators' own."""
    from pyspark.sql import functions as F

    names = ("fp", "code", "pos", "line", "key", "h1", "h2", "ids", "start", "length", "node", "component", "spans", "row_key", "n_lines", "score", "a", "b", "u", "v", "f")
    return df.select("*", *[F.lit(f"x{n}").alias(n) for n in names])


def saved(df, tmp_path, name="documents"):
    df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)
