"""A cleaning pipeline over ``documents``: five stages, each one of the corpus operators at work.

Every stage takes (spark, docs, sf_dir), works on all rows it is given and
returns a DataFrame; all but the last return the columns they were given.
Stages keep null doc_ids, repeated rows and further columns; ``text`` and, where
it exists, ``n_chars`` follow what a stage does to the text.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnframe.llm import language, line_dedup, packing, secrets, simhash_wide
from cairnframe.llm.common import checkpoint_folder, cut, small, table

#: A text whose best language has less than this multiple of an even share of the decoding's weight fits no codeword.
LEAST_LEAD = 1.1

ORACLE_SQL = None


def _with_text(docs: DataFrame, text) -> DataFrame:
    """``docs`` with its text replaced, and n_chars counted anew for texts that changed."""
    new = docs.withColumn("__new", text)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        new = new.withColumn("n_chars", F.when(F.col("__new").eqNullSafe(F.col("text")), F.col("n_chars")).otherwise(F.length("__new").cast(kind)))
    return new.withColumn("text", F.col("__new")).drop("__new")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language the labels teach; null labels get the predicted one.

    Texts that are null or have no letter go, and those that no codeword fits.  Where nothing is
    labelled nothing can be learned, and every text with a letter stays.  Rows are judged one by one,
    by their text alone, so repeated rows stay or go together; of languages that decode alike the
    first in alphabetical order counts.  An empty table stays empty.
    """
    model = language.train(docs)
    if not model.languages:
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    plain = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") if c != "text" else F.col("text") for i, c in enumerate(docs.columns)])
    judged = language.label(plain, model, "__lang string, __score double, __close boolean")
    kept = judged.where((F.col("__lang") != language.UNKNOWN) & (F.col("__score") * len(model.languages) >= LEAST_LEAD if len(model.languages) > 1 else F.lit(True)))
    out = []
    for i, c in enumerate(docs.columns):
        source = F.col("text") if c == "text" else F.col(f"c{i}")
        out.append((F.coalesce(source, F.col("__lang")) if c == "lang" else source).alias(c))
    return kept.select(*out)


def shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 40 characters or more that five documents share stay in the largest doc_id only.

    Every row stays, with what is left of its text (possibly nothing); null texts and rows without
    doc_id stay as they are.  All rows of the largest doc_id keep the line, repeats of it included.
    An empty table stays empty.
    """
    bitmaps = cut(line_dedup.keep_bitmaps(docs.select("doc_id", "text")))
    out = line_dedup.apply_keep_bitmaps(docs, bitmaps)
    changed = _with_text(out, F.when(F.col("__lines.n_dropped") > 0, F.col("__lines.kept")).otherwise(F.col("text")))
    return changed.select(*[F.col(f"`{c}`") for c in docs.columns])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more.

    The least doc_id stays (null last); of rows that repeat it, one.  Texts without words, null
    ones among them, are copies of each other.  Groups are chains of pairs.  An empty table stays empty.
    """
    numbered = docs.withColumn("__rid", F.monotonically_increasing_id())
    groups = simhash_wide.near_groups(numbered.select(F.col("__rid").alias("rid"), "doc_id", "text"))
    gone = cut(groups.where(~F.col("kept")).select(F.col("rid").alias("__rid")))
    return numbered.join(small(gone), "__rid", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def hidden_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark.

    Every row stays; a null text stays null.  Of overlapping spans one mark stays.  The models learn
    from the rows given; an empty table stays empty.
    """
    found = secrets.find_secrets(docs)
    changed = _with_text(found, F.when(F.size("__all") > 0, secrets.redact(F.col("text").cast("string"), F.col("__all"))).otherwise(F.col("text")))
    return changed.select(*[F.col(f"`{c}`") for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences: the pieces of all documents with their ids.

    Null and empty texts are one end id; repeated rows are packed each; of windows that a document
    fills equally well the one opened last takes it.  An empty table gives no piece.
    """
    return packing.pack(docs.select("doc_id", "text"), keep_ids=True)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", shared_lines),
    ("near_dedup", near_copies),
    ("secrets", hidden_secrets),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each one's result is written to the shared folder and read again."""
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
