"""Line deduplication with keep bitmaps (operator 10), DataFrame functions only.

1. Each text is split into lines; lines whose key is long enough become rows
   (128-bit key hash, document, position).  Texts themselves are not shuffled.
2. The rows are range-partitioned by hash *and document* with a secondary sort
   by document and position: a line that a third of all documents hold spreads
   over as many ranges as it needs.  The sorted stream gives the first
   occurrence of each key in each document; counting those per key (partial
   counts are combined before the shuffle) gives the number of documents and
   the surviving document of each key.
3. Keys found in enough documents are joined back to the sorted rows: broadcast
   if their count allows it, shuffled otherwise.
4. Dropped positions are returned per document as a run-length compressed keep
   bitmap; text is touched again only by ``apply_keep_bitmaps``.

Defined results: a null or empty text is one empty line; rows with a null
doc_id keep all lines and are not counted; rows that repeat a doc_id with other
text count as one document, but their lines are decided by row; an empty table
gives an empty result; other columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnframe.llm.common import cut, lower_ascii, shuffle_partitions, small, table

MIN_CHARS = 40
MIN_DOCS = 5
#: The characters [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def _row_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")), F.lit("row"))


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Bitmaps of the documents that lose lines: (doc_id, row_key, n_dropped, keep_runs).

    ``keep_runs`` is the run-length form of the keep bitmap: pairs of (first
    kept line, number of kept lines), ascending.  Documents that lose nothing
    have no row.
    """
    n = shuffle_partitions(docs.sparkSession)
    split = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), _row_key(F.col("text")).alias("row_key"), _lines(F.col("text")).alias("lines"))
    lines = split.select("doc_id", "row_key", F.size("lines").alias("n_lines"), F.posexplode("lines").alias("pos", "line"))
    keyed = (
        lines.where(F.octet_length("line") >= min_chars)
        .select("doc_id", "row_key", "n_lines", "pos", F.btrim("line", F.lit(BLANKS)).alias("line"))
        .where(F.length("line") >= min_chars)
        .select("doc_id", "row_key", "n_lines", "pos", lower_ascii(F.col("line")).alias("key"))
        .select("doc_id", "row_key", "n_lines", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"))
    )
    # cut first: finding the range bounds samples the rows, and would read and split every text twice
    rows = cut(cut(keyed).repartitionByRange(n, "h1", "h2", "doc_id").sortWithinPartitions("h1", "h2", "doc_id", "row_key", "pos"))
    first = rows.groupBy("h1", "h2", "doc_id").agg(F.min("pos").alias("pos"))
    shared = cut(
        first.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last_doc")).where(F.col("n_docs") >= min_docs)
    )
    dropped = rows.join(small(shared), ["h1", "h2"]).where("doc_id <> last_doc")
    return dropped.groupBy("doc_id", "row_key", "n_lines").agg(F.array_sort(F.collect_set("pos")).alias("gone")).select(
        "doc_id", "row_key", F.size("gone").alias("n_dropped"), _keep_runs(F.col("gone"), F.col("n_lines")).alias("keep_runs")
    )


def _keep_runs(gone: Column, n_lines: Column) -> Column:
    """Kept runs between the dropped positions, as (start, length) pairs laid flat."""
    starts = F.concat(F.array(F.lit(0)), F.transform(gone, lambda p: p + 1))
    ends = F.concat(gone, F.array(n_lines))
    runs = F.zip_with(starts, ends, lambda s, e: F.array(s, e - s))
    return F.flatten(F.filter(runs, lambda r: F.get(r, F.lit(1)) > 0))


def apply_keep_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``docs`` with ``kept`` (text without the dropped lines), ``n_lines`` and ``n_dropped`` in a struct column ``__lines``."""
    b = bitmaps.select(F.col("doc_id").alias("__id"), F.col("row_key").alias("__key"), F.col("n_dropped").alias("__dropped"), F.col("keep_runs").alias("__runs"))
    keyed = docs.withColumn("__row", _row_key(F.col("text")))
    joined = keyed.join(b, (keyed["doc_id"].cast("long") == b["__id"]) & (keyed["__row"] == b["__key"]), "left")
    lines = _lines(F.col("text"))
    at = F.sequence(F.lit(0), (F.size("__runs") / 2).cast("int") - 1)
    pieces = F.transform(at, lambda i: F.array_join(F.slice(lines, F.get("__runs", i * 2) + 1, F.get("__runs", i * 2 + 1)), "\n"))
    kept = (
        F.when(F.col("__runs").isNull(), F.coalesce(F.col("text").cast("string"), F.lit("")))
        .when(F.size("__runs") == 0, F.lit(""))
        .otherwise(F.array_join(pieces, "\n"))
    )
    return joined.withColumn(
        "__lines",
        F.struct(kept.alias("kept"), F.size(lines).cast("long").alias("n_lines"), F.coalesce(F.col("__dropped"), F.lit(0)).cast("long").alias("n_dropped")),
    ).drop("__id", "__key", "__dropped", "__runs", "__row")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, n_lines, n_dropped, kept_sha256."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = apply_keep_bitmaps(docs, keep_bitmaps(docs))
    return out.select("doc_id", "__lines.n_lines", "__lines.n_dropped", F.sha2(F.col("__lines.kept"), 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), shared AS (
  SELECT k, max(doc_id) AS last_doc FROM keyed WHERE length(k) >= 40
  GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), judged AS (
  SELECT keyed.*, shared.k IS NOT NULL AND doc_id <> last_doc AS gone
  FROM keyed LEFT JOIN shared USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
