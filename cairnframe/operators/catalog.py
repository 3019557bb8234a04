"""Catalogs of saved objects: listing, content digests, first copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairnframe.functions.types import ROW_ID
from cairnframe.operators.rows import cut, join_by_weight
from cairnframe.operators.setrules import ancestors
from cairnframe.sources.files import Files


def list_objects(spark: SparkSession, root: str, include_children: bool = False) -> DataFrame:
    """(path, type, child) of every object below ``root``; a child has an object among its ancestors.

    Descriptors are read by the executors; ancestors are matched by an equi-join, not by prefixes.
    """
    empty = spark.createDataFrame([], "path string, type string, child boolean")
    if not Files(spark).exists(root):
        return empty
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toString().rstrip("/")
    found = spark.read.format("binaryFile").option("pathGlobFilter", "OBJECT").option("recursiveFileLookup", "true").load(root)
    relative = F.regexp_replace(F.substring(F.col("path"), len(base) + 2, 1 << 30), "/?OBJECT$", "")
    objects = found.select(F.when(relative == "", F.lit(".")).otherwise(relative).alias("path"), F.get_json_object(F.col("content").cast("string"), "$.type").alias("type"))
    above = objects.select("path", F.explode(F.when(F.col("path") == ".", F.array().cast("array<string>")).otherwise(F.concat(F.array(F.lit(".")), ancestors("path")))).alias("up"))
    children = above.join(objects.select(F.col("path").alias("up")), "up", "left_semi").select("path").distinct()
    out = objects.join(children.withColumn("child", F.lit(True)), "path", "left").select("path", "type", F.coalesce("child", F.lit(False)).alias("child"))
    return out if include_children else out.where(~F.col("child"))


def _encoded(c: Column, kind: T.DataType) -> Column:
    """Text that tells NULL, NaN, types and nesting apart."""
    if isinstance(kind, T.StructType):
        inner = F.concat_ws(",", *[_encoded(c.getField(f.name), f.dataType) for f in kind.fields])
        return F.when(c.isNull(), F.lit("N")).otherwise(F.concat(F.lit("{"), inner, F.lit("}")))
    if isinstance(kind, T.ArrayType):
        return F.when(c.isNull(), F.lit("N")).otherwise(F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: _encoded(x, kind.elementType)), ","), F.lit("]")))
    text = F.hex(c) if isinstance(kind, T.BinaryType) else c.cast("string")
    return F.when(c.isNull(), F.lit("N")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def row_digest(df: DataFrame) -> Column:
    """SHA-256 of a row over an explicit encoding of each value."""
    return F.sha2(F.concat_ws("|", *[_encoded(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields if f.name != ROW_ID]), 256)


def content_digest(df: DataFrame, order: str | None = None) -> str:
    """Digest of schema and rows, with their order if ``order`` (a row number) is given.

    Row digests enter sums of four 61-bit residues, so the aggregate is one row per task.
    """
    digest = row_digest(df) if order is None else F.sha2(F.concat(row_digest(df), F.lit("@"), F.col(order).cast("string")), 256)
    parts = [F.sum(F.conv(F.substring("d", 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")).cast("string") for k in range(4)]
    row = df.select(digest.alias("d")).agg(F.count("*").cast("string"), *parts).first()
    import hashlib

    schema = repr([(f.name, f.dataType.simpleString(), sorted(f.metadata.items())) for f in df.schema.fields if f.name != ROW_ID])
    return hashlib.sha256("|".join([schema, *map(str, row)]).encode()).hexdigest()


def first_copies(df: DataFrame, key: str, content: str) -> DataFrame:
    """(key, first): the least key with equal content, by digest; the digest groups combine map-side."""
    digest = F.sha2(_encoded(F.col(content), df.schema[content].dataType), 256)
    d = df.select(key, digest.alias("digest"))
    first = cut(d.groupBy("digest").agg(F.min(key).alias("first"), F.count("*").alias("n")))
    return join_by_weight(d, first, ["digest"], "n").select(key, "first")


class DedupSession:
    """Objects seen so far by content; ``check`` gives the path of the first copy."""

    def __init__(self):
        self._seen: dict[str, list[tuple[str, DataFrame]]] = {}

    def check(self, df: DataFrame, order: str | None = None) -> str | None:
        for path, other in self._seen.get(content_digest(df, order), []):
            if df.exceptAll(other).isEmpty() and other.exceptAll(df).isEmpty():
                return path
        return None

    def add(self, df: DataFrame, path: str, order: str | None = None) -> None:
        from cairnframe.sources.files import absolutize

        self._seen.setdefault(content_digest(df, order), []).append((absolutize(path), df))
