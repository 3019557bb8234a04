"""Rules of saved objects as queries: every rule returns its violations (path, rule, detail)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnframe.functions.types import ROW_ID
from cairnframe.operators import factors
from cairnframe.plans import registry
from cairnframe.sources.files import Files

_SCHEMA = "path string, rule string, detail string"


def _none(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], _SCHEMA)


def _said(spark: SparkSession, path: str, rule: str, detail: str) -> DataFrame:
    return spark.createDataFrame([(path, rule, detail)], _SCHEMA)


def violations(spark: SparkSession, path: str, metadata: dict | None = None) -> DataFrame:
    """All violations of one object and its children."""
    from cairnframe.sources.store import read_descriptor

    body = metadata or read_descriptor(Files(spark), path)
    kind = body.get("type")
    if kind not in registry.validators:
        raise KeyError(f"no validator for type '{kind}' at '{path}'")
    return registry.validators.get(kind)(spark, path, body)


def _codes(df: DataFrame, column: str, path: str) -> list[DataFrame]:
    levels = df.schema[column].metadata.get("levels")
    if levels is None:
        return []
    out = [factors.code_violations(df, column, len(levels)).select(F.lit(path).alias("path"), F.lit("code").alias("rule"), F.concat(F.lit(f"{column}: "), F.col(f"`{column}`").cast("string")).alias("detail"))]
    if len(set(levels)) < len(levels):
        out.append(_said(df.sparkSession, path, "levels", f"{column}: levels repeat"))
    return out


def frame_violations(spark: SparkSession, path: str, body: dict) -> DataFrame:
    files = Files(spark)
    info = body.get("data_frame", {})
    found = []
    if "row_count" not in info:
        df = spark.read.parquet(f"{path}/columns")
        have = [c for c in df.columns if not c.startswith("__row_")]
        if info.get("columns", have) != have:
            found.append(_said(spark, path, "columns", f"{have} instead of {info['columns']}"))
        for f in df.schema.fields:
            found += _codes(df, f.name, path)
            if f.metadata.get("format") == "date-time":
                from cairnframe.functions.datetimes import is_valid

                c = F.col(f"`{f.name}`")
                found.append(df.where(~is_valid(c)).select(F.lit(path).alias("path"), F.lit("date-time").alias("rule"), c.alias("detail")))
    if files.exists(f"{path}/column_annotations/OBJECT"):
        found.append(violations(spark, f"{path}/column_annotations"))
        n = height(spark, f"{path}/column_annotations")
        if n != len(info.get("columns", [])):
            found.append(_said(spark, path, "column_annotations", f"{n} rows for {len(info.get('columns', []))} columns"))
    other = f"{path}/other_annotations"
    if files.exists(f"{other}/OBJECT"):
        from cairnframe.sources.store import read_descriptor

        kind = read_descriptor(files, other)["type"]
        if kind != "simple_list" and not registry.interfaces.holds(kind, "SIMPLE_LIST"):
            found.append(_said(spark, path, "other_annotations", f"type '{kind}' is no list"))
        found.append(violations(spark, other))
    return reduce(DataFrame.unionByName, found, _none(spark))


def vector_violations(spark: SparkSession, path: str, body: dict) -> DataFrame:
    df = spark.read.parquet(f"{path}/columns")
    if "value" not in df.columns:
        return _said(spark, path, "columns", "no column 'value'")
    return reduce(DataFrame.unionByName, _codes(df, "value", path), _none(spark))


def row_factor_violations(spark: SparkSession, path: str, body: dict) -> DataFrame:
    levels = spark.read.parquet(f"{path}/levels/columns")
    columns = [c for c in levels.columns if c not in ("code", ROW_ID, "__row_name")]
    codes = spark.read.parquet(f"{path}/columns").where("value is not null")
    unknown = codes.join(levels.select(F.col("code").alias("value")), "value", "left_anti")
    twice = factors.duplicate_levels(levels, columns)
    return (
        unknown.select(F.lit(path).alias("path"), F.lit("code").alias("rule"), F.col("value").cast("string").alias("detail"))
        .unionByName(twice.select(F.lit(path).alias("path"), F.lit("levels").alias("rule"), F.concat(F.lit("repeated "), F.col("n").cast("string"), F.lit(" times")).alias("detail")))
        .unionByName(violations(spark, f"{path}/levels"))
    )


def list_violations(spark: SparkSession, path: str, body: dict) -> DataFrame:
    from cairnframe.operators import lists
    from cairnframe.sources.store import external_children

    rows = spark.read.parquet(f"{path}/columns")
    names = lists.name_violations(rows).select(F.lit(path).alias("path"), F.lit("names").alias("rule"), F.concat_ws("/", "path").alias("detail"))
    children = external_children(spark, path)
    known = F.lit(sorted(children)).cast("array<int>")
    lost = rows.where((F.col("kind") == "external") & ~F.array_contains(known, F.col("index"))).select(F.lit(path).alias("path"), F.lit("external").alias("rule"), F.col("index").cast("string").alias("detail"))
    return reduce(DataFrame.unionByName, [violations(spark, p) for p in children.values()], names.unionByName(lost))


for _kind, _rule in (("data_frame", frame_violations), ("atomic_vector", vector_violations), ("string_factor", vector_violations), ("data_frame_factor", row_factor_violations), ("simple_list", list_violations)):
    registry.validators.register(_kind, _rule)


def height(spark: SparkSession, path: str) -> int:
    """Rows of an object, by the registered function of its type if there is one."""
    from cairnframe.sources.store import read_descriptor

    body = read_descriptor(Files(spark), path)
    if body["type"] in registry.heights:
        return registry.heights.get(body["type"])(spark, path, body)
    info = body.get("data_frame", {})
    return info["row_count"] if "row_count" in info else spark.read.parquet(f"{path}/columns").count()


def object_dimensions(spark: SparkSession, path: str) -> list[int]:
    from cairnframe.sources.store import read_descriptor

    body = read_descriptor(Files(spark), path)
    if body["type"] in registry.dimensions:
        return registry.dimensions.get(body["type"])(spark, path, body)
    rows = height(spark, path)
    return [rows, len(body["data_frame"]["columns"])] if body["type"] == "data_frame" else [rows]


def validate_directory(spark: SparkSession, root: str, legacy: bool | None = None, **options) -> list[str]:
    """Validates every object of a directory that is no child; returns their paths.

    ``legacy``: the older layout, with documents beside the data; None finds out: a directory without any
    descriptor is one.
    """
    from cairnframe.operators.catalog import list_objects
    from cairnframe.sources import legacy as older
    from cairnframe.sources.store import validate_object

    if legacy is None:
        legacy = not any(n == "OBJECT" or n.endswith("/OBJECT") for n in Files(spark).walk(root))
    if legacy:
        older.check_directory(spark, root, **options)
        return sorted(p for p, m in older.list_directory(spark, root).items() if not m["$schema"].startswith("redirection/"))
    paths = sorted(r["path"] for r in list_objects(spark, root).select("path").collect())
    for p in paths:
        try:
            validate_object(spark, root if p == "." else f"{root}/{p}")
        except Exception as e:
            raise ValueError(f"failed to validate '{p}': {e}") from e
    return paths
