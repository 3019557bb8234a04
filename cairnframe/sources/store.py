"""Typed artifacts: a directory with a descriptor and Parquet data below it.

    <path>/OBJECT              {"type": T, T: {"version": ...}}
    <path>/_environment.json   provenance, outermost object only
    <path>/columns/            Parquet, logical types and factor levels in field metadata
    <path>/levels/             level rows of a row factor
    <path>/column_annotations/, <path>/other_annotations/   child objects

Saving is one write job; reading parses the descriptor on the driver and returns
a lazy DataFrame, so column pruning and filters reach the Parquet scan.  The
container is Parquet; it is not compatible with any HDF5 layout.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import singledispatch

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairnframe.functions import missing
from cairnframe.functions.types import PLACEHOLDER_KEY, ROW_ID, ROW_NAME, check_names
from cairnframe.operators import vls
from cairnframe.operators.rows import cut
from cairnframe.plans import registry
from cairnframe.sources import provenance
from cairnframe.sources.files import Files

#: Metadata of a column of pointers: the number of its heaps, and rows that share a heap (each of them is cut from a copy of it).
VLS = "vls"
HEAP_ROWS = 64
# Object types and their versions.
VERSIONS = {"data_frame": "1.1", "atomic_vector": "1.1", "string_factor": "1.0", "data_frame_factor": "1.0", "simple_list": "1.0"}


@dataclass
class Frame:
    """A table: columns, optional row names, annotations of columns (a table) and of the whole (a list)."""

    df: DataFrame
    row_names: str | None = None
    column_annotations: DataFrame | None = None
    annotations: dict | None = None


@dataclass
class Vector:
    """One column of values, optionally named."""

    df: DataFrame
    value: str = "value"
    name: str | None = None


@dataclass
class Factor:
    """Codes with levels in the metadata of ``value`` (see ``factor_encode``), optionally named."""

    df: DataFrame
    value: str = "value"
    name: str | None = None


@dataclass
class RowFactor:
    """Codes and the table whose rows are their levels (with a column ``code``)."""

    codes: DataFrame
    levels: DataFrame
    name: str | None = None


@dataclass
class NestedList:
    """Rows of a typed list (see ``operators.lists``) and external children by index."""

    rows: DataFrame
    children: dict[int, object] = field(default_factory=dict)


_depth = [0]


def spark_of(x) -> SparkSession:
    if isinstance(x, DataFrame):
        return x.sparkSession
    return next(v for v in vars(x).values() if isinstance(v, DataFrame)).sparkSession


def write_descriptor(files: Files, path: str, kind: str, extra: dict | None = None) -> None:
    body = {"type": kind}
    for k, v in ({kind: {"version": VERSIONS[kind]}} if kind in VERSIONS else {}).items():
        body[k] = v
    for k, v in (extra or {}).items():
        if k == "type":
            raise ValueError("descriptor has two entries 'type'")
        body[k] = {**body.get(k, {}), **v} if isinstance(v, dict) else v
    files.write(f"{path}/OBJECT", json.dumps(body))


def read_descriptor(files: Files, path: str) -> dict:
    body = json.loads(files.read(f"{path}/OBJECT"))
    if not isinstance(body, dict) or "type" not in body:
        raise ValueError(f"'{path}/OBJECT' is no descriptor")
    return body


def scoped(options: dict, kind: str) -> dict:
    """Options for objects of one type: ``<type>__<option>`` without its prefix, before options for all types."""
    own = {k.removeprefix(f"{kind}__"): v for k, v in options.items() if k.startswith(f"{kind}__")}
    return {k: v for k, v in options.items() if "__" not in k} | own


def save_object(x, path: str, validate: bool = True, **options) -> None:
    """Saves a table or one of the classes above. An existing path is refused; validation runs once, outermost.

    Options reach all children; one named ``<type>__<option>`` counts for objects of that type only.
    """
    files = Files(spark_of(x))
    if files.exists(path):
        raise FileExistsError(f"cannot save at existing path '{path}'")
    registry.search_plugins("savers")
    outermost = _depth[0] == 0
    _depth[0] += 1
    try:
        with provenance.registering() as write_record:
            files.make(path)
            alt_save(x, path, **options)
            if outermost and validate:
                validate_object(spark_of(x), path)
            write_record(files, path)
    finally:
        _depth[0] -= 1


@singledispatch
def save_as(x, path: str, **options) -> None:
    raise TypeError(f"nothing saves a {type(x).__name__}")


#: Application-wide replacement of how anything, children included, is saved or read.
alt_save = registry.Override(lambda x, path, **options: save_as(x, path, **options))
alt_read = registry.Override(lambda spark, path, **options: _read(spark, path, **options))


@save_as.register
def _(x: DataFrame, path: str, **options) -> None:
    save_as(Frame(x), path, **options)


@save_as.register
def _(x: Frame, path: str, **options) -> None:
    files = Files(x.df.sparkSession)
    df = x.df.withColumnRenamed(x.row_names, ROW_NAME) if x.row_names else x.df
    check_names(df.columns)
    df = _with_heaps(df, path, scoped(options, "data_frame").get("vls", False))
    extra: dict = {"row_names": x.row_names is not None, "columns": [c for c in df.columns if c not in (ROW_ID, ROW_NAME)]}
    if df.columns:
        numbered = df if ROW_ID in df.columns else df.withColumn(ROW_ID, F.monotonically_increasing_id())
        numbered.write.mode("errorifexists").parquet(f"{path}/columns")
    else:
        extra["row_count"] = df.count()
    write_descriptor(files, path, "data_frame", {"data_frame": extra})
    if x.column_annotations is not None:
        save_object(Frame(x.column_annotations), f"{path}/column_annotations", **options)
    if x.annotations:
        from cairnframe.operators import lists

        save_object(NestedList(lists.rows_of_value(df.sparkSession, x.annotations)), f"{path}/other_annotations")


def _with_heaps(df: DataFrame, path: str, wanted: bool | None) -> DataFrame:
    """String columns as pointers into heaps below ``path/heaps``: all (True), none (False), or those it saves bytes for (None).

    Parquet stores strings by their length anyway, so none is the default; the option serves exchange
    with layouts of fixed width.
    """
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name != ROW_NAME]
    if wanted is None and texts:
        got = df.agg(*[vls.use_vls(F.col(f"`{c}`")).alias(f"u{i}") for i, c in enumerate(texts)]).first()
        texts = [c for c, use in zip(texts, got) if use]
    if wanted is False or not texts:
        return df
    df = cut(df if ROW_ID in df.columns else df.withColumn(ROW_ID, F.monotonically_increasing_id()))
    names = df.columns
    for name in texts:
        at = names.index(name)
        vls.heaps(df, ROW_ID, f"`{name}`", HEAP_ROWS).write.parquet(f"{path}/heaps/{at}")
        block = F.floor(F.col(ROW_ID) / HEAP_ROWS)
        size = F.coalesce(F.octet_length(f"`{name}`"), F.lit(0)).cast("long")
        before = F.coalesce(F.sum(size).over(Window.partitionBy(block).orderBy(ROW_ID).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        pointer = F.when(F.col(f"`{name}`").isNotNull(), F.struct(block.alias("block"), before.alias("block_offset"), size.alias("length")))
        df = df.withColumn(name, pointer).withMetadata(name, {**df.schema[name].metadata, VLS: at})
    return df.select(*[F.col(f"`{n}`").alias(n, metadata=df.schema[n].metadata) for n in names])


def _from_heaps(df: DataFrame, path: str) -> DataFrame:
    """Strings instead of pointers: rows meet the heaps of their block once, as a group, so that no heap is copied for each row."""
    pointed = [f.name for f in df.schema.fields if VLS in f.metadata]
    if not pointed:
        return df
    meta = {f.name: {k: v for k, v in f.metadata.items() if k != VLS} for f in df.schema.fields}
    columns = [F.col(f"`{n}`") for n in df.columns]
    block = F.floor(F.col(ROW_ID) / HEAP_ROWS).alias("__block")
    blocks = df.groupBy(block).agg(F.collect_list(F.struct(*columns)).alias("__rows"))
    for i, name in enumerate(pointed):
        heap = df.sparkSession.read.parquet(f"{path}/heaps/{df.schema[name].metadata[VLS]}")
        blocks = blocks.join(heap.select(F.col("block").alias("__block"), F.col("heap").alias(f"__heap{i}")), "__block", "left")

    def row(r):
        out = []
        for name in df.columns:
            value = r.getField(name)
            if name in pointed:
                text = F.substring(F.col(f"__heap{pointed.index(name)}"), value["block_offset"].cast("int") + 1, value["length"].cast("int")).cast("string")
                value = F.when(value.isNotNull(), text)
            out.append(value.alias(name))
        return F.struct(*out)

    found = blocks.select(F.explode(F.transform("__rows", row)).alias("r"))
    return found.select(*[F.col("r").getField(n).alias(n, metadata=meta[n]) for n in df.columns])


def attach_placeholder(spark: SparkSession, path: str, column: str, value) -> None:
    """From now on ``value`` in a column of a saved table reads as missing. The data stay as they are."""
    files = Files(spark)
    body = read_descriptor(files, path)
    if column not in spark.read.parquet(f"{path}/columns").columns:
        raise KeyError(f"no column '{column}' at '{path}'")
    info = body.setdefault("data_frame", {})
    info["placeholders"] = {**info.get("placeholders", {}), column: str(value)}
    files.write(f"{path}/OBJECT", json.dumps(body), replace=True)


def _named(df: DataFrame, value: str, name: str | None) -> DataFrame:
    out = df.select(F.col(f"`{value}`").alias("value"), *([F.col(f"`{name}`").alias("name")] if name else []))
    out = out.withMetadata("value", df.schema[value].metadata)
    keep = df.select(F.col(ROW_ID)) if ROW_ID in df.columns else None
    return out.withColumn(ROW_ID, F.monotonically_increasing_id()) if keep is None else df.select(ROW_ID, F.col(f"`{value}`").alias("value", metadata=df.schema[value].metadata), *([F.col(f"`{name}`").alias("name")] if name else []))


@save_as.register
def _(x: Vector, path: str, **options) -> None:
    _with_heaps(_named(x.df, x.value, x.name), path, scoped(options, "atomic_vector").get("vls", False)).write.parquet(f"{path}/columns")
    write_descriptor(Files(x.df.sparkSession), path, "atomic_vector")


@save_as.register
def _(x: Factor, path: str, **options) -> None:
    if "levels" not in x.df.schema[x.value].metadata:
        raise ValueError("a factor needs levels in its metadata")
    _named(x.df, x.value, x.name).write.parquet(f"{path}/columns")
    write_descriptor(Files(x.df.sparkSession), path, "string_factor")


@save_as.register
def _(x: RowFactor, path: str, **options) -> None:
    _named(x.codes, "code", x.name).write.parquet(f"{path}/columns")
    write_descriptor(Files(x.codes.sparkSession), path, "data_frame_factor")
    save_object(Frame(x.levels), f"{path}/levels", **options)


@save_as.register
def _(x: NestedList, path: str, **options) -> None:
    x.rows.write.parquet(f"{path}/columns")
    write_descriptor(Files(x.rows.sparkSession), path, "simple_list")
    for k, child in x.children.items():
        save_object(child, f"{path}/other_contents/{k}", **options)


def read_object(spark: SparkSession, path: str, metadata: dict | None = None, **options) -> DataFrame:
    """Lazy DataFrame of a saved object; ``metadata`` instead of the descriptor lets callers steer the dispatch."""
    return alt_read(spark, path, metadata=metadata, **options)


def _read(spark: SparkSession, path: str, metadata: dict | None = None, **options) -> DataFrame:
    files = Files(spark)
    body = metadata or read_descriptor(files, path)
    registry.search_plugins("readers")
    with provenance.loading(files, path):
        return registry.readers.get(body["type"])(spark, path, body, **options)


def read_frame(spark: SparkSession, path: str, body: dict, keep_row_id: bool = False, include_nested: bool = True, **options) -> DataFrame:
    """Columns as saved; ``include_nested=False`` leaves struct columns out, which prunes them from the scan."""
    info = body.get("data_frame", {})
    if "row_count" in info:
        return spark.range(info["row_count"]).select()
    include_nested = scoped(options, "data_frame").get("include_nested", include_nested)
    df = spark.read.parquet(f"{path}/columns")
    if not include_nested:
        df = df.select(*[F.col(f"`{f.name}`") for f in df.schema.fields if f.dataType.typeName() != "struct" or VLS in f.metadata])
    if any(VLS in f.metadata for f in df.schema.fields):
        df = _from_heaps(df, path)
    for name, text in info.get("placeholders", {}).items():
        if name in df.columns:
            df = df.withMetadata(name, {**df.schema[name].metadata, PLACEHOLDER_KEY: text})
            df = missing.decode_missing(df, name, df.schema[name].dataType)
    return df if keep_row_id else df.drop(ROW_ID)


def read_vector(spark: SparkSession, path: str, body: dict, keep_row_id: bool = False, **_) -> DataFrame:
    df = _from_heaps(spark.read.parquet(f"{path}/columns"), path)
    return df if keep_row_id else df.drop(ROW_ID)


def read_row_factor(spark: SparkSession, path: str, body: dict, **options) -> DataFrame:
    """Codes decoded to their level rows."""
    from cairnframe.operators.factors import row_factor_decode

    codes = read_vector(spark, path, body, **options).withColumnRenamed("value", "code")
    return row_factor_decode(codes, read_object(spark, f"{path}/levels", **options))


def read_list(spark: SparkSession, path: str, body: dict, **_) -> DataFrame:
    return spark.read.parquet(f"{path}/columns")


def read_annotations(spark: SparkSession, path: str) -> tuple[DataFrame | None, DataFrame | None]:
    """(column annotations, rows of the list of annotations) where they were saved."""
    files = Files(spark)
    return tuple(read_object(spark, f"{path}/{d}") if files.exists(f"{path}/{d}/OBJECT") else None for d in ("column_annotations", "other_annotations"))


def external_children(spark: SparkSession, path: str) -> dict[int, str]:
    """Paths of a list's external children, by number and not by name."""
    names = [int(n) for n in Files(spark).names(f"{path}/other_contents") if n.isdigit()]
    return {n: f"{path}/other_contents/{n}" for n in sorted(names)}


for _kind, _reader in (("data_frame", read_frame), ("atomic_vector", read_vector), ("string_factor", read_vector), ("data_frame_factor", read_row_factor), ("simple_list", read_list)):
    registry.readers.register(_kind, _reader)


def validate_object(spark: SparkSession, path: str, metadata: dict | None = None) -> None:
    """Raises with the first violations of the rules of the object's type; unknown types are refused."""
    from cairnframe.operators.validate import violations

    found = violations(spark, path, metadata).take(5)
    if found:
        raise ValueError("; ".join(f"{r['path']}: {r['rule']}: {r['detail']}" for r in found))
