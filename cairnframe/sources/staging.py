"""How each kind of object is laid out in the older layout, and how it is read back.

    table        <path>/simple.csv.gz | simple.csv | simple.parquet/   column<z>/ levels and nested columns, mcols/, other/
    vector       <path>/simple.txt.gz
    factor       <path>/indices.txt.gz, levels/ a vector
    row factor   <path>/index.csv.gz, levels/ a table
    list         <path>/list.json.gz | list.parquet/, child<k>/ external children

CSV is one file an object, which is what this layout asks for and what a single
task writes; ``frame_format("parquet")`` and ``list_format("parquet")`` write
folders in parallel.  Rows of nested columns are joined to their table by a
stored key, never by their order in files.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce, singledispatch

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairnframe.functions import datetimes
from cairnframe.functions.types import ATOMIC, DATE, DATE_TIME, ROW_ID, check_names, logical_type, text_format
from cairnframe.operators import factors, lists
from cairnframe.operators.rows import cut, scratch
from cairnframe.sources import legacy, store, strict_csv
from cairnframe.sources.files import Files

KEY = "__key"
# Ids of the documents' schemas.
CSV_FRAME, PARQUET_FRAME = "csv_data_frame/v1.json", "parquet_data_frame/v1.json"
VECTOR, FACTOR, ROW_FACTOR = "atomic_vector/v1.json", "string_factor/v1.json", "data_frame_factor/v1.json"
JSON_LIST, PARQUET_LIST = "json_simple_list/v1.json", "parquet_simple_list/v1.json"


class Setting:
    """A default of the session: called without arguments it is returned, with one set (None: the first choice); returns the one before."""

    def __init__(self, *choices: str):
        self.choices, self.value = choices, choices[0]

    def __call__(self, *value: str | None) -> str:
        before = self.value
        if value:
            new = value[0] or self.choices[0]
            if new not in self.choices:
                raise ValueError(f"'{new}' is none of {', '.join(self.choices)}")
            self.value = new
        return before


frame_format = Setting("csv.gz", "csv", "parquet")
list_format = Setting("json.gz", "parquet")


def _as_file(write, spark: SparkSession, root: str, target: str) -> None:
    """``write`` makes a folder of one part; the part becomes the file ``target``."""
    files = Files(spark)
    folder = scratch(spark, "staged")
    write(folder)
    part = next(n for n in files.names(folder) if n.startswith("part-"))
    files.rename(f"{folder}/{part}", f"{root}/{target}")
    files.delete(folder)


def _write_csv(df: DataFrame, root: str, target: str, gzipped: bool = True) -> None:
    _as_file(lambda folder: strict_csv.write_strict_csv(df, folder, gzipped=gzipped, single=True, validate=False), df.sparkSession, root, target)


def _child(x, root: str, path: str, **options) -> dict:
    """Reference to a child, staged and described."""
    return {"resource": legacy.write_metadata(store.spark_of(x), legacy.alt_stage(x, root, path, child=True, **options), root)}


@singledispatch
def stage_as(x, root: str, path: str, child: bool, **options) -> dict:
    raise TypeError(f"nothing stages a {type(x).__name__}")


@stage_as.register
def _(x: DataFrame, root: str, path: str, child: bool, **options) -> dict:
    return stage_as(store.Frame(x), root, path, child, **options)


def _is_other(f: T.StructField, form: str) -> bool:
    """Nested tables are children in any form; arrays only where the file cannot hold them."""
    return isinstance(f.dataType, T.StructType) or form != "parquet" and isinstance(f.dataType, (T.ArrayType, T.MapType))


@stage_as.register
def _(x: store.Frame, root: str, path: str, child: bool, df_version: int = 2, form: str | None = None, **options) -> dict:
    spark, df = x.df.sparkSession, x.df.drop(ROW_ID)
    form = form or frame_format()
    names = [c for c in df.columns if c not in (KEY, x.row_names)]
    check_names(names)
    if KEY not in df.columns and any(_is_other(df.schema[c], form) for c in names):
        df = cut(df.withColumn(KEY, F.monotonically_increasing_id()))  # one numbering for the table and its children
    keyed = KEY in df.columns
    stored = [F.col(KEY)] if keyed else []
    if x.row_names:
        stored.append(F.col(f"`{x.row_names}`").cast("string").alias("row_names"))
    columns = []
    for z, name in enumerate(names, 1):
        f, c, at = df.schema[name], F.col(f"`{name}`"), f"{path}/column{z}"
        entry: dict = {"name": name}
        if "levels" in f.metadata:
            levels = spark.createDataFrame([(v,) for v in f.metadata["levels"]], "levels string").coalesce(1)
            ordered = bool(f.metadata.get("ordered"))
            if df_version == 1:
                entry |= {"type": "ordered" if ordered else "factor", "levels": _child(store.Frame(levels), root, at)}
                c = F.get(F.lit(f.metadata["levels"]).cast("array<string>"), c)
            else:
                entry |= {"type": "factor", "ordered": ordered or None, "levels": _child(store.Vector(levels, "levels"), root, at)}
        elif text_format(f):
            kind = text_format(f)
            entry |= {"type": kind} if df_version == 1 else {"type": "string", "format": kind}
            if not isinstance(f.dataType, T.StringType):
                c = c.cast("string") if kind == DATE else datetimes.from_timestamp(c.cast("timestamp"))
        elif logical_type(f) in ATOMIC:
            entry["type"] = logical_type(f)
        elif isinstance(f.dataType, (T.ArrayType, T.MapType)) and form == "parquet":
            entry["type"] = "array"
        elif _is_other(f, form):
            nested = isinstance(f.dataType, T.StructType)
            inner = df.select(KEY, *([F.when(c.isNotNull(), F.lit(True)).alias("__there"), f"`{name}`.*"] if nested else [c.alias("value")]))
            # arrays have no CSV form
            entry |= {"type": "other", "nested": nested, **_child(store.Frame(inner), root, at, **options, **({} if nested else {"form": "parquet"}))}
            columns.append(entry)
            continue
        else:
            raise TypeError(f"column '{name}' of {f.dataType.simpleString()} cannot be staged")
        rest = {k: v for k, v in f.metadata.items() if k not in ("levels", "ordered")}
        columns.append(entry | {"metadata": rest or None})
        stored.append(c.alias(name))
    table = df.select(*stored)
    for entry in columns:
        if entry["type"] != "other":
            entry["storage"] = table.schema[entry["name"]].dataType.simpleString()
    Files(spark).make(f"{root}/{path}")
    target = f"{path}/simple.{form}"
    if form == "parquet":
        table.write.parquet(f"{root}/{target}")
    else:
        _write_csv(table, root, target, form == "csv.gz")
    notes = {
        "column_data": None if x.column_annotations is None else _child(store.Frame(x.column_annotations), root, f"{path}/mcols"),
        "other_data": _child(store.NestedList(lists.rows_of_value(spark, x.annotations)), root, f"{path}/other") if x.annotations else None,
    }
    body = {"columns": columns, "row_names": x.row_names is not None, "keyed": keyed, "dimensions": [df.count(), len(names)], "version": 2 if df_version != 1 else None, **notes}
    if form == "parquet":
        return {"$schema": PARQUET_FRAME, "path": target, "is_child": child, "data_frame": body}
    return {"$schema": CSV_FRAME, "path": target, "is_child": child, "data_frame": body, "csv_data_frame": {"compression": "gzip" if form == "csv.gz" else "none"}}


def _value_and_names(df: DataFrame, value, name: str | None) -> DataFrame:
    return df.select(*([F.col(f"`{name}`").cast("string").alias("names")] if name else []), value.alias("values"))


@stage_as.register
def _(x: store.Vector, root: str, path: str, child: bool, **options) -> dict:
    f, c = x.df.schema[x.value], F.col(f"`{x.value}`")
    kind = text_format(f)
    if kind and not isinstance(f.dataType, T.StringType):
        c = c.cast("string") if kind == DATE else datetimes.from_timestamp(c.cast("timestamp"))
    table = _value_and_names(x.df, c, x.name)
    Files(x.df.sparkSession).make(f"{root}/{path}")
    target = f"{path}/simple.txt.gz"
    _write_csv(table, root, target)
    body = {"type": "string" if kind else logical_type(f), "length": x.df.count(), "names": x.name is not None, "format": kind, "compression": "gzip", "storage": table.schema["values"].dataType.simpleString()}
    return {"$schema": VECTOR, "path": target, "is_child": child, "atomic_vector": body}


@stage_as.register
def _(x: store.Factor, root: str, path: str, child: bool, **options) -> dict:
    spark, meta = x.df.sparkSession, x.df.schema[x.value].metadata
    Files(spark).make(f"{root}/{path}")
    target = f"{path}/indices.txt.gz"
    _write_csv(_value_and_names(x.df, F.col(f"`{x.value}`"), x.name), root, target)
    levels = spark.createDataFrame([(v,) for v in meta["levels"]], "levels string").coalesce(1)
    return {
        "$schema": FACTOR,
        "path": target,
        "is_child": child,
        "factor": {"length": x.df.count(), "names": x.name is not None, "compression": "gzip"},
        "string_factor": {"levels": _child(store.Vector(levels, "levels"), root, f"{path}/levels"), "ordered": bool(meta.get("ordered"))},
    }


@stage_as.register
def _(x: store.RowFactor, root: str, path: str, child: bool, **options) -> dict:
    Files(x.codes.sparkSession).make(f"{root}/{path}")
    target = f"{path}/index.csv.gz"
    names = [F.col(f"`{x.name}`").cast("string").alias("row_names")] if x.name else []
    _write_csv(x.codes.select(*names, F.col("code").alias("index")), root, target)
    return {
        "$schema": ROW_FACTOR,
        "path": target,
        "is_child": child,
        "factor": {"length": x.codes.count(), "names": x.name is not None, "compression": "gzip"},
        "data_frame_factor": {"levels": _child(store.Frame(x.levels), root, f"{path}/levels", **options)},
    }


def as_version(node: dict, version: int) -> dict:
    """A list document in the words of its version: the first has types of its own for ordered factors and dates."""
    out = dict(node)
    if version == 1:
        if out["type"] == "factor" and out.pop("ordered", False):
            out["type"] = "ordered"
        elif out["type"] == "string" and out.get("format") in (DATE, DATE_TIME):
            out["type"] = out.pop("format")
    if out["type"] == "list":
        out["values"] = [as_version(v, version) for v in out["values"]]
    return out


@stage_as.register
def _(x: store.NestedList, root: str, path: str, child: bool, version: int | None = None, **options) -> dict:
    spark = x.rows.sparkSession
    Files(spark).make(f"{root}/{path}")
    version = version or 2
    children = [_child(c, root, f"{path}/child{k}", **options) for k, c in sorted(x.children.items())]
    if list_format() == "parquet":
        target = f"{path}/list.parquet"
        x.rows.write.parquet(f"{root}/{target}")
        return {"$schema": PARQUET_LIST, "path": target, "is_child": child, "simple_list": {"children": children}}

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for o, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                body = as_version(json.loads(text), version) | ({"version": f"1.{version}"} if version > 1 else {})
                out.append(json.dumps({"object": o, "document": body}, ensure_ascii=False))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])

    target = f"{path}/list.json.gz"
    text = lists.rows_to_list(x.rows).mapInArrow(lines, "value string").coalesce(1)
    _as_file(lambda folder: text.write.option("compression", "gzip").text(folder), spark, root, target)
    return {"$schema": JSON_LIST, "path": target, "is_child": child, "json_simple_list": {"compression": "gzip"}, "simple_list": {"children": children}}


# reading


def _document(spark: SparkSession, root: str, reference: dict) -> dict:
    return legacy.acquire_metadata(spark, root, reference["resource"]["path"])


def _levels(spark: SparkSession, root: str, reference: dict) -> list[str]:
    """Levels in their order, from a vector or from a table of one column; a dictionary is meant to fit the driver."""
    return [r[-1] for r in legacy.alt_load(spark, _document(spark, root, reference), root).collect()]


def load_frame(spark: SparkSession, meta: dict, root: str, include_nested: bool = True, keep_key: bool = False, **options) -> DataFrame:
    """The table; ``include_nested=False`` leaves nested tables out and does not read them."""
    info = meta["data_frame"]
    plain = [c for c in info["columns"] if c["type"] != "other"]
    head = ([T.StructField(KEY, T.LongType())] if info["keyed"] else []) + ([T.StructField("row_names", T.StringType())] if info["row_names"] else [])
    schema = T.StructType([*head, *(T.StructField(c["name"], T._parse_datatype_string(c["storage"]), True, c.get("metadata") or {}) for c in plain)])
    at = legacy.acquire_file(root, meta["path"])
    if meta["$schema"] == PARQUET_FRAME:
        df = spark.read.parquet(at)
        df = df.select(*[F.col(f"`{f.name}`").alias(f.name, metadata=f.metadata) for f in schema.fields])
    else:
        df = strict_csv.read_strict_csv(spark, at, schema)
    for c in plain:
        kind, name = c["type"], c["name"]
        if kind in ("factor", "ordered"):
            levels, ordered = _levels(spark, root, c["levels"]), kind == "ordered" or bool(c.get("ordered"))
            if info.get("version"):
                df = df.withColumn(name, F.col(f"`{name}`").cast("int")).withMetadata(name, {**df.schema[name].metadata, "levels": levels, "ordered": ordered})
            else:
                df = factors.factor_encode(df, name, levels, ordered)
        elif kind in (DATE, DATE_TIME) or c.get("format"):
            df = df.withMetadata(name, {**df.schema[name].metadata, "format": c.get("format") or kind})
    out = [c["name"] for c in info["columns"] if c["type"] != "other" or include_nested or not c["nested"]]
    for c in info["columns"]:
        if c["type"] != "other" or c["name"] not in out:
            continue
        inner = legacy.alt_load(spark, _document(spark, root, c), root, keep_key=True, **options)
        members = [x for x in inner.columns if x not in (KEY, "__there")]
        value = F.when(F.col("__there"), F.struct(*[F.col(f"`{m}`") for m in members])) if c["nested"] else F.col("value")
        df = df.join(inner.select(KEY, value.alias(c["name"])), KEY, "left")
    return df.select(*([KEY] if keep_key else []), *(["row_names"] if info["row_names"] else []), *[F.col(f"`{n}`") for n in out])


def load_vector(spark: SparkSession, meta: dict, root: str, **_) -> DataFrame:
    info = meta["atomic_vector"]
    names = "names string, " if info["names"] else ""
    df = strict_csv.read_strict_csv(spark, legacy.acquire_file(root, meta["path"]), f"{names}value {info['storage']}")
    return df.withMetadata("value", {"format": info["format"]}) if info.get("format") else df


def load_factor(spark: SparkSession, meta: dict, root: str, **_) -> DataFrame:
    names = "names string, " if meta["factor"]["names"] else ""
    df = strict_csv.read_strict_csv(spark, legacy.acquire_file(root, meta["path"]), f"{names}value int")
    info = meta["string_factor"]
    return df.withMetadata("value", {"levels": _levels(spark, root, info["levels"]), "ordered": info["ordered"]})


def load_row_factor(spark: SparkSession, meta: dict, root: str, **options) -> DataFrame:
    names = "row_names string, " if meta["factor"]["names"] else ""
    codes = strict_csv.read_strict_csv(spark, legacy.acquire_file(root, meta["path"]), f"{names}code int")
    return factors.row_factor_decode(codes, legacy.alt_load(spark, _document(spark, root, meta["data_frame_factor"]["levels"]), root, **options))


def load_list(spark: SparkSession, meta: dict, root: str, **_) -> DataFrame:
    """Rows of the list; its external children are read by ``load_children``."""
    at = legacy.acquire_file(root, meta["path"])
    if meta["$schema"] == PARQUET_LIST:
        return spark.read.parquet(at)
    line = spark.read.text(at).select(F.get_json_object("value", "$.object").alias("object"), F.get_json_object("value", "$.document").alias("json"))
    return lists.list_to_rows(line)


def load_children(spark: SparkSession, meta: dict, root: str, **options) -> list[DataFrame]:
    return [legacy.alt_load(spark, _document(spark, root, c), root, **options) for c in meta["simple_list"]["children"]]


def load_annotations(spark: SparkSession, meta: dict, root: str) -> tuple[DataFrame | None, DataFrame | None]:
    """(annotations of the columns, rows of the list of annotations) where they were staged."""
    info = meta["data_frame"]
    return tuple(legacy.alt_load(spark, _document(spark, root, info[k]), root) if info.get(k) else None for k in ("column_data", "other_data"))


for _schemas, _loader in (((CSV_FRAME, PARQUET_FRAME), load_frame), ((VECTOR,), load_vector), ((FACTOR,), load_factor), ((ROW_FACTOR,), load_row_factor), ((JSON_LIST, PARQUET_LIST), load_list)):
    for _schema in _schemas:
        legacy.loaders.register(_schema, _loader)


def folder_md5(spark: SparkSession, path: str) -> str:
    """MD5 of the MD5 sums of a folder's files, in the order of their names."""
    sums = spark.read.format("binaryFile").load(path).select("path", F.md5("content").alias("md5")).orderBy("path").collect()
    return spark.range(1).select(F.md5(F.lit(reduce(lambda a, r: a + r["md5"], sums, "")))).first()[0]
