"""Nested lists as typed JSON documents and as rows.

A document is a tree of nodes: ``nothing``, ``list`` (values, names), vectors of
``integer``, ``number``, ``boolean`` or ``string`` (with a format for dates),
``factor`` (levels, zero-based values) and ``external`` (index of a child).
Flattened, every leaf is a row with its path of names and its path of
positions; lists without leaves are rows too, so the tree can be built again.
A single value that is not in an array is not boxed.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = (
    "object string, path array<string>, idx array<int>, kind string, type string, format string, boxed boolean, "
    "values array<string>, names array<string>, levels array<string>, ordered boolean, index int"
)
_FIELDS = [
    ("object", pa.string()),
    ("path", pa.list_(pa.string())),
    ("idx", pa.list_(pa.int32())),
    ("kind", pa.string()),
    ("type", pa.string()),
    ("format", pa.string()),
    ("boxed", pa.bool_()),
    ("values", pa.list_(pa.string())),
    ("names", pa.list_(pa.string())),
    ("levels", pa.list_(pa.string())),
    ("ordered", pa.bool_()),
    ("index", pa.int32()),
]
# How numbers that JSON lacks are written.
SPECIALS = {"NaN": math.nan, "Inf": math.inf, "-Inf": -math.inf}
VECTORS = ("integer", "number", "boolean", "string")


class ListError(ValueError):
    """A document that is no typed list; the message names the element."""


def _text(kind: str, v) -> str | None:
    if v is None:
        return None
    if kind == "boolean":
        if not isinstance(v, bool):
            raise ListError(f"{v!r} is no boolean")
        return "true" if v else "false"
    if kind == "number":
        if isinstance(v, str) and v not in SPECIALS or isinstance(v, bool):
            raise ListError(f"{v!r} is no number")
        return v if isinstance(v, str) else repr(float(v))
    if kind == "integer":
        if isinstance(v, bool) or not isinstance(v, int):
            raise ListError(f"{v!r} is no integer")
        return str(v)
    if not isinstance(v, str):
        raise ListError(f"{v!r} is no string")
    return v


def flatten(node: dict, name: str = "", path: tuple = (), idx: tuple = ()) -> Iterator[tuple]:
    """Rows of one tree, without repeating inner nodes."""
    try:
        kind = node["type"]
        if kind in ("date", "date-time"):  # the oldest writers name the format as type
            node, kind = {**node, "type": "string", "format": kind}, "string"
        if kind == "ordered":
            node, kind = {**node, "ordered": True}, "factor"
        row = {"object": name, "path": list(path), "idx": list(idx), "kind": kind, "names": node.get("names")}
        if kind == "nothing":
            yield row
        elif kind == "external":
            yield row | {"index": int(node["index"])}
        elif kind == "list":
            values, names = node["values"], node.get("names")
            if names is not None and len(names) != len(values):
                raise ListError(f"{len(names)} names for {len(values)} values")
            yield row | {"index": len(values)}
        elif kind in VECTORS or kind == "factor":
            values = node["values"]
            boxed = isinstance(values, list)
            values = values if boxed else [values]
            if kind == "factor":
                if any(v is not None and not 0 <= v < len(node["levels"]) for v in values):
                    raise ListError("code without level")
                out = [None if v is None else str(v) for v in values]
                yield row | {"type": "factor", "boxed": boxed, "values": out, "levels": node["levels"], "ordered": bool(node.get("ordered", False))}
            else:
                yield row | {"kind": "vector", "type": kind, "format": node.get("format"), "boxed": boxed, "values": [_text(kind, v) for v in values]}
            return
        else:
            raise ListError(f"unknown type '{kind}'")
    except (KeyError, TypeError) as e:
        raise ListError(f"element {'/'.join(map(str, idx)) or '.'}: {e}") from e
    except ListError as e:
        raise ListError(f"element {'/'.join(map(str, idx)) or '.'}: {e}") from e
    if kind == "list":
        for i, v in enumerate(node["values"]):
            label = node["names"][i] if node.get("names") else str(i)
            yield from flatten(v, name, (*path, label), (*idx, i))


def _value(kind: str, v: str | None):
    if v is None or kind == "string":
        return v
    if kind == "boolean":
        return v == "true"
    if kind == "integer":
        return int(v)
    return v if v in SPECIALS else float(v)


def unflatten(rows: list[dict]) -> dict:
    """The tree of one object's rows."""
    nodes: dict[tuple, dict] = {}
    for r in sorted(rows, key=lambda r: (len(r["idx"]), r["idx"])):
        kind = r["kind"]
        if kind == "list":
            node: dict = {"type": "list", "values": [None] * r["index"]}
        elif kind == "external":
            node = {"type": "external", "index": r["index"]}
        elif kind == "nothing":
            node = {"type": "nothing"}
        else:
            values = [int(v) if v is not None else None for v in r["values"]] if kind == "factor" else [_value(r["type"], v) for v in r["values"]]
            node = {"type": r["type"], "values": values if r["boxed"] else values[0]}
            if kind == "factor":
                node |= {"levels": list(r["levels"]), "ordered": r["ordered"]}
            if r["format"]:
                node["format"] = r["format"]
        if r["names"] is not None:
            node["names"] = list(r["names"])
        at = tuple(r["idx"])
        nodes[at] = node
        if at:
            nodes[at[:-1]]["values"][at[-1]] = node
    return nodes[()]


def list_to_rows(documents: DataFrame, object_column: str = "object", json_column: str = "json") -> DataFrame:
    """Rows of every document (object, json)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for o, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if t is not None for r in flatten(json.loads(t), o)]
            yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in _FIELDS], names=[n for n, _ in _FIELDS])

    return documents.select(F.col(object_column).cast("string"), F.col(json_column).cast("string")).mapInArrow(run, SCHEMA)


def rows_to_list(rows: DataFrame) -> DataFrame:
    """(object, json) of every object; one object is one document and fits a task."""
    columns = [n for n, _ in _FIELDS if n != "object"]
    gathered = rows.groupBy("object").agg(F.collect_list(F.struct(*[F.col(f"`{c}`") for c in columns])).alias("rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [json.dumps(unflatten(r), ensure_ascii=False) for r in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["object", "json"])

    return gathered.mapInArrow(run, "object string, json string")


def typed(value) -> dict:
    """Typed document of plain Python values: dicts and lists of mixed things are lists, lists of one kind vectors."""
    if value is None:
        return {"type": "nothing"}
    if isinstance(value, dict):
        return {"type": "list", "values": [typed(v) for v in value.values()], "names": list(value)}
    kinds = {bool: "boolean", int: "integer", float: "number", str: "string"}
    boxed = isinstance(value, (list, tuple))
    items = list(value) if boxed else [value]
    found = {type(v) for v in items if v is not None}
    if len(found) == 1 and (kind := kinds.get(next(iter(found)))):
        special = lambda v: v if kind != "number" or v is None or math.isfinite(v) else next(k for k, x in SPECIALS.items() if x == v or (v != v and x != x))
        out = [special(v) for v in items]
        return {"type": kind, "values": out if boxed else out[0]}
    return {"type": "list", "values": [typed(v) for v in items]}


def rows_of_value(spark: SparkSession, value, name: str = "") -> DataFrame:
    rows = list(flatten(typed(value), name))
    return spark.createDataFrame([tuple(r.get(n) for n, _ in _FIELDS) for r in rows], SCHEMA)


def name_violations(rows: DataFrame) -> DataFrame:
    """(object, path, name, n): empty or repeated names within one list or vector."""
    named = rows.where("names is not null").select("object", "path", F.explode("names").alias("name"))
    return named.groupBy("object", "path", "name").agg(F.count("*").alias("n")).where("n > 1 or name is null or name = ''")


def number_values(rows: DataFrame) -> DataFrame:
    """(object, idx, pos, value double) of number vectors; the written specials become IEEE values."""
    v = F.col("v")
    value = F.when(v == "Inf", F.lit(math.inf)).when(v == "-Inf", F.lit(-math.inf)).when(v == "NaN", F.lit(math.nan)).otherwise(v.cast("double"))
    return rows.where("type = 'number'").select("object", "idx", F.posexplode("values").alias("pos", "v")).select("object", "idx", "pos", value.alias("value"))


def external_order(names):
    """Numeric order of child directories."""
    return names.cast("int")
