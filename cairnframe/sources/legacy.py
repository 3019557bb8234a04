"""The older layout: data files with JSON documents beside them, and redirections.

``staging`` has the layout of each kind of object; ``write_metadata`` completes a
document with the file's MD5 sum.  Catalog questions are answered by the set
queries of ``operators.setrules`` over ``catalog_frames``.
"""

from __future__ import annotations

import json
import posixpath
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnframe.operators import setrules
from cairnframe.plans import registry
from cairnframe.sources.files import Files

# Ids of the documents' schemas.
REDIRECTION_SCHEMA = "redirection/v1.json"

loaders = registry.Registry("loader")


def strip_nulls(value):
    """Document without null members, at every depth."""
    if isinstance(value, dict):
        return {k: strip_nulls(v) for k, v in value.items() if v is not None}
    return [strip_nulls(v) for v in value] if isinstance(value, list) else value


def stage_object(x, root: str, path: str, child: bool = False, **options) -> dict:
    """Writes a table or another object of ``store`` below ``root/path`` and returns its document (not yet written)."""
    from cairnframe.sources import staging, store

    files = Files(store.spark_of(x))
    if "\\" in path:
        raise ValueError(f"'{path}' has a backslash")
    if files.exists(f"{root}/{path}"):
        raise FileExistsError(f"cannot stage at existing path '{path}'")
    if not child:
        up = posixpath.dirname(path)
        while up:
            if any(n.endswith(".json") for n in files.names(f"{root}/{up}")):
                raise ValueError(f"'{path}' lies inside the object at '{up}' and is no child")
            up = posixpath.dirname(up)
    return staging.stage_as(x, root, path, child, **options)


def md5sum(spark: SparkSession, path: str) -> str:
    """MD5 sum of a file, or one over the sums of a folder's files."""
    if Files(spark).is_dir(path):
        from cairnframe.sources import staging

        return staging.folder_md5(spark, path)
    return spark.read.format("binaryFile").load(path).select(F.md5("content")).first()[0]


def write_metadata(spark: SparkSession, meta: dict, root: str, ignore_null: bool = True) -> dict:
    """Writes ``<path>.json`` and returns a reference to the object."""
    files = Files(spark)
    meta = {**meta, "path": meta["path"].removeprefix("./")}
    if not meta["$schema"].startswith("redirection/"):
        meta.setdefault("md5sum", md5sum(spark, f"{root}/{meta['path']}"))
    files.write(f"{root}/{meta['path']}.json", json.dumps(strip_nulls(meta) if ignore_null else meta, indent=2))
    return {"type": "local", "path": meta["path"]}


def acquire_file(root: str, path: str) -> str:
    return f"{root}/{path}"


def acquire_metadata(spark: SparkSession, root: str, path: str) -> dict:
    """The document of a path; redirections are followed."""
    files = Files(spark)
    name = path if path.endswith(".json") else f"{path}.json"
    meta = json.loads(files.read(f"{root}/{name}"))
    if meta["$schema"].startswith("redirection/"):
        target = next(t for t in meta["redirection"]["targets"] if t["type"] == "local")
        return acquire_metadata(spark, root, target["location"])
    return meta


def load_object(spark: SparkSession, meta: dict, root: str, **options) -> DataFrame:
    from cairnframe.sources import staging  # noqa: F401  registers the loaders

    return loaders.get(meta["$schema"])(spark, meta, root, **options)


alt_stage = registry.Override(stage_object)
alt_load = registry.Override(load_object)


def create_redirection(spark: SparkSession, root: str, source: str, target: str) -> dict:
    """Document that sends ``source`` to ``target``; an existing one is refused."""
    if Files(spark).exists(f"{root}/{source}") or Files(spark).exists(f"{root}/{source}.json"):
        raise FileExistsError(source)
    return {"$schema": REDIRECTION_SCHEMA, "path": source, "redirection": {"targets": [{"type": "local", "location": target}]}}


def strip_null_documents(text: Column) -> Column:
    """``strip_nulls`` for a column of JSON documents, compact; NULL stays."""

    @F.pandas_udf("string")
    def strip(documents: pd.Series) -> pd.Series:
        return documents.map(lambda d: None if d is None else json.dumps(strip_nulls(json.loads(d)), separators=(",", ":"), ensure_ascii=False))

    return strip(text)


def quick_stage(x, root: str, path: str) -> None:
    """Stage, write the document, and redirect the bare path to it."""
    from cairnframe.sources.store import spark_of

    spark = spark_of(x)
    Files(spark).make(root)
    done = write_metadata(spark, alt_stage(x, root, path), root)
    # the folder itself exists, so the alias is written directly
    write_metadata(spark, {"$schema": REDIRECTION_SCHEMA, "path": path, "redirection": {"targets": [{"type": "local", "location": done["path"]}]}}, root)


def quick_load(spark: SparkSession, root: str, path: str, **options) -> DataFrame:
    return alt_load(spark, acquire_metadata(spark, root, path), root, **options)


def documents(spark: SparkSession, root: str) -> DataFrame:
    """(file, path, redirection, is_child, children, targets, document) of every document below ``root``, read by the executors."""
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toString().rstrip("/")
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").option("recursiveFileLookup", "true").load(root)
    found = found.select(F.substring("path", len(base) + 2, 1 << 30).alias("file"), F.col("content").cast("string").alias("value"))
    schema = "file string, path string, redirection boolean, is_child boolean, children array<string>, targets array<string>, document string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, text in zip(*(c.to_pylist() for c in batch.columns)):
                doc = json.loads(text)
                away = doc["$schema"].startswith("redirection/")
                targets = [t["location"] for t in doc["redirection"].get("targets") or [] if t["type"] == "local"] if away else []
                children = [] if away else resources({k: v for k, v in doc.items() if k != "path"})
                rows.append((name, doc["path"], away, bool(doc.get("is_child")), children, targets, text))
            kinds = (pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.list_(pa.string()), pa.list_(pa.string()), pa.string())
            columns = zip(*rows) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["file", "path", "redirection", "is_child", "children", "targets", "document"])

    return found.mapInArrow(run, schema)


# Members that a document of each kind must have; "a.b" is b in a.
REQUIRED = {
    "csv_data_frame": ["data_frame.columns", "data_frame.row_names", "data_frame.dimensions", "csv_data_frame.compression"],
    "parquet_data_frame": ["data_frame.columns", "data_frame.row_names", "data_frame.dimensions"],
    "atomic_vector": ["atomic_vector.type", "atomic_vector.length", "atomic_vector.names"],
    "string_factor": ["factor.length", "factor.names", "string_factor.levels.resource.path", "string_factor.ordered"],
    "data_frame_factor": ["factor.length", "factor.names", "data_frame_factor.levels.resource.path"],
    "json_simple_list": ["simple_list.children", "json_simple_list.compression"],
    "parquet_simple_list": ["simple_list.children"],
    "redirection": ["redirection.targets"],
}


def missing_members(doc) -> list[str]:
    """What a document lacks by the rules of its kind; documents of unknown kinds need a path only."""
    if not isinstance(doc, dict) or not isinstance(doc.get("$schema"), str):
        return ["$schema"]
    wanted = ["path"] + REQUIRED.get(doc["$schema"].split("/")[0], [])
    if not doc["$schema"].startswith("redirection/"):
        wanted += ["md5sum"]
    lost = []
    for name in wanted:
        at = doc
        for part in name.split("."):
            at = at.get(part) if isinstance(at, dict) else None
        if at is None:
            lost.append(name)
    return lost


def document_violations(spark: SparkSession, root: str) -> DataFrame:
    """(path, member): members that documents lack, judged by the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(p, m) for p, text in zip(*(c.to_pylist() for c in batch.columns)) for m in missing_members(json.loads(text))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(2)], names=["path", "member"])

    return documents(spark, root).select("path", "document").mapInArrow(run, "path string, member string")


def list_directory(spark: SparkSession, root: str, ignore_children: bool = True) -> dict[str, dict]:
    """All documents by path, on the driver; ``documents`` has them as a table."""
    found = documents(spark, root)
    if ignore_children:
        found = found.where("not is_child")
    return {r["path"]: json.loads(r["document"]) for r in found.select("path", "document").collect()}


def resources(value) -> list[str]:
    """Paths of all ``resource`` members of a document, outermost first."""
    if isinstance(value, list):
        return [p for v in value for p in resources(v)]
    if not isinstance(value, dict):
        return []
    if "resource" in value:
        return [value["resource"]["path"]]
    return [p for v in value.values() for p in resources(v)]


def catalog_frames(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(meta, files, redirects) of a directory, the input of the set rules."""
    docs = documents(spark, root)
    # a folder of parts is one file here
    other = {n.split(".parquet/")[0] + ".parquet" if ".parquet/" in n else n for n in Files(spark).walk(root) if ".parquet/" in n or not n.endswith(".json")}
    return (
        docs.where("not redirection").select("path", "file", "is_child", "children"),
        spark.createDataFrame([(n,) for n in sorted(other)], "path string"),
        docs.where("redirection").select("path", F.explode("targets").alias("target")),
    )


def check_directory(spark: SparkSession, root: str, attempt_load: bool = False) -> None:
    """Raises with the violations of a directory."""
    members = document_violations(spark, root).select(F.concat(F.lit("no member "), "member").alias("rule"), "path")
    found = setrules.all_violations(*catalog_frames(spark, root)).unionByName(members).collect()
    if attempt_load:
        for path, meta in list_directory(spark, root).items():
            if not meta["$schema"].startswith("redirection/"):
                try:
                    alt_load(spark, meta, root).take(1)
                except Exception as e:
                    raise ValueError(f"failed to load '{path}': {e}") from e
    if found:
        raise ValueError("; ".join(f"{r['rule']} '{r['path']}'" for r in found))


def load_directory(spark: SparkSession, root: str, redirect_action: str = "from") -> dict[str, DataFrame]:
    """Every non-child by path, seen through redirections."""
    documents = list_directory(spark, root)
    base = spark.createDataFrame([(p, p) for p, m in documents.items() if not m["$schema"].startswith("redirection/")], "path string, object string")
    _, _, redirects = catalog_frames(spark, root)
    seen = setrules.redirect(base, redirects, redirect_action).collect()
    return {r["path"]: alt_load(spark, documents[r["object"]], root) for r in seen}


def remove_object(spark: SparkSession, root: str, path: str) -> None:
    """Removes a non-child, its directory and the redirections to it."""
    meta = acquire_metadata(spark, root, path)
    if meta.get("is_child"):
        raise ValueError(f"'{path}' is a child")
    files = Files(spark)
    for alias, doc in list_directory(spark, root).items():
        if doc["$schema"].startswith("redirection/") and any(t["location"] == meta["path"] for t in doc["redirection"]["targets"]):
            files.delete(f"{root}/{alias}.json")
    files.delete(f"{root}/{posixpath.dirname(meta['path'])}")


def move_object(spark: SparkSession, root: str, path: str, to: str) -> None:
    """Moves a non-child to another directory; documents and redirections follow."""
    meta = acquire_metadata(spark, root, path)
    if meta.get("is_child"):
        raise ValueError(f"'{path}' is a child")
    files = Files(spark)
    if files.exists(f"{root}/{to}"):
        raise FileExistsError(to)
    old = posixpath.dirname(meta["path"])
    moved = lambda p: to + p[len(old) :] if p == old or p.startswith(old + "/") else p
    documents = {n: json.loads(files.read(f"{root}/{n}")) for n in files.walk(root) if n.endswith(".json")}
    files.rename(f"{root}/{old}", f"{root}/{to}")

    def rewrite(value):
        if isinstance(value, dict):
            return {k: moved(v) if k in ("path", "location") and isinstance(v, str) else rewrite(v) for k, v in value.items()}
        return [rewrite(v) for v in value] if isinstance(value, list) else value

    for name, doc in documents.items():
        new = rewrite(doc)
        if new != doc:
            here = moved(name)
            if doc["$schema"].startswith("redirection/"):
                here = f"{new['path']}.json"
                if here != name:
                    files.delete(f"{root}/{name}")
            files.write(f"{root}/{here}", json.dumps(new, indent=2), replace=True)
