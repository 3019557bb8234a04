"""Integrity rules over catalogs, as set queries that return the offending paths.

``meta`` has one row per metadata document: path, file, is_child, children
(array of paths).  ``files`` has one row per file that is no document: path.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnframe.operators.rows import dense_index


def references(meta: DataFrame) -> DataFrame:
    """(child, parent): every reference, one row each."""
    return meta.select(F.explode("children").alias("child"), F.col("path").alias("parent"))


def missing_paths(meta: DataFrame, files: DataFrame) -> DataFrame:
    return meta.select("path").join(files.select("path"), "path", "left_anti")


def unexpected_paths(meta: DataFrame) -> DataFrame:
    """Documents whose name does not follow from their path."""
    return meta.where((F.col("path") != F.col("file")) & (F.concat("path", F.lit(".json")) != F.col("file"))).select("path")


def parent(c):
    """Directory of a path; ``.`` at the top."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.instr(c, "/") > 0, F.regexp_replace(c, "/[^/]*$", "")).otherwise(F.lit("."))


def stray_children(meta: DataFrame) -> DataFrame:
    """Children outside the directory of the document that refers to them."""
    pairs = meta.select("file", F.explode("children").alias("path"))
    return pairs.where(~F.startswith(parent("path"), F.concat(parent("file"), F.lit("/")))).select("path")


def conflicts(meta: DataFrame) -> DataFrame:
    """Referenced as a child but not marked as one."""
    return references(meta).select(F.col("child").alias("path")).intersect(meta.where(~F.col("is_child")).select("path"))


def duplicate_references(meta: DataFrame) -> DataFrame:
    return references(meta).groupBy(F.col("child").alias("path")).agg(F.count("*").alias("n")).where("n > 1")



def missing_children(meta: DataFrame) -> DataFrame:
    """Referenced children that no document marked as child describes."""
    return references(meta).select(F.col("child").alias("path")).subtract(meta.where("is_child").select("path"))


def unreferenced_children(meta: DataFrame) -> DataFrame:
    return meta.where("is_child").select("path").subtract(references(meta).select(F.col("child").alias("path")))


def unknown_files(meta: DataFrame, files: DataFrame) -> DataFrame:
    return files.select("path").subtract(meta.select("path"))


def nested_by_neighbour(meta: DataFrame) -> DataFrame:
    """Non-children whose directory lies in that of their predecessor in sorted order."""
    dirs = meta.where(~F.col("is_child")).select(parent("path").alias("dir"))
    placed = dense_index(dirs, "n", "dir")
    before = placed.select(F.col("dir").alias("inside"), (F.col("n") + 1).alias("n"))
    return placed.join(before, "n").where(F.startswith("dir", F.concat("inside", F.lit("/")))).select(F.col("dir").alias("path"), "inside")


def ancestors(c):
    """Strict ancestor directories of a relative path, nearest last."""
    c = F.col(c) if isinstance(c, str) else c
    parts = F.split(c, "/")
    return F.transform(F.slice(F.sequence(F.lit(0), F.size(parts) - 1), 2, F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def nested_anywhere(meta: DataFrame) -> DataFrame:
    """Complete form: every non-child below the directory of another, by an equi-join on ancestors."""
    dirs = meta.where(~F.col("is_child")).select(parent("path").alias("path")).distinct()
    above = dirs.select("path", F.explode(ancestors("path")).alias("inside"))
    return above.join(dirs.select(F.col("path").alias("inside")), "inside", "left_semi").select("path", "inside")


def dangling_redirects(redirects: DataFrame, meta: DataFrame) -> DataFrame:
    return redirects.select(F.col("target").alias("path")).join(meta.select("path"), "path", "left_anti").distinct()


def shadowing_redirects(redirects: DataFrame, files: DataFrame) -> DataFrame:
    """Redirections from a path that exists."""
    return redirects.select("path").join(files.select("path"), "path", "left_semi")


def all_violations(meta: DataFrame, files: DataFrame, redirects: DataFrame) -> DataFrame:
    """(rule, path) of every rule."""
    found = {
        "missing_path": missing_paths(meta, files),
        "unexpected_path": unexpected_paths(meta),
        "stray_child": stray_children(meta),
        "conflict": conflicts(meta),
        "duplicate_reference": duplicate_references(meta).select("path"),
        "missing_child": missing_children(meta),
        "unreferenced_child": unreferenced_children(meta),
        "unknown_file": unknown_files(meta, files),
        "nested": nested_anywhere(meta).select("path"),
        "dangling_redirect": dangling_redirects(redirects, meta),
        "shadowing_redirect": shadowing_redirects(redirects, files),
    }
    return reduce(DataFrame.unionByName, [df.select(F.lit(rule).alias("rule"), "path") for rule, df in found.items()])


def redirect(base: DataFrame, redirects: DataFrame, action: str = "from") -> DataFrame:
    """Catalog seen through redirections: ``to`` the targets, ``from`` the aliases instead of them, ``both``."""
    alias = redirects.join(base.withColumnRenamed("path", "target"), "target").drop("target").select(*base.columns)
    if action == "to":
        return base
    if action == "from":
        return base.join(redirects.select(F.col("target").alias("path")).distinct(), "path", "left_anti").select(*base.columns).unionByName(alias)
    if action == "both":
        return base.unionByName(alias)
    raise ValueError(f"unknown redirect action '{action}'")
