"""The query slate of the artifact engine, each with its SQL equivalent where SQL has one.

Queries run over their whole tables.  Saved artifacts go to fresh paths in the
session's shared folder.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnframe.functions import datetimes, missing, types
from cairnframe.operators import catalog, factors, lists, setrules, vls
from cairnframe.operators.rows import scratch
from cairnframe.plans import registry
from cairnframe.sources import provenance, store, strict_csv
from cairnframe.sources.files import Files, absolutize_column
from cairnframe.sources.legacy import strip_null_documents, strip_nulls

PRIORITIES = ["5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT"]
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from cairnframe.plans import slate_more  # noqa: F401  adds its own

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def saved(x, name: str, **options) -> str:
    path = scratch(store.spark_of(x), name)
    store.save_object(x, path, **options)
    return path


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with their priority as an ordered factor: saved, listed, read back, decoded."""
    orders = factors.factor_encode(table(spark, sf, "orders"), "o_orderpriority", PRIORITIES, ordered=True)
    path = saved(orders, "orders")
    (found,) = catalog.list_objects(spark, path).collect()
    back = store.read_object(spark, path if found["path"] == "." else f"{path}/{found['path']}")
    return factors.factor_decode(back, "o_orderpriority")


# storage round trips


@query("SELECT * FROM orders")
def data_frame_roundtrip(spark, sf):
    return flagship(spark, sf)


@query("SELECT l_orderkey, l_quantity, l_returnflag FROM lineitem")
def data_frame_column_subset(spark, sf):
    path = saved(table(spark, sf, "lineitem"), "lineitem", validate=False)
    return store.read_object(spark, path).select("l_orderkey", "l_quantity", "l_returnflag")


@query("SELECT c_custkey AS id, c_name AS name, c_acctbal AS acctbal FROM customer")
def nested_child_read(spark, sf):
    nested = table(spark, sf, "customer").select("c_nationkey", F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("acctbal")).alias("cust"))
    return store.read_object(spark, saved(nested, "nested")).select("cust.*")


@query("SELECT c_nationkey FROM customer")
def nested_left_out(spark, sf):
    nested = table(spark, sf, "customer").select("c_nationkey", F.struct("c_custkey", "c_name").alias("cust"))
    return store.read_object(spark, saved(nested, "nested"), include_nested=False)


@query("SELECT s_name AS row_name, s_acctbal FROM supplier WHERE s_suppkey % 7 = 3")
def row_name_lookup(spark, sf):
    s = table(spark, sf, "supplier")
    frame = store.read_object(spark, saved(store.Frame(s.select("s_name", "s_acctbal"), row_names="s_name"), "named"))
    wanted = s.where("s_suppkey % 7 = 3").select(F.col("s_name").alias(types.ROW_NAME))
    return frame.join(wanted, types.ROW_NAME, "left_semi").select(F.col(types.ROW_NAME).alias("row_name"), "s_acctbal")


@query("SELECT r_name AS name, r_regionkey AS value FROM region")
def atomic_vector_named(spark, sf):
    return store.read_object(spark, saved(store.Vector(table(spark, sf, "region"), "r_regionkey", "r_name"), "vector")).select("name", "value")


@query("SELECT vec_id, embedding FROM embeddings")
def matrix_column_roundtrip(spark, sf):
    e = types.annotate(table(spark, sf, "embeddings").select("vec_id", "embedding"), "embedding", dim=[-1])
    return store.read_object(spark, saved(e, "matrix"))


@query("SELECT count(*) AS n FROM nation")
def zero_column_frame(spark, sf):
    return store.read_object(spark, saved(table(spark, sf, "nation").select(), "empty")).agg(F.count("*").alias("n"))


@query("SELECT 'c_acctbal' AS name, 'number' AS kind UNION ALL SELECT 'c_custkey', 'integer' UNION ALL SELECT 'c_mktsegment', 'string' UNION ALL SELECT 'c_name', 'string' UNION ALL SELECT 'c_nationkey', 'integer'")
def column_annotations(spark, sf):
    c = table(spark, sf, "customer").select("c_acctbal", "c_custkey", "c_mktsegment", "c_name", "c_nationkey")
    notes = spark.createDataFrame([(f.name, types.logical_type(f)) for f in c.schema.fields], "name string, kind string")
    path = saved(store.Frame(c, column_annotations=notes, annotations={"source": "customer"}), "annotated")
    return store.read_annotations(spark, path)[0].select("name", "kind")


@query("SELECT doc_id, text, lang FROM documents")
def text_payload_roundtrip(spark, sf):
    return store.read_object(spark, saved(table(spark, sf, "documents").select("doc_id", "text", "lang"), "documents", validate=False))


@query("SELECT item_id AS value FROM benchmark")
def bare_vector(spark, sf):
    return store.read_object(spark, saved(store.Vector(table(spark, sf, "benchmark"), "item_id"), "bare"))


# missing values

_GAPS = "CASE WHEN l_linenumber % 3 = 0 THEN NULL WHEN l_linenumber % 3 = 1 THEN {nan} ELSE l_quantity END"


def _gaps(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.expr(_GAPS.format(nan="double('NaN')")).alias("x"))


_GAPS_SQL = _GAPS.format(nan="'NaN'::DOUBLE")


@query(f"SELECT l_orderkey, l_linenumber, x IS NULL AS missing, coalesce(isnan(x), false) AS nan FROM (SELECT l_orderkey, l_linenumber, {_GAPS_SQL} AS x FROM lineitem)")
def is_missing(spark, sf):
    x = F.col("x")
    return _gaps(spark, sf).select("l_orderkey", "l_linenumber", missing.is_missing(x).alias("missing"), F.coalesce(F.isnan(x), F.lit(False)).alias("nan"))


@query(f"SELECT l_linenumber, bool_or(x IS NULL) AS any_missing FROM (SELECT l_linenumber, {_GAPS_SQL} AS x FROM lineitem) GROUP BY l_linenumber")
def any_missing(spark, sf):
    return _gaps(spark, sf).groupBy("l_linenumber").agg(missing.any_missing(F.col("x")).alias("any_missing"))


_FLAG = "CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE l_returnflag = 'R' END"


@query(f"SELECT l_orderkey, l_linenumber, coalesce(({_FLAG})::INT, -1) AS code FROM lineitem")
def placeholder_boolean(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.expr(_FLAG).alias("code"))
    return missing.encode_missing(df, "code")


_NAMES = "CASE WHEN p_size % 5 = 0 THEN NULL WHEN p_size % 5 = 1 THEN 'NA' WHEN p_size % 5 = 2 AND p_size > 10 THEN '_NA' ELSE p_brand END"


@query(
    f"""WITH t AS (SELECT {_NAMES} AS s FROM part), used AS (SELECT DISTINCT length(s) - 2 AS n FROM t WHERE regexp_full_match(s, '_*NA'))
    SELECT CASE WHEN (SELECT bool_or(s IS NULL) FROM t) THEN repeat('_', (SELECT min(i) FROM range(0, (SELECT count(*) + 1 FROM used)) r(i) WHERE i NOT IN (SELECT n FROM used))::INT) || 'NA' END AS placeholder"""
)
def placeholder_string(spark, sf):
    return table(spark, sf, "part").select(F.expr(_NAMES).alias("s")).agg(missing.string_placeholder(F.col("s")).alias("placeholder"))


@query(
    f"""SELECT l_linenumber, bool_or(x IS NULL) AS needed, bool_or(x IS NULL) AND NOT coalesce(bool_or(isnan(x)), false) AS is_nan,
    CASE WHEN bool_or(x IS NULL) THEN CASE WHEN coalesce(bool_or(isnan(x)), false) THEN 'infinity'::DOUBLE ELSE 'NaN'::DOUBLE END END AS value
    FROM (SELECT l_linenumber % 2 AS l_linenumber, {_GAPS_SQL} AS x FROM lineitem) GROUP BY l_linenumber"""
)
def placeholder_number(spark, sf):
    df = _gaps(spark, sf).withColumn("l_linenumber", F.col("l_linenumber") % 2)
    return df.groupBy("l_linenumber").agg(missing.number_placeholder(F.col("x")).alias("p")).select("l_linenumber", "p.*")


@query(f"SELECT l_orderkey, l_linenumber, {_GAPS_SQL} AS x FROM lineitem")
def placeholder_roundtrip(spark, sf):
    return missing.decode_missing(missing.encode_missing(_gaps(spark, sf), "x"), "x", "double")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN (-2147483648)::INT WHEN o_orderkey % 3 = 1 THEN NULL ELSE (o_orderkey % 1000)::INT END AS v FROM orders")
def integer_min_limit(spark, sf):
    v = F.when(F.col("o_orderkey") % 3 == 0, F.lit(-(2**31))).when(F.col("o_orderkey") % 3 == 1, F.lit(-7)).otherwise((F.col("o_orderkey") % 1000).cast("int"))
    encoded = types.annotate(table(spark, sf, "orders").select("o_orderkey", v.alias("v")), "v", **{types.PLACEHOLDER_KEY: "-7"})
    return missing.decode_missing(encoded, "v", "int")


@query("SELECT o_orderkey, try_cast(o_orderpriority AS INT) AS as_int, try_cast(substr(o_orderpriority, 1, 1) AS DOUBLE) AS as_number FROM orders")
def cast_atomic(spark, sf):
    p = F.col("o_orderpriority")
    return table(spark, sf, "orders").select("o_orderkey", types.cast_atomic(p, "integer").alias("as_int"), types.cast_atomic(F.substring(p, 1, 1), "number").alias("as_number"))


# factors

_LEVELS = PRIORITIES[:4]
_LEVELS_SQL = "[" + ", ".join(f"'{x}'" for x in _LEVELS) + "]"


@query(f"SELECT o_orderkey, (list_position({_LEVELS_SQL}, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_orderpriority END) - 1)::INT AS code FROM orders")
def factor_encode(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 10 != 0, F.col("o_orderpriority")).alias("code"))
    return factors.factor_encode(o, "code", _LEVELS)


@query(f"SELECT o_orderkey, CASE WHEN list_contains({_LEVELS_SQL}, o_orderpriority) THEN o_orderpriority END AS v FROM orders")
def factor_decode(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("v"))
    path = saved(factors.factor_encode(o, "v", _LEVELS), "factor")
    return factors.factor_decode(store.read_object(spark, path), "v")


@query(f"SELECT o_orderkey, (row_number() OVER (ORDER BY list_position({_LEVELS_SQL}, o_orderpriority) NULLS FIRST, o_orderkey) - 1)::BIGINT AS place FROM orders")
def factor_ordered_sort(spark, sf):
    from cairnframe.operators.rows import dense_index

    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    coded = factors.factor_encode(o, "o_orderpriority", _LEVELS, ordered=True)
    return dense_index(coded, "place", F.col("o_orderpriority").asc_nulls_first(), F.col("o_orderkey").asc()).select("o_orderkey", "place")


@query("SELECT p_partkey, p_size AS code FROM part WHERE p_size < 0 OR p_size >= 40")
def factor_code_violations(spark, sf):
    return factors.code_violations(table(spark, sf, "part").select("p_partkey", F.col("p_size").alias("code")), "code", 40)


@query("SELECT p_partkey, (dense_rank() OVER (ORDER BY p_type) - 1)::INT AS code FROM part")
def factor_many_levels(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.col("p_type").alias("code"))
    return factors.factor_encode(p, "code", factors.factor_levels(p, "code"))


_PAIR = "CASE WHEN l_linenumber = 7 THEN NULL ELSE l_returnflag END AS flag, l_linestatus AS status"


def _pairs(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") != 7, F.col("l_returnflag")).alias("flag"), F.col("l_linestatus").alias("status"))


@query(f"SELECT DISTINCT flag, status, (dense_rank() OVER (ORDER BY flag NULLS FIRST, status NULLS FIRST) - 1)::INT AS code FROM (SELECT {_PAIR} FROM lineitem)")
def row_factor_levels(spark, sf):
    return factors.row_factor_levels(_pairs(spark, sf), ["flag", "status"])


@query(f"SELECT l_orderkey, l_linenumber, (dense_rank() OVER (ORDER BY flag NULLS FIRST, status NULLS FIRST) - 1)::INT AS code FROM (SELECT l_orderkey, l_linenumber, {_PAIR} FROM lineitem)")
def row_factor_encode(spark, sf):
    df = _pairs(spark, sf)
    return factors.row_factor_encode(df, ["flag", "status"], factors.row_factor_levels(df, ["flag", "status"])).select("l_orderkey", "l_linenumber", "code")


@query(f"SELECT flag, status, count(*) AS n FROM (SELECT {_PAIR} FROM lineitem) GROUP BY flag, status")
def row_factor_decode(spark, sf):
    df = _pairs(spark, sf)
    levels = factors.row_factor_levels(df, ["flag", "status"])
    path = saved(store.RowFactor(factors.row_factor_encode(df, ["flag", "status"], levels).select("code"), levels), "row-factor")
    return store.read_object(spark, path).groupBy("flag", "status").agg(F.count("*").alias("n"))


@query("SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY p_brand, p_size HAVING count(*) > 1")
def row_factor_duplicate_levels(spark, sf):
    return factors.duplicate_levels(table(spark, sf, "part"), ["p_brand", "p_size"])


# variable-length strings

_BYTES = "octet_length(encode(text))"


@query(f"SELECT lang, max({_BYTES}) * count(*) > sum({_BYTES}) + 16 * count(*) AS use_vls FROM documents GROUP BY lang")
def vls_decision(spark, sf):
    return table(spark, sf, "documents").groupBy("lang").agg(vls.use_vls(F.col("text")).alias("use_vls"))


@query(f"SELECT doc_id, coalesce(sum({_BYTES}) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\", {_BYTES}::BIGINT AS length FROM documents")
def vls_pointers(spark, sf):
    return vls.pointers(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text").select("doc_id", "offset", "length")


@query("SELECT doc_id, text AS value FROM documents")
def vls_decode(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return vls.read(vls.pointers(docs, "doc_id", "text", 256).drop("text"), vls.heaps(docs, "doc_id", "text", 256)).select("doc_id", "value")


@query("SELECT doc_id FROM documents WHERE doc_id % 50 = 0 AND octet_length(encode(text)) >= 0")
def vls_bounds_violations(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    pointed = vls.pointers(docs, "doc_id", "text", 256).withColumn("length", F.col("length") + F.when(F.col("doc_id") % 50 == 0, F.lit(1 << 40)).otherwise(F.lit(0)))
    return vls.bounds_violations(pointed, vls.heaps(docs, "doc_id", "text", 256)).select("doc_id")


# date-times

_STAMP = """CASE event_id % 5 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || '.25+01:30'
    WHEN 2 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 3 THEN '2023-02-30T00:00:00Z' ELSE NULL END"""


def _stamps(spark, sf):
    ts = F.col("ts")
    s = (
        F.when(F.col("event_id") % 5 == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(F.col("event_id") % 5 == 1, F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(".25+01:30")))
        .when(F.col("event_id") % 5 == 2, F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
        .when(F.col("event_id") % 5 == 3, F.lit("2023-02-30T00:00:00Z"))
    )
    return table(spark, sf, "events").select("event_id", s.alias("s"))


_GRAMMAR = datetimes.RFC3339.removeprefix(r"\A").removesuffix(r"\z")
_VALID = f"(regexp_full_match(s, '{_GRAMMAR}') AND try_cast(substr(s, 1, 10) AS DATE) IS NOT NULL)"


@query(f"SELECT event_id, CASE WHEN {_VALID} THEN s END AS s FROM (SELECT event_id, {_STAMP} AS s FROM events)")
def rfc3339_validate(spark, sf):
    return datetimes.mark_rfc3339(_stamps(spark, sf), "s")


@query(
    f"""SELECT event_id, CASE WHEN {_VALID} THEN strftime(CASE WHEN event_id % 5 = 0 THEN date_trunc('second', ts) ELSE date_trunc('second', ts) - INTERVAL 90 MINUTE END, '%Y-%m-%d %H:%M:%S') END AS at
    FROM (SELECT event_id, ts, {_STAMP} AS s FROM events)"""
)
def rfc3339_to_timestamp(spark, sf):
    return _stamps(spark, sf).select("event_id", F.date_format(datetimes.to_timestamp(F.col("s")), "yyyy-MM-dd HH:mm:ss").alias("at"))


@query(f"SELECT CASE WHEN {_VALID} THEN s END AS s FROM (SELECT {_STAMP} AS s FROM events) UNION ALL SELECT NULL AS s FROM region")
def rfc3339_combine(spark, sf):
    return datetimes.combine([_stamps(spark, sf).select("s"), table(spark, sf, "region").select(F.col("r_name").alias("s"))], "s")


@query(f"SELECT event_id, CASE WHEN event_id % 7 = 0 THEN '2020-01-01T00:00:00Z' WHEN event_id % 7 = 1 THEN NULL WHEN {_VALID} THEN s END AS s FROM (SELECT event_id, {_STAMP} AS s FROM events)")
def rfc3339_replace(spark, sf):
    c, k = datetimes.as_rfc3339(F.col("s")), F.col("event_id") % 7
    c = datetimes.replace_at(c, k == 0, F.lit("2020-01-01T00:00:00Z"))
    return _stamps(spark, sf).select("event_id", datetimes.replace_at(c, k == 1, F.lit("charlie")).alias("s"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS stamp FROM events")
def date_sanitize(spark, sf):
    ts = F.col("ts")
    return table(spark, sf, "events").select("event_id", datetimes.sanitize_date(ts).alias("day"), datetimes.from_timestamp(ts.cast("timestamp")).alias("stamp"))


# strict CSV


def _csv_rows(spark, sf):
    k = F.col("p_partkey")
    return table(spark, sf, "part").select(
        k.cast("double").alias("key"),
        F.when(k % 5 == 0, F.lit(None)).when(k % 5 == 1, F.lit("NA")).when(k % 5 == 2, F.concat(F.lit('say "hi",\n'), "p_name")).otherwise(F.col("p_name")).alias('na"me, x'),
        F.when(k % 7 == 0, F.lit(None)).when(k % 7 == 1, F.lit(float("nan"))).when(k % 7 == 2, F.lit(float("-inf"))).otherwise(F.col("p_retailprice") * 1e9).alias("price"),
        F.when(k % 3 != 0, k % 2 == 0).alias("even"),
    )


_CSV_SQL = """SELECT p_partkey::DOUBLE AS "key", CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'NA' WHEN 2 THEN 'say "hi",' || chr(10) || p_name ELSE p_name END AS "na""me, x",
    CASE p_partkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'NaN'::DOUBLE WHEN 2 THEN '-infinity'::DOUBLE ELSE p_retailprice * 1e9 END AS price,
    CASE WHEN p_partkey % 3 <> 0 THEN p_partkey % 2 = 0 END AS even FROM part"""


@query(_CSV_SQL)
def strict_csv_roundtrip(spark, sf):
    path = scratch(spark, "csv")
    strict_csv.write_strict_csv(_csv_rows(spark, sf), path)
    return strict_csv.read_strict_csv(spark, path)


@query(_CSV_SQL)
def strict_csv_gzip(spark, sf):
    path = scratch(spark, "csv")
    strict_csv.write_strict_csv(_csv_rows(spark, sf), path, gzipped=True)
    return strict_csv.read_strict_csv(spark, path, "`key` double, `na\"me, x` string, price double, even boolean")


@query("SELECT * FROM (VALUES (0, 'key', 'number'), (1, 'na\"me, x', 'string'), (2, 'price', 'number'), (3, 'even', 'boolean'), (4, 'none', 'unknown')) t(position, name, type)")
def csv_type_report(spark, sf):
    path = scratch(spark, "csv")
    strict_csv.write_strict_csv(_csv_rows(spark, sf).withColumn("none", F.lit(None).cast("string")), path)
    return strict_csv.column_types(spark, path)


@query("SELECT count(*) AS n FROM orders WHERE o_orderpriority IS NOT NULL AND try_cast(o_orderpriority AS INT) IS NULL")
def csv_coercion_violations(spark, sf):
    return strict_csv.coercion_violations(table(spark, sf, "orders"), "o_orderpriority", "int").agg(F.count("*").alias("n"))


# nested lists


def _conversation_json(spark, sf):
    """One typed document per conversation, its turns in order."""
    leaf = lambda c: F.struct(F.lit("string").alias("type"), F.col(c).alias("values"))
    turn = F.struct(F.col("turn"), F.struct(F.lit("list").alias("type"), F.array(leaf("role"), leaf("text")).alias("values"), F.lit(["role", "text"]).alias("names")).alias("node"))
    turns = F.transform(F.array_sort(F.collect_list(turn)), lambda t: t["node"])
    c = table(spark, sf, "conversations").where("text is not null and role is not null").groupBy("conv_id").agg(turns.alias("values"))
    return c.select(F.col("conv_id").cast("string").alias("object"), F.to_json(F.struct(F.lit("list").alias("type"), "values")).alias("json"))


_TURNS = "SELECT conv_id::VARCHAR AS object, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1)::INT AS turn, role, text FROM conversations WHERE text IS NOT NULL AND role IS NOT NULL"
_LEAVES_SQL = f"WITH t AS ({_TURNS}) SELECT object, turn, 'role' AS field, role AS value FROM t UNION ALL SELECT object, turn, 'text', text FROM t"


def _leaves(rows):
    return rows.where("kind = 'vector'").select("object", F.get("idx", F.lit(0)).alias("turn"), F.element_at("path", -1).alias("field"), F.get("values", F.lit(0)).alias("value"))


@query(_LEAVES_SQL)
def list_flatten(spark, sf):
    return _leaves(lists.list_to_rows(_conversation_json(spark, sf)))


@query(_LEAVES_SQL)
def list_roundtrip(spark, sf):
    path = saved(store.NestedList(lists.list_to_rows(_conversation_json(spark, sf))), "list")
    again = lists.rows_to_list(store.read_object(spark, path))
    return _leaves(lists.list_to_rows(again))


_SPECIAL_SQL = "CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'NaN'::DOUBLE WHEN 2 THEN 'infinity'::DOUBLE WHEN 3 THEN '-infinity'::DOUBLE ELSE p_retailprice END"


@query(f"SELECT p_size::VARCHAR AS object, {_SPECIAL_SQL} AS value FROM part")
def list_float_specials(spark, sf):
    k, x = F.col("p_partkey") % 5, F.col("p_retailprice")
    text = F.when(k == 0, F.lit("null")).when(k == 1, F.lit('"NaN"')).when(k == 2, F.lit('"Inf"')).when(k == 3, F.lit('"-Inf"')).otherwise(x.cast("string"))
    part = table(spark, sf, "part").groupBy(F.col("p_size").cast("string").alias("object")).agg(F.concat(F.lit('{"type":"number","values":['), F.array_join(F.collect_list(text), ","), F.lit("]}")).alias("json"))
    return lists.number_values(lists.list_to_rows(part)).select("object", "value")


@query("SELECT p_size::VARCHAR AS object, p_brand AS name, count(*) AS n FROM part GROUP BY p_size, p_brand HAVING count(*) > 1")
def list_name_violations(spark, sf):
    doc = F.to_json(F.struct(F.lit("integer").alias("type"), F.collect_list(F.col("p_partkey")).alias("values"), F.collect_list("p_brand").alias("names")))
    part = table(spark, sf, "part").groupBy(F.col("p_size").cast("string").alias("object")).agg(doc.alias("json"))
    return lists.name_violations(lists.list_to_rows(part)).select("object", "name", "n")


@query("SELECT n_nationkey::VARCHAR AS object, (n_nationkey % 2 = 0) AS boxed, n_name AS value FROM nation")
def list_boxed_scalars(spark, sf):
    name = F.concat(F.lit('"'), "n_name", F.lit('"'))
    value = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("["), name, F.lit("]"))).otherwise(name)
    docs = table(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("object"), F.concat(F.lit('{"type":"string","values":'), value, F.lit("}")).alias("json"))
    return lists.list_to_rows(lists.rows_to_list(lists.list_to_rows(docs))).select("object", "boxed", F.get("values", F.lit(0)).alias("value"))


@query("SELECT * FROM (VALUES (0, 'child 0'), (1, 'child 1'), (2, 'child 2'), (3, 'child 3'), (4, 'child 4'), (5, 'child 5'), (6, 'child 6'), (7, 'child 7'), (8, 'child 8'), (9, 'child 9'), (10, 'child 10'), (11, 'child 11')) t(number, value)")
def list_external_children(spark, sf):
    doc = json.dumps({"type": "list", "values": [{"type": "external", "index": i} for i in range(12)]})
    rows = lists.list_to_rows(spark.createDataFrame([("x", doc)], "object string, json string"))
    children = {i: spark.createDataFrame([(f"child {i}",)], "value string") for i in range(12)}
    path = saved(store.NestedList(rows, children), "external")
    frames = [store.read_object(spark, p).select(F.lit(i).alias("number"), "value") for i, p in store.external_children(spark, path).items()]
    return functools.reduce(DataFrame.unionByName, frames)


# catalogs


def _tree(spark, sf):
    nation = table(spark, sf, "nation")
    root = scratch(spark, "tree")
    store.save_object(nation, f"{root}/flat")
    store.save_object(store.NestedList(lists.rows_of_value(spark, {"a": 1}), {0: nation}), f"{root}/deep/stuff")
    return root


@query("SELECT * FROM (VALUES ('flat', 'data_frame', false), ('deep/stuff', 'simple_list', false)) t(path, type, child)")
def list_objects(spark, sf):
    return catalog.list_objects(spark, _tree(spark, sf))


@query("SELECT * FROM (VALUES ('flat', 'data_frame', false), ('deep/stuff', 'simple_list', false), ('deep/stuff/other_contents/0', 'data_frame', true)) t(path, type, child)")
def list_objects_children(spark, sf):
    return catalog.list_objects(spark, _tree(spark, sf), include_children=True)


_META_SQL = """meta AS (
  SELECT 'c/' || c_custkey || '/x' AS path, c_custkey AS k, c_custkey % 2 = 0 AS is_child FROM customer
), refs AS (
  SELECT 'c/' || (c_custkey + 1) || '/x' AS child FROM customer WHERE c_custkey % 2 = 1
  UNION ALL SELECT 'c/' || (c_custkey + 1) || '/x' FROM customer WHERE c_custkey % 10 = 1
  UNION ALL SELECT 'c/' || (c_custkey + 2) || '/x' FROM customer WHERE c_custkey % 22 = 1
  UNION ALL SELECT 'c/lost' || c_custkey FROM customer WHERE c_custkey % 30 = 1
)"""


def _meta(spark, sf):
    k = F.col("c_custkey")
    name = lambda n: F.concat(F.lit("c/"), n.cast("string"), F.lit("/x"))
    children = F.filter(
        F.array(
            F.when(k % 2 == 1, name(k + 1)),
            F.when(k % 10 == 1, name(k + 1)),
            F.when(k % 22 == 1, name(k + 2)),
            F.when(k % 30 == 1, F.concat(F.lit("c/lost"), k.cast("string"))),
        ),
        lambda c: c.isNotNull(),
    )
    return table(spark, sf, "customer").select(name(k).alias("path"), F.concat(name(k), F.lit(".json")).alias("file"), (k % 2 == 0).alias("is_child"), children.alias("children"))


@query(f"WITH {_META_SQL} SELECT DISTINCT child AS path FROM refs WHERE child NOT IN (SELECT path FROM meta WHERE is_child)")
def catalog_missing_child(spark, sf):
    return setrules.missing_children(_meta(spark, sf))


@query(f"WITH {_META_SQL} SELECT path FROM meta WHERE is_child EXCEPT SELECT child FROM refs")
def catalog_extra_child(spark, sf):
    return setrules.unreferenced_children(_meta(spark, sf))


@query(f"WITH {_META_SQL} SELECT child AS path, count(*) AS n FROM refs GROUP BY child HAVING count(*) > 1")
def catalog_duplicate_ref(spark, sf):
    return setrules.duplicate_references(_meta(spark, sf))


@query(f"WITH {_META_SQL} SELECT child AS path FROM refs INTERSECT SELECT path FROM meta WHERE NOT is_child")
def catalog_conflict(spark, sf):
    return setrules.conflicts(_meta(spark, sf))


@query("SELECT 'c/' || s_suppkey || '/x' AS path FROM supplier EXCEPT SELECT 'c/' || c_custkey || '/x' FROM customer WHERE c_custkey % 3 <> 0")
def catalog_unknown_file(spark, sf):
    meta = _meta(spark, sf).where(F.regexp_extract("path", r"c/(\d+)/", 1).cast("long") % 3 != 0)
    return setrules.unknown_files(meta, table(spark, sf, "supplier").select(F.concat(F.lit("c/"), F.col("s_suppkey").cast("string"), F.lit("/x")).alias("path")))


@query("SELECT 'c/' || c_custkey || '/x' AS path FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def catalog_missing_path(spark, sf):
    return setrules.missing_paths(_meta(spark, sf), table(spark, sf, "supplier").select(F.concat(F.lit("c/"), F.col("s_suppkey").cast("string"), F.lit("/x")).alias("path")))


# the directories r<k>-b stand between r<k> and what lies in it, so that the neighbour form misses some
_NESTED_SQL = """SELECT CASE WHEN n_nationkey % 4 = 0 THEN 'r' || n_regionkey || '/f' WHEN n_nationkey % 4 = 1 THEN 'r' || n_regionkey || '/n' || n_nationkey || '/f'
  WHEN n_regionkey % 2 = 0 THEN 'r' || n_regionkey || '-b/n' || n_nationkey || '/f' ELSE 'z/n' || n_nationkey || '/f' END AS p FROM nation"""


def _nested(spark, sf):
    r, n, k = F.col("n_regionkey").cast("string"), F.col("n_nationkey").cast("string"), F.col("n_nationkey") % 4
    path = F.when(k == 0, F.concat(F.lit("r"), r, F.lit("/f"))).when(k == 1, F.concat(F.lit("r"), r, F.lit("/n"), n, F.lit("/f"))).when(F.col("n_regionkey") % 2 == 0, F.concat(F.lit("r"), r, F.lit("-b/n"), n, F.lit("/f"))).otherwise(F.concat(F.lit("z/n"), n, F.lit("/f")))
    return table(spark, sf, "nation").select(path.alias("path"), F.lit(False).alias("is_child"))


@query(
    f"""WITH d AS (SELECT regexp_replace(p, '/[^/]*$', '') AS dir FROM ({_NESTED_SQL})), w AS (SELECT dir, lag(dir) OVER (ORDER BY dir) AS before FROM d)
    SELECT dir AS path, before AS inside FROM w WHERE starts_with(dir, before || '/')"""
)
def catalog_nested(spark, sf):
    return setrules.nested_by_neighbour(_nested(spark, sf))


@query(f"WITH d AS (SELECT DISTINCT regexp_replace(p, '/[^/]*$', '') AS dir FROM ({_NESTED_SQL})) SELECT a.dir AS path, b.dir AS inside FROM d a JOIN d b ON starts_with(a.dir, b.dir || '/')")
def catalog_nested_anywhere(spark, sf):
    return setrules.nested_anywhere(_nested(spark, sf))


def _redirects(spark, sf):
    base = table(spark, sf, "customer").select(F.col("c_name").alias("path"), F.col("c_custkey").alias("object"))
    alias = table(spark, sf, "supplier").select(F.col("s_name").alias("path"), F.format_string("Customer#%09d", F.col("s_suppkey") * 2).alias("target"))
    return base, alias


_REDIRECT_SQL = "base AS (SELECT c_name AS path, c_custkey AS object FROM customer), r AS (SELECT s_name AS path, printf('Customer#%09d', s_suppkey * 2) AS target FROM supplier), alias AS (SELECT r.path, object FROM r JOIN base ON base.path = target)"


@query(f"WITH {_REDIRECT_SQL} SELECT * FROM base WHERE path NOT IN (SELECT target FROM r) UNION ALL SELECT * FROM alias")
def redirect_from(spark, sf):
    return setrules.redirect(*_redirects(spark, sf), "from")


@query(f"WITH {_REDIRECT_SQL} SELECT * FROM base")
def redirect_to(spark, sf):
    return setrules.redirect(*_redirects(spark, sf), "to")


@query(f"WITH {_REDIRECT_SQL} SELECT * FROM base UNION ALL SELECT * FROM alias")
def redirect_both(spark, sf):
    return setrules.redirect(*_redirects(spark, sf), "both")


@query(f"WITH {_REDIRECT_SQL} SELECT DISTINCT target AS path FROM r WHERE target NOT IN (SELECT path FROM base WHERE object % 4 <> 0)")
def redirect_dangling(spark, sf):
    base, alias = _redirects(spark, sf)
    return setrules.dangling_redirects(alias, base.where("object % 4 <> 0"))


# contents, files, provenance


@query("SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first FROM documents")
def dedup_first_copy(spark, sf):
    return catalog.first_copies(table(spark, sf, "documents"), "doc_id", "text")


@query("SELECT o_custkey AS key, min(o_custkey) OVER (PARTITION BY o_orderstatus, o_orderpriority) AS first FROM (SELECT DISTINCT o_custkey, o_orderstatus, o_orderpriority FROM orders)")
def dedup_nested_content(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("key"), F.struct("o_orderstatus", "o_orderpriority").alias("content")).distinct()
    return catalog.first_copies(o, "key", "content")


@query("SELECT doc_id, md5(text) AS md5 FROM documents")
def md5sum(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("md5"))


@query("SELECT 'a' AS pair, true AS same UNION ALL SELECT 'b', false")
def dedup_session(spark, sf):
    nation = table(spark, sf, "nation")
    session = catalog.DedupSession()
    session.add(nation, "first")
    hit = session.check(nation.select("*")) is not None
    other = session.check(nation.withColumn("n_nationkey", F.col("n_nationkey") + 1)) is not None
    return spark.createDataFrame([("a", hit), ("b", other)], "pair string, same boolean")


@query("SELECT event_id, '/data/' || event_type || '/f' || (event_id % 10) AS path FROM events")
def absolutize_path(spark, sf):
    rel = F.concat(F.lit("./x/../"), "event_type", F.lit("//y/.././f"), (F.col("event_id") % 10).cast("string"))
    return table(spark, sf, "events").select("event_id", absolutize_column(rel, F.lit("/data")).alias("path"))


_NULLS = """concat('{"id":', event_id, ',"none":null,"deep":{"a":null,"b":"', event_type, '","c":{"d":null}},"list":[1,2]}')"""


@query(f"SELECT event_id, json_merge_patch('{{}}', {_NULLS})::VARCHAR AS document FROM events")
def metadata_strip_null(spark, sf):
    return table(spark, sf, "events").select("event_id", strip_null_documents(F.expr(_NULLS)).alias("document"))


@query("SELECT 'pyspark' AS type, true AS has_version")
def provenance_record(spark, sf):
    path = saved(table(spark, sf, "region"), "recorded")
    found = json.loads(Files(spark).read(f"{path}/{provenance.FILE}"))
    return spark.createDataFrame([(found["type"], "version" in strip_nulls(found))], "type string, has_version boolean")


@query("SELECT count(*) AS n, 'mine' AS reader FROM nation")
def registry_dispatch(spark, sf):
    path = saved(table(spark, sf, "nation"), "mine")
    registry.readers.register("mine", lambda s, p, body, **_: store.read_frame(s, p, body).agg(F.count("*").alias("n")).withColumn("reader", F.lit(body["type"])), existing="new")
    try:
        return store.read_object(spark, path, metadata={"type": "mine"})
    finally:
        registry.readers.register("mine", None)


@query("SELECT n_name, true AS seen FROM nation")
def override_dispatch(spark, sf):
    path = saved(table(spark, sf, "nation").select("n_name"), "override")
    before = store.alt_read.set(lambda s, p, **o: store._read(s, p, **o).withColumn("seen", F.lit(True)))
    try:
        return store.read_object(spark, path)
    finally:
        store.alt_read.set(before)


@query("SELECT * FROM (VALUES ('code', 'v: 9'), ('levels', 'repeated 2 times')) t(rule, detail)")
def object_violations(spark, sf):
    from cairnframe.operators import validate

    nation = table(spark, sf, "nation")
    bad = factors.factor_encode(nation.select(F.col("n_name").alias("v")), "v", ["ALGERIA"])
    meta = bad.schema["v"].metadata
    broken = nation.where("n_nationkey = 9").select(F.col("n_nationkey").cast("int").alias("v")).withMetadata("v", meta)
    one = saved(broken, "broken", validate=False)
    levels = spark.createDataFrame([(0, "x"), (1, "x")], "code int, level string")
    two = saved(store.RowFactor(levels.select("code"), levels), "broken", validate=False)
    return validate.violations(spark, one).unionByName(validate.violations(spark, two)).select("rule", "detail")
