"""More of the query slate: the older layout, format options, and rules that ``slate`` leaves out."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnframe.functions import datetimes, missing, types
from cairnframe.operators import factors, lists, setrules, validate
from cairnframe.operators.rows import scratch
from cairnframe.plans import registry
from cairnframe.plans.slate import PRIORITIES, query, saved, table
from cairnframe.sources import legacy, staging, store, strict_csv
from cairnframe.sources.files import Files, copy_directory


def staged(x, **options) -> tuple[str, dict]:
    """(directory, document) of an object staged in the older layout."""
    spark = store.spark_of(x)
    root = scratch(spark, "older")
    Files(spark).make(root)
    done = legacy.write_metadata(spark, legacy.alt_stage(x, root, "object", **options), root)
    return root, legacy.acquire_metadata(spark, root, done["path"])


# the older layout


def _nested_orders(spark, sf):
    o = table(spark, sf, "orders")
    day = F.col("o_orderdate").cast("date").alias("day")
    o = o.select("o_orderkey", "o_orderpriority", day, F.struct(F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price")).alias("inner"), F.array("o_custkey", "o_orderkey").alias("pair"))
    return factors.factor_encode(o, "o_orderpriority", PRIORITIES, ordered=True)


_NESTED_ORDERS = "SELECT o_orderkey, o_orderpriority, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderstatus AS status, o_totalprice AS price, o_custkey AS first, o_orderkey AS second FROM orders"


def _flat(df):
    df = factors.factor_decode(df, "o_orderpriority")
    return df.select("o_orderkey", "o_orderpriority", F.col("day").cast("string").alias("day"), "inner.status", "inner.price", F.get("pair", F.lit(0)).alias("first"), F.get("pair", F.lit(1)).alias("second"))


@query(_NESTED_ORDERS)
def legacy_frame(spark, sf):
    root, meta = staged(_nested_orders(spark, sf))
    return _flat(legacy.load_object(spark, meta, root))


@query(_NESTED_ORDERS)
def legacy_frame_first_version(spark, sf):
    """Factors as text with levels in a table, dates as a type of their own."""
    root, meta = staged(_nested_orders(spark, sf), df_version=1)
    assert [c["type"] for c in meta["data_frame"]["columns"]][1:3] == ["ordered", "date"]
    return _flat(legacy.load_object(spark, meta, root))


@query(_NESTED_ORDERS)
def legacy_frame_parquet(spark, sf):
    before = staging.frame_format("parquet")
    try:
        root, meta = staged(_nested_orders(spark, sf))
    finally:
        staging.frame_format(before)
    return _flat(legacy.load_object(spark, meta, root))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, o_custkey AS first FROM orders")
def legacy_frame_without_nested(spark, sf):
    root, meta = staged(_nested_orders(spark, sf))
    df = legacy.load_object(spark, meta, root, include_nested=False)
    assert "inner" not in df.columns
    return df.select("o_orderkey", F.col("day").cast("string").alias("day"), F.get("pair", F.lit(0)).alias("first"))


@query("SELECT s_name AS names, s_acctbal AS value FROM supplier")
def legacy_vector(spark, sf):
    root, meta = staged(store.Vector(table(spark, sf, "supplier"), "s_acctbal", "s_name"))
    return legacy.load_object(spark, meta, root)


@query("SELECT c_name AS names, c_mktsegment AS value FROM customer")
def legacy_factor(spark, sf):
    c = table(spark, sf, "customer")
    coded = factors.factor_encode(c.select("c_name", F.col("c_mktsegment").alias("value")), "value", factors.factor_levels(c, "c_mktsegment"))
    root, meta = staged(store.Factor(coded, "value", "c_name"))
    return factors.factor_decode(legacy.load_object(spark, meta, root), "value")


@query("SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY p_brand, p_size")
def legacy_row_factor(spark, sf):
    p = table(spark, sf, "part").select("p_brand", "p_size")
    levels = factors.row_factor_levels(p, ["p_brand", "p_size"])
    root, meta = staged(store.RowFactor(factors.row_factor_encode(p, ["p_brand", "p_size"], levels).select("code"), levels))
    return legacy.load_object(spark, meta, root).groupBy("p_brand", "p_size").agg(F.count("*").alias("n"))


def _segments(spark, sf):
    """One list per nation: the segments of its customers as an ordered factor, and a date."""
    c = table(spark, sf, "customer")
    levels = factors.factor_levels(c, "c_mktsegment")
    code = factors.code_of(F.col("c_mktsegment"), levels)
    factor = F.struct(F.lit("factor").alias("type"), F.collect_list(code).alias("values"), F.lit(levels).alias("levels"), F.lit(True).alias("ordered"))
    day = F.struct(F.lit("string").alias("type"), F.array(F.lit("2020-02-29")).alias("values"), F.lit("date").alias("format"))
    json = F.concat(F.lit('{"type":"list","values":['), F.to_json(factor), F.lit(","), F.to_json(day), F.lit("]}"))
    return lists.list_to_rows(c.groupBy(F.col("c_nationkey").cast("string").alias("object")).agg(json.alias("json")))


_SEGMENTS = "SELECT c_nationkey::VARCHAR AS object, c_mktsegment AS value, 'true' AS note FROM customer UNION ALL SELECT DISTINCT c_nationkey::VARCHAR, '2020-02-29', 'date' FROM customer"


def _segment_values(rows):
    level = F.get("levels", F.col("v").cast("int"))
    spread = rows.where("kind <> 'list'").select("object", "kind", "levels", "format", "ordered", F.explode("values").alias("v"))
    return spread.select("object", F.when(F.col("kind") == "factor", level).otherwise(F.col("v")).alias("value"), F.when(F.col("kind") == "factor", F.col("ordered").cast("string")).otherwise(F.col("format")).alias("note"))


@query(_SEGMENTS)
def list_factor(spark, sf):
    path = saved(store.NestedList(_segments(spark, sf)), "factor-list")
    return _segment_values(lists.list_to_rows(lists.rows_to_list(store.read_object(spark, path))))


@query(_SEGMENTS)
def legacy_list(spark, sf):
    root, meta = staged(store.NestedList(_segments(spark, sf)))
    return _segment_values(legacy.load_object(spark, meta, root))


@query(_SEGMENTS)
def legacy_list_first_version(spark, sf):
    root, meta = staged(store.NestedList(_segments(spark, sf)), version=1)
    return _segment_values(legacy.load_object(spark, meta, root))


@query("SELECT r_regionkey::INT AS child, n_name FROM region JOIN nation ON n_regionkey = r_regionkey")
def legacy_list_children(spark, sf):
    nation = table(spark, sf, "nation")
    regions = [r[0] for r in table(spark, sf, "region").select("r_regionkey").orderBy("r_regionkey").collect()]
    children = {i: nation.where(F.col("n_regionkey") == k).select(F.lit(int(k)).alias("child"), "n_name") for i, k in enumerate(regions)}
    document = lists.rows_of_value(spark, {"regions": len(regions)})
    root, meta = staged(store.NestedList(document, children))
    first, *rest = staging.load_children(spark, meta, root)
    for df in rest:
        first = first.unionByName(df)
    return first


@query("SELECT 'o_orderkey' AS name, 'key of the order' AS note UNION ALL SELECT 'o_totalprice', 'in dollars' UNION ALL SELECT 'source', 'orders'")
def legacy_annotations(spark, sf):
    notes = spark.createDataFrame([("o_orderkey", "key of the order"), ("o_totalprice", "in dollars")], "name string, note string")
    frame = store.Frame(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), column_annotations=notes, annotations={"source": "orders"})
    root, meta = staged(frame)
    columns, whole = staging.load_annotations(spark, meta, root)
    return columns.unionByName(whole.where("kind = 'vector'").select(F.element_at("path", -1).alias("name"), F.get("values", F.lit(0)).alias("note")))


def _older_directory(spark, sf):
    root = scratch(spark, "older")
    for name in ("region", "nation"):
        legacy.quick_stage(table(spark, sf, name), root, name)
    return root


@query("SELECT * FROM (VALUES ('older', 'nation/simple.csv.gz'), ('older', 'region/simple.csv.gz'), ('newer', 'flat'), ('newer', 'inner/deep')) t(layout, path)")
def directory_validation(spark, sf):
    """Which layout a directory has is found out."""
    newer = scratch(spark, "newer")
    store.save_object(table(spark, sf, "nation"), f"{newer}/flat")
    store.save_object(store.NestedList(lists.rows_of_value(spark, {"a": 1}), {0: table(spark, sf, "region")}), f"{newer}/inner/deep")
    found = [("older", p) for p in validate.validate_directory(spark, _older_directory(spark, sf), attempt_load=True)]
    return spark.createDataFrame(found + [("newer", p) for p in validate.validate_directory(spark, newer)], "layout string, path string")


@query(
    """SELECT * FROM (VALUES ('conflict', 'b/simple.csv.gz'), ('dangling_redirect', 'gone'), ('missing_child', 'b/simple.csv.gz'), ('missing_path', 'c/simple.csv.gz'),
    ('nested', 'a/n'), ('shadowing_redirect', 'd/lost.txt'), ('stray_child', 'b/simple.csv.gz'), ('unexpected_path', 'a/n/simple.csv.gz'), ('unknown_file', 'd/lost.txt')) t(rule, path)"""
)
def directory_violations(spark, sf):
    """A directory with one fault of each kind, checked by all rules."""
    root = scratch(spark, "older")
    files = Files(spark)
    files.make(root)
    for path in ("a", "b", "c"):
        meta = legacy.stage_object(table(spark, sf, "region"), root, path)
        if path == "a":
            meta["extra"] = {"resource": {"type": "local", "path": "b/simple.csv.gz"}}
        legacy.write_metadata(spark, meta, root)
    files.delete(f"{root}/c/simple.csv.gz")
    files.make(f"{root}/a/n")
    files.write(f"{root}/a/n/simple.csv.gz", "")
    files.write(f"{root}/a/n/other.json", '{"$schema": "csv_data_frame/v1.json", "path": "a/n/simple.csv.gz", "is_child": false}')
    files.make(f"{root}/d")
    files.write(f"{root}/d/lost.txt", "x")
    files.write(f"{root}/d/lost.txt.json", '{"$schema": "redirection/v1.json", "path": "d/lost.txt", "redirection": {"targets": [{"type": "local", "location": "gone"}]}}')
    return setrules.all_violations(*legacy.catalog_frames(spark, root)).distinct()


@query("SELECT o_orderkey, o_orderstatus FROM orders")
def legacy_redirected_load(spark, sf):
    """The bare path of a staged object leads to its document."""
    root = scratch(spark, "older")
    legacy.quick_stage(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), root, "orders")
    return legacy.quick_load(spark, root, "orders")


# rules over catalogs


def _documents(spark, sf):
    k = F.col("c_custkey")
    path = F.concat(F.lit("c/"), k.cast("string"), F.lit("/x"))
    file = F.when(k % 3 == 0, F.concat(path, F.lit(".json"))).when(k % 3 == 1, path).otherwise(F.concat(F.lit("c/"), k.cast("string"), F.lit("/y.json")))
    child = F.when(k % 2 == 0, F.concat(F.lit("c/"), k.cast("string"), F.lit("/in/z"))).otherwise(F.concat(F.lit("c/"), (k + 1).cast("string"), F.lit("/z")))
    return table(spark, sf, "customer").select(path.alias("path"), file.alias("file"), F.lit(False).alias("is_child"), F.array(child).alias("children"))


@query("SELECT 'c/' || c_custkey || '/x' AS path FROM customer WHERE c_custkey % 3 = 2")
def catalog_unexpected_path(spark, sf):
    return setrules.unexpected_paths(_documents(spark, sf))


@query("SELECT 'c/' || (c_custkey + 1) || '/z' AS path FROM customer WHERE c_custkey % 2 = 1")
def catalog_stray_child(spark, sf):
    return setrules.stray_children(_documents(spark, sf))


@query("SELECT s_name AS path FROM supplier WHERE s_suppkey % 3 = 0")
def redirect_shadowing(spark, sf):
    s = table(spark, sf, "supplier")
    return setrules.shadowing_redirects(s.select(F.col("s_name").alias("path"), F.lit("t").alias("target")), s.where("s_suppkey % 3 = 0").select(F.col("s_name").alias("path")))


# strict CSV


@query("SELECT (100 + n_nationkey)::VARCHAR AS file, 2 + n_nationkey % 3 AS line, CASE WHEN n_nationkey % 3 = 2 THEN 1 ELSE 2 END AS position FROM nation WHERE n_nationkey % 3 > 0")
def csv_violation_report(spark, sf):
    """One file a nation; some have a cell of another type in the line behind their number."""
    root = scratch(spark, "csv-files")
    files = Files(spark)
    files.make(root)
    for r in table(spark, sf, "nation").collect():
        k = r["n_nationkey"] % 3
        lines = ['"name","key"', *(f'"{r["n_name"]}",{i}' for i in range(4))]
        if k == 1:
            lines[2] = f'"{r["n_name"]}",true'
        elif k == 2:
            lines[3] = "5,2"
        files.write(f"{root}/{100 + r['n_nationkey']}", "\n".join(lines) + "\n")
    found = strict_csv.csv_violations(spark, root)
    return found.select(F.element_at(F.split("path", "/"), -1).alias("file"), "line", F.col("column").alias("position"))


# missing values and storage options


@query("SELECT s AS held, n::DOUBLE AS value FROM (VALUES ('specials', 0), ('whole', 70), ('gap', 5)) t(s, n)")
def placeholder_number_search(spark, sf):
    """Where a column holds all special candidates, the least whole number that it does not hold stands for missing."""
    held = spark.createDataFrame([(x,) for x in missing.NUMBER_CANDIDATES[:4]] + [(float("nan"),), (None,)], "x double")
    ids = table(spark, sf, "lineitem").select((F.col("l_orderkey") % 70).cast("double").alias("x"))
    found = [("specials", missing.placeholder(held, "x")), ("whole", missing.placeholder(held.unionByName(ids).unionByName(spark.range(70).select(F.col("id").cast("double").alias("x"))), "x")), ("gap", missing.least_free_number(ids.unionByName(spark.range(70).select(F.col("id").cast("double").alias("x"))).where("x <> 5"), "x"))]
    return spark.createDataFrame(found, "held string, value double")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 > 1 THEN l_quantity END AS x FROM lineitem")
def placeholder_second_version(spark, sf):
    """Before version 3 NaN stands for missing numbers, and numbers that are NaN are lost with it."""
    x = F.when(F.col("l_linenumber") % 3 == 1, F.lit(float("nan"))).when(F.col("l_linenumber") % 3 > 1, F.col("l_quantity"))
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", x.alias("x"))
    return missing.decode_missing(missing.encode_missing(df, "x", version=2), "x", "double")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' THEN o_orderstatus END AS status, CASE WHEN o_custkey <> 7 THEN o_custkey END AS cust FROM orders")
def placeholder_attached(spark, sf):
    path = saved(table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("cust")), "plain")
    store.attach_placeholder(spark, path, "status", "F")
    store.attach_placeholder(spark, path, "cust", 7)
    return store.read_object(spark, path)


_GAPPED = "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 5 = 1 THEN '' ELSE c_name END AS name, c_mktsegment FROM customer"


@query(_GAPPED)
def vls_frame_roundtrip(spark, sf):
    k = F.col("c_custkey") % 5
    df = table(spark, sf, "customer").select("c_custkey", F.when(k == 1, F.lit("")).when(k > 1, F.col("c_name")).alias("name"), "c_mktsegment")
    path = saved(df, "heaps", vls=True)
    stored = spark.read.parquet(f"{path}/columns").schema
    assert stored["name"].dataType.typeName() == stored["c_mktsegment"].dataType.typeName() == "struct"
    return store.read_object(spark, path)


@query("SELECT doc_id, text, lang FROM documents")
def vls_chosen_by_size(spark, sf):
    """Pointers where a fixed width would need more bytes, as texts of very different lengths do."""
    path = saved(table(spark, sf, "documents").select("doc_id", "text", "lang"), "heaps", validate=False, data_frame__vls=None)
    stored = spark.read.parquet(f"{path}/columns").schema
    assert stored["text"].dataType.typeName() == "struct" and stored["lang"].dataType.typeName() == "string"
    return store.read_object(spark, path)


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def save_override(spark, sf):
    """An application's own way of saving also holds for children."""
    seen = []

    def save(x, path, **options):
        seen.append(path.rsplit("/", 1)[-1])
        store.save_as(x, path, **options)

    before = store.alt_save.set(save)
    try:
        levels = table(spark, sf, "region").select("r_name", F.col("r_regionkey").cast("int").alias("code"))
        nation = table(spark, sf, "nation")
        path = saved(store.RowFactor(nation.select(F.col("n_regionkey").cast("int").alias("code"), "n_name"), levels, name="n_name"), "override")
    finally:
        store.alt_save.set(before)
    assert seen[1:] == ["levels"]
    return store.read_object(spark, path).select(F.col("name").alias("n_name"), "r_name")


@query("SELECT 'other_annotations' AS rule, 1 AS before, 0 AS after")
def interface_relation(spark, sf):
    """Annotations of a type that is no list are a fault until the type is declared to have a list's interface."""
    path = saved(store.Frame(table(spark, sf, "region"), annotations={"a": 1}), "annotated")
    files = Files(spark)
    body = files.read(f"{path}/other_annotations/OBJECT")
    files.write(f"{path}/other_annotations/OBJECT", body.replace("simple_list", "my_list"), replace=True)
    registry.validators.register("my_list", validate.list_violations, existing="new")
    count = lambda: validate.violations(spark, path).where("rule = 'other_annotations'").count()
    try:
        before = count()
        registry.interfaces.change("my_list", "SIMPLE_LIST")
        after = count()
    finally:
        registry.interfaces.change("my_list", "SIMPLE_LIST", "remove")
        registry.validators.register("my_list", None)
    return spark.createDataFrame([("other_annotations", before, after)], "rule string, before int, after int")


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS stamp, true AS valid FROM events")
def rfc3339_from_timestamp(spark, sf):
    stamp = datetimes.from_timestamp(F.col("ts").cast("timestamp"))
    return table(spark, sf, "events").select("event_id", stamp.alias("stamp")).withColumn("valid", datetimes.is_valid(F.col("stamp")))


@query("SELECT n_regionkey, count(*) AS height FROM nation GROUP BY n_regionkey")
def object_heights(spark, sf):
    nation = table(spark, sf, "nation")
    keys = [r[0] for r in nation.select("n_regionkey").distinct().collect()]
    found = [(k, validate.height(spark, saved(nation.where(F.col("n_regionkey") == k), "part"))) for k in keys]
    return spark.createDataFrame(found, f"n_regionkey {nation.schema['n_regionkey'].dataType.simpleString()}, height long")


# smaller operators


@query("SELECT p_partkey, p_size || '.' || p_partkey AS version FROM part")
def version_strings(spark, sf):
    """Versions are text and stay so through storage, whatever number they look like."""
    p = table(spark, sf, "part").select("p_partkey", F.concat(F.col("p_size").cast("string"), F.lit("."), F.col("p_partkey").cast("string")).alias("version"))
    return store.read_object(spark, saved(types.versions_as_strings(p, "version"), "versions"))


@query("SELECT c_name AS name, c_mktsegment AS value FROM customer")
def factor_object(spark, sf):
    c = table(spark, sf, "customer")
    coded = factors.factor_encode(c.select("c_name", F.col("c_mktsegment").alias("v")), "v", factors.factor_levels(c, "c_mktsegment"))
    return factors.factor_decode(store.read_object(spark, saved(store.Factor(coded, "v", "c_name"), "factor")), "value").select("name", "value")


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 'NA' ELSE o_orderstatus END AS v, CASE o_orderkey % 3 WHEN 0 THEN 4 WHEN 1 THEN 0 ELSE list_position(['NA', 'F', 'O', 'P'], o_orderstatus) - 1 END::INT AS code FROM orders")
def factor_level_na(spark, sf):
    """A level that reads NA is not missing; for formats without NULL missing is the number of levels."""
    k = F.col("o_orderkey") % 3
    o = table(spark, sf, "orders").select("o_orderkey", F.when(k == 1, F.lit("NA")).when(k == 2, F.col("o_orderstatus")).alias("v"))
    coded = store.read_object(spark, saved(factors.factor_encode(o, "v", ["NA", "F", "O", "P"]), "levels"))
    coded = coded.withColumn("code", F.col("v")).withMetadata("code", coded.schema["v"].metadata)
    return factors.with_placeholder(factors.factor_decode(coded, "v"), "code")


@query("SELECT n_nationkey::VARCHAR AS object, 'vector' AS kind, n_name AS value FROM nation")
def list_like_coerced(spark, sf):
    """Tuples and dictionaries become typed lists."""
    frames = [lists.rows_of_value(spark, ({"name": r["n_name"]},), str(r["n_nationkey"])) for r in table(spark, sf, "nation").collect()]
    rows = frames[0]
    for f in frames[1:]:
        rows = rows.unionByName(f)
    return rows.where("kind = 'vector'").select("object", "kind", F.get("values", F.lit(0)).alias("value"))


@query("SELECT n_nationkey AS k, 'element 0/1: ''' || n_name || ''' is no integer' AS message FROM nation")
def list_error_path(spark, sf):
    """The message names the element by its path."""

    def fault(name: str) -> str:
        try:
            list(lists.flatten({"type": "list", "values": [{"type": "list", "values": [{"type": "nothing"}, {"type": "integer", "values": [1, name]}]}]}))
        except lists.ListError as e:
            return str(e)
        return ""

    n = table(spark, sf, "nation").select("n_nationkey", "n_name")
    return spark.createDataFrame([(r[0], fault(r[1])) for r in n.collect()], f"k {n.schema['n_nationkey'].dataType.simpleString()}, message string")


@query("SELECT 'external' AS rule, '7' AS detail UNION ALL SELECT 'names', ''")
def list_rule_violations(spark, sf):
    """A list that refers to a child it does not have, and names a value twice."""
    doc = '{"type":"list","names":["a","a"],"values":[{"type":"external","index":7},{"type":"nothing"}]}'
    rows = lists.list_to_rows(spark.createDataFrame([("x", doc)], "object string, json string"))
    return validate.violations(spark, saved(store.NestedList(rows), "broken", validate=False)).select("rule", "detail")


@query("SELECT n_nationkey, n_name FROM nation")
def directory_copy(spark, sf):
    path = saved(table(spark, sf, "nation").select("n_nationkey", "n_name"), "original")
    copy_directory(spark, path, f"{path}-copy")
    return store.read_object(spark, f"{path}-copy")


@query("SELECT 'data_frame' AS type, [count(*), 4] AS dimensions FROM nation UNION ALL SELECT 'atomic_vector', [count(*)] FROM region UNION ALL SELECT 'mine', [7, 7]")
def object_dimensions(spark, sf):
    """Dimensions by the object's type, and by a function registered for a type of one's own."""
    nation = table(spark, sf, "nation").limit(1_000_000)
    frame = saved(nation.select(*nation.columns[:3], F.lit(1).alias("one")), "frame")
    vector = saved(store.Vector(table(spark, sf, "region"), "r_name"), "vector")
    mine = saved(nation, "mine")
    files = Files(spark)
    files.write(f"{mine}/OBJECT", files.read(f"{mine}/OBJECT").replace('"type": "data_frame"', '"type": "mine"'), replace=True)
    registry.dimensions.register("mine", lambda *_: [7, 7], existing="new")
    try:
        found = [(t, validate.object_dimensions(spark, p)) for t, p in (("data_frame", frame), ("atomic_vector", vector), ("mine", mine))]
    finally:
        registry.dimensions.register("mine", None)
    return spark.createDataFrame(found, "type string, dimensions array<long>")


@query(_SEGMENTS)
def legacy_list_parquet(spark, sf):
    before = staging.list_format("parquet")
    try:
        root, meta = staged(store.NestedList(_segments(spark, sf)))
    finally:
        staging.list_format(before)
    return _segment_values(legacy.load_object(spark, meta, root))


@query("SELECT * FROM (VALUES ('moved', 'moved/simple.csv.gz'), ('moved/simple.csv.gz', NULL)) t(path, target)")
def legacy_move_and_remove(spark, sf):
    """A moved object's redirection follows; a removed one's goes with it."""
    root = _older_directory(spark, sf)
    legacy.move_object(spark, root, "nation/simple.csv.gz", "moved")
    legacy.remove_object(spark, root, "region/simple.csv.gz")
    validate.validate_directory(spark, root, attempt_load=True)
    return legacy.documents(spark, root).select("path", F.get("targets", F.lit(0)).alias("target"))


@query("SELECT unnest(['b/simple.csv.gz', 'c/simple.csv.gz', 'd/simple.csv.gz']) AS child")
def resource_references(spark, sf):
    """References are found at any depth of a document, in lists too."""
    root = scratch(spark, "older")
    Files(spark).make(root)
    meta = legacy.stage_object(table(spark, sf, "region"), root, "a")
    ref = lambda p: {"resource": {"type": "local", "path": f"{p}/simple.csv.gz"}}
    meta["deep"] = [{"one": ref("b")}, {"more": {"two": [ref("c"), ref("d")]}}]
    legacy.write_metadata(spark, meta, root)
    return legacy.documents(spark, root).select(F.explode("children").alias("child"))


@query("SELECT * FROM (VALUES ('a/simple.csv.gz', 'data_frame.columns'), ('a/simple.csv.gz', 'md5sum'), ('b', 'redirection.targets')) t(path, member)")
def document_members(spark, sf):
    """What documents lack by the rules of their kind."""
    root = scratch(spark, "older")
    files = Files(spark)
    files.make(root)
    files.write(f"{root}/a.json", '{"$schema": "csv_data_frame/v1.json", "path": "a/simple.csv.gz", "data_frame": {"row_names": false, "dimensions": [1, 1]}, "csv_data_frame": {"compression": "none"}}')
    files.write(f"{root}/b.json", '{"$schema": "redirection/v1.json", "path": "b", "redirection": {"targets": null}}')
    files.write(f"{root}/c.json", '{"$schema": "own/v2.json", "path": "c", "md5sum": "0"}')
    return legacy.document_violations(spark, root)


@query("SELECT doc_id, md5(text || chr(10)) AS md5 FROM documents WHERE doc_id < 5")
def artifact_md5(spark, sf):
    """MD5 sums of files as the documents of the older layout hold them."""
    root = scratch(spark, "sums")
    files = Files(spark)
    files.make(root)
    rows = table(spark, sf, "documents").where("doc_id < 5").select("doc_id", "text").collect()
    for r in rows:
        files.write(f"{root}/{r['doc_id']}", r["text"] + "\n")
    return spark.createDataFrame([(r["doc_id"], legacy.md5sum(spark, f"{root}/{r['doc_id']}")) for r in rows], "doc_id long, md5 string")
