import json
import math

import pytest
from pyspark.sql import functions as F

from cairnframe.functions import missing, types
from cairnframe.operators import catalog, factors, lists, validate
from cairnframe.plans import registry
from cairnframe.sources import provenance, store
from cairnframe.sources.files import Files


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def roundtrip(spark, x, path, **options):
    store.save_object(x, str(path))
    return store.read_object(spark, str(path), **options)


def test_all_column_types(spark, tmp_path):
    df = spark.range(123).select(
        F.concat(F.lit("s"), F.col("id").cast("string")).alias("stuff"),
        (F.col("id") % 3).cast("string").alias("blah"),
        F.col("id").cast("int").alias("foo"),
        (F.col("id") / 7).alias("whee"),
        F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("birthday"),
        F.struct((F.col("id") * 2).alias("A"), F.lit("x").alias("B")).alias("nested"),
        F.array(F.col("id"), F.lit(1)).alias("matrix"),
    )
    df = factors.factor_encode(df, "blah", list("3210"), ordered=True)
    back = roundtrip(spark, df, tmp_path / "f")
    assert rows(back) == rows(df)
    assert back.schema["blah"].metadata == {"levels": list("3210"), "ordered": True}
    assert back.dtypes == df.dtypes


def test_special_values_survive(spark, tmp_path):
    df = spark.createDataFrame(
        [("NA", math.nan, -(2**31), True), (None, None, None, None), ("_NA", math.inf, 2, False), ("漢字🙂", -math.inf, 0, None)], "s string, d double, i int, b boolean"
    )
    back = roundtrip(spark, df, tmp_path / "f")
    assert sorted(map(repr, map(tuple, back.collect()))) == sorted(map(repr, map(tuple, df.collect())))
    for column in df.columns:
        again = missing.decode_missing(missing.encode_missing(df, column), column, df.schema[column].dataType)
        assert missing.encode_missing(df, column).where(F.col(column).isNull()).count() == 0
        assert sorted(repr(r[0]) for r in again.select(column).collect()) == sorted(repr(r[0]) for r in df.select(column).collect())


def test_placeholders_only_where_something_is_missing(spark):
    df = spark.createDataFrame([("NA", 1.0, 1, True), ("__NA", math.nan, 2, False)], "s string, d double, i int, b boolean")
    assert [missing.placeholder(df, c) for c in df.columns] == [None] * 4
    df = df.unionByName(spark.createDataFrame([(None, None, None, None)], df.schema))
    assert [missing.placeholder(df, c) for c in df.columns] == ["_NA", math.inf, -(2**31), -1]
    full = spark.createDataFrame([(None,), (math.nan,), (math.inf,), (-math.inf,)], "d double")
    assert missing.placeholder(full, "d") == max(missing.NUMBER_CANDIDATES[:4][2:3])
    assert math.isnan(missing.placeholder(full.where("not isnan(d) or d is null"), "d"))
    assert df.where("false").agg(missing.any_missing(F.col("s"))).first()[0] is False


def test_names(spark, tmp_path):
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        odd = spark.createDataFrame([(1, 2, 3)], "`foo bar` int, `rabbit+2+3/5` int, `a\"b` int")
        assert roundtrip(spark, odd, tmp_path / "odd").columns == odd.columns
        for columns in (["rabbit", "rabbit"], ["", "x"]):
            with pytest.raises(ValueError):
                types.check_names(columns)
        cased = spark.createDataFrame([(1, 2)], "a int, A int")
        assert roundtrip(spark, cased, tmp_path / "cased").columns == ["a", "A"]
    finally:
        spark.conf.unset("spark.sql.caseSensitive")


def test_row_names_zero_columns_annotations(spark, tmp_path):
    df = spark.createDataFrame([("g1", 1), ("g2", None)], "g string, x int")
    back = roundtrip(spark, store.Frame(df, row_names="g", annotations={"WHEE": "foo", "n": [1, 2]}), tmp_path / "n")
    assert rows(back) == [("g1", 1), ("g2", None)] and types.ROW_NAME in back.columns
    notes = store.read_annotations(spark, str(tmp_path / "n"))[1]
    assert {tuple(r.path): r["values"] for r in notes.where("kind = 'vector'").collect()} == {("WHEE",): ["foo"], ("n",): ["1", "2"]}
    empty = roundtrip(spark, spark.range(100).select(), tmp_path / "z")
    assert empty.columns == [] and empty.count() == 100


def test_row_order_is_kept(spark, tmp_path):
    df = spark.range(1000).repartition(5)
    want = [r.id for r in df.collect()]
    back = roundtrip(spark, df, tmp_path / "o", keep_row_id=True)
    assert [r.id for r in back.orderBy(types.ROW_ID).collect()] == want


def test_vectors_factors_row_factors(spark, tmp_path):
    v = spark.createDataFrame([("a", 1.5), ("b", None)], "n string, v double")
    assert rows(roundtrip(spark, store.Vector(v, "v", "n"), tmp_path / "v").select("name", "value")) == [("a", 1.5), ("b", None)]
    f = factors.factor_encode(spark.createDataFrame([("x",), ("zz",), (None,), ("y",)], "value string"), "value", ["y", "x"])
    back = factors.factor_decode(roundtrip(spark, store.Factor(f), tmp_path / "f"), "value")
    assert sorted(map(str, [r.value for r in back.collect()])) == ["None", "None", "x", "y"]
    assert sorted(r.value for r in factors.with_placeholder(f, "value").collect()) == [0, 1, 2, 2]
    data = spark.createDataFrame([(1, "a"), (None, "a"), (1, "a"), (2, None)], "A int, B string")
    levels = factors.row_factor_levels(data, ["A", "B"])
    codes = factors.row_factor_encode(data, ["A", "B"], levels).select("code")
    assert rows(roundtrip(spark, store.RowFactor(codes, levels), tmp_path / "r").select("A", "B")) == rows(data)


def test_existing_path_is_refused_and_broken_objects_do_not_validate(spark, tmp_path):
    df = spark.range(3)
    store.save_object(df, str(tmp_path / "a"))
    with pytest.raises(FileExistsError):
        store.save_object(df, str(tmp_path / "a"))
    levels = spark.createDataFrame([(0, "x"), (1, "x")], "code int, l string")
    with pytest.raises(ValueError, match="repeated"):
        store.save_object(store.RowFactor(levels.select("code"), levels), str(tmp_path / "dup"))
    with pytest.raises(KeyError):
        store.validate_object(spark, str(tmp_path / "a"), {"type": "foobar"})
    Files(spark).write(str(tmp_path / "a" / "OBJECT"), "[1]", replace=True)
    with pytest.raises(ValueError):
        store.read_object(spark, str(tmp_path / "a"))


def test_registries(spark, tmp_path):
    r = registry.Registry("reader")
    r.register("t", int)
    r.register("t", float)
    assert r.get("t") is int
    r.register("t", float, existing="new")
    assert r.get("t") is float
    with pytest.raises(ValueError):
        r.register("t", int, existing="error")
    r.register("lazy", "json:dumps")
    assert r.get("lazy") is json.dumps
    r.register("t", None)
    assert "t" not in r
    rel = registry.Relation()
    assert rel.change("a", "LIST") and not rel.change("a", "LIST") and rel.holds("a", "LIST")
    assert rel.change("a", "LIST", "remove") and not rel.holds("a", "LIST")
    store.save_object(spark.range(7), str(tmp_path / "h"))
    assert validate.height(spark, str(tmp_path / "h")) == 7 and validate.object_dimensions(spark, str(tmp_path / "h")) == [7, 1]
    registry.heights.register("data_frame", lambda *a: 99)
    try:
        assert validate.height(spark, str(tmp_path / "h")) == 99
    finally:
        registry.heights.register("data_frame", None)


def test_overrides_reach_children(spark, tmp_path):
    seen = []
    before = store.alt_save.set(lambda x, path, **o: (seen.append(path), store.save_as(x, path, **o))[1])
    try:
        store.save_object(store.NestedList(lists.rows_of_value(spark, [1, "a"]), {0: spark.range(2)}), str(tmp_path / "l"))
    finally:
        store.alt_save.set(before)
    assert [p.rsplit("/", 1)[-1] for p in seen] == ["l", "0"]


def test_provenance(spark, tmp_path):
    store.save_object(store.NestedList(lists.rows_of_value(spark, {"a": 1}), {0: spark.range(2)}), str(tmp_path / "p"))
    assert json.loads((tmp_path / "p" / provenance.FILE).read_text())["type"] == "pyspark"
    assert not (tmp_path / "p" / "other_contents" / "0" / provenance.FILE).exists()
    was = provenance.use(False)
    try:
        store.save_object(spark.range(2), str(tmp_path / "q"))
    finally:
        provenance.use(was)
    assert not (tmp_path / "q" / provenance.FILE).exists()
    with provenance.loading(Files(spark), str(tmp_path / "p")) as r:
        assert provenance.current() == r
    (tmp_path / "p" / provenance.FILE).write_text("{")
    with pytest.warns(UserWarning), provenance.loading(Files(spark), str(tmp_path / "p")):
        assert provenance.current() is None


def test_listing_and_directories(spark, tmp_path):
    root = str(tmp_path / "t")
    store.save_object(spark.range(3), f"{root}/whee")
    store.save_object(store.NestedList(lists.rows_of_value(spark, {"a": 1}), {0: spark.range(2)}), f"{root}/stuff")
    assert rows(catalog.list_objects(spark, root)) == [("stuff", "simple_list", False), ("whee", "data_frame", False)]
    assert ("stuff/other_contents/0", "data_frame", True) in rows(catalog.list_objects(spark, root, True))
    assert rows(catalog.list_objects(spark, f"{root}/whee", True)) == [(".", "data_frame", False)]
    assert validate.validate_directory(spark, root) == ["stuff", "whee"]
    assert catalog.list_objects(spark, str(tmp_path / "nowhere")).collect() == []


def test_dedup_session(spark):
    df = spark.createDataFrame([(1, None, math.nan), (2, "x", 0.0)], "a int, b string, c double")
    s = catalog.DedupSession()
    assert s.check(df) is None
    s.add(df, "here/./x")
    assert s.check(spark.createDataFrame(df.collect(), df.schema)).endswith("/here/x")
    assert s.check(df.withColumn("a", F.col("a") + 1)) is None
    assert s.check(df.withColumn("a", F.col("a").cast("long"))) is None
    swapped = spark.createDataFrame([("1", None), (None, "1")], "x string, y string")
    assert len({r[0] for r in swapped.select(catalog.row_digest(swapped)).collect()}) == 2
    ordered = [catalog.content_digest(spark.createDataFrame(x, "r int, v string"), "r") for x in ([(0, "a"), (1, "b")], [(0, "b"), (1, "a")])]
    assert ordered[0] != ordered[1]


def test_partial_read_prunes_the_scan(spark, tmp_path, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet").select(F.struct("c_custkey", "c_name", "c_acctbal").alias("cust"), "c_nationkey")
    store.save_object(c, str(tmp_path / "c"))
    plan = store.read_object(spark, str(tmp_path / "c")).where("cust.c_custkey > 5").select("cust.c_custkey")._jdf.queryExecution().toString()
    assert "ReadSchema: struct<cust:struct<c_custkey:bigint>>" in plan and "PushedFilters: [IsNotNull(cust.c_custkey)" in plan


def test_append_stream(spark, tmp_path, sf):
    from cairnframe.streaming.ingest import append_stream

    for k in range(2):
        spark.range(10 * k, 10 * k + 10).write.parquet(str(tmp_path / "in" / f"{k}"))
    stream = spark.readStream.schema("id long").option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    for _ in range(2):
        append_stream(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(60)
    assert sorted(r.id for r in store.read_object(spark, str(tmp_path / "out")).select("id").collect()) == list(range(20))
