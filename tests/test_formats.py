import gzip
import json
import math
import os
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cairnframe.functions import datetimes
from cairnframe.operators import lists, rows as rowops, setrules, vls
from cairnframe.sources import files, legacy, strict_csv
from cairnframe.sources.strict_csv import CsvError, parse


@pytest.mark.parametrize(
    "text,types,rows",
    [
        ('"a","b"\n"x",1\nNA,NA\n', ["string", "number"], [["x", 1.0], [None, None]]),
        ('"a"\n"NA"\nNA\n', ["string"], [["NA"], [None]]),
        ('"a","b"\nTrue,1.2e4\nfAlSe,-5\n', ["boolean", "number"], [[True, 12000.0], [False, -5.0]]),
        ('"a"\n1+2i\n-1.5-2.5e1i\n', ["complex"], [[{"re": 1.0, "im": 2.0}], [{"re": -1.5, "im": -25.0}]]),
        ('"a"\n-inf\nInf\n', ["number"], [[-math.inf], [math.inf]]),
        ('"x ""y"",\nz"\n"1\n2"\n', ["string"], [["1\n2"]]),
        ('"a"\nNA\n', ["unknown"], [[None]]),
        ('"a","b"\n', ["unknown", "unknown"], []),
    ],
)
def test_csv_accepts(text, types, rows):
    t = parse(text)
    assert (t.types, t.rows, t.count) == (types, rows, len(rows))


@pytest.mark.parametrize(
    "text",
    ["", '"a"\n1', "a\n1\n", '"a","a"\n1,2\n', '"a"\n+Inf\n', '"a"\n12e3\n', '"a"\n1.\n', '"a"\n1,2\n', '"a","b"\n1\n', '"a"\n"x"y\n', '"a"\n1\n"x"\n', '"a","b"\n1,\n', '"a"\nna\n', '"a"\nNAN1\n', '"a"\ntruex\n', '"a\n'],
)
def test_csv_refuses(text):
    with pytest.raises(CsvError):
        parse(text)


def test_csv_blank_lines_and_subsets():
    assert (parse("\n" * 11).count, parse("\n" * 11).names) == (10, [])
    t = parse('"a","b"\n1,"x"\n', keep=["b"])
    assert (t.names, t.types, t.rows) == (["b"], ["string"], [["x"]])
    assert parse('"a"\n1\n2\n', store=False).rows == []


def test_csv_roundtrip(spark, tmp_path):
    df = spark.createDataFrame(
        [("NA", 1.5, True, (1.0, -2.0)), (None, None, None, None), ('q"\n,', math.nan, False, (0.0, 1e300)), ("", -math.inf, True, (math.pi, 1.0))],
        "`a b` string, x double, t boolean, z struct<re:double,im:double>",
    )
    for zipped in (False, True):
        path = str(tmp_path / f"c{zipped}")
        strict_csv.write_strict_csv(df, path, gzipped=zipped)
        back = strict_csv.read_strict_csv(spark, path)
        assert sorted(map(repr, back.collect())) == sorted(map(repr, df.collect()))
    with pytest.raises(ValueError):
        strict_csv.read_strict_csv(spark, path, expected_rows=3)
    with pytest.raises(ValueError):
        strict_csv.read_strict_csv(spark, path, "a string")
    assert strict_csv.read_strict_csv(spark, path, columns=["x"]).columns == ["x"]
    named = str(tmp_path / "named")
    strict_csv.write_strict_csv(df.select("a b", "x").where("`a b` is not null"), named, row_names="a b", single=True)
    assert strict_csv.read_strict_csv(spark, named, "v double", row_names=True).columns == ["__row_name", "v"]
    zero = str(tmp_path / "zero")
    strict_csv.write_strict_csv(spark.range(10).select(), zero, single=True)
    assert strict_csv.read_strict_csv(spark, zero).count() == 10


def test_csv_violations(spark, tmp_path):
    (tmp_path / "v").mkdir()
    (tmp_path / "v" / "good.csv").write_text('"a"\n1\n')
    (tmp_path / "v" / "bad.csv.gz").write_bytes(gzip.compress(b'"a"\n1\n"x"\n'))
    (r,) = strict_csv.csv_violations(spark, str(tmp_path / "v")).collect()
    assert r.path.endswith("bad.csv.gz") and (r.line, r.column) == (3, 1)


TREES = [
    {"A": [1, 2], "B": [1.5, None], "C": ["x", None], "D": True, "E": None, "F": {"G": [], "H": [[1], ["a", 2]]}},
    [math.inf, -math.inf, math.nan, 1.2, None],
    {"scalar": 1, "boxed": [1]},
    None,
    [],
]


@pytest.mark.parametrize("value", TREES)
def test_list_roundtrip(value):
    tree = lists.typed(value)
    rows = [{n: r.get(n) for n, _ in lists._FIELDS} for r in lists.flatten(json.loads(json.dumps(tree)))]
    again = lists.unflatten(rows)
    rows2 = [{n: r.get(n) for n, _ in lists._FIELDS} for r in lists.flatten(again)]
    assert rows == rows2
    assert json.dumps(again, sort_keys=True) == json.dumps(json.loads(json.dumps(tree)), sort_keys=True)


def test_list_factors_formats_and_errors(spark):
    doc = {"type": "list", "names": ["f", "d", "o"], "values": [{"type": "factor", "levels": ["a", "b"], "values": [1, None, 0], "names": ["x", "y", "z"]}, {"type": "date", "values": "2020-01-01"}, {"type": "ordered", "levels": ["q"], "values": [0]}]}
    df = lists.list_to_rows(spark.createDataFrame([("k", json.dumps(doc))], "object string, json string"))
    got = {r.path[-1]: r for r in df.where("size(path) > 0").collect()}
    assert got["f"]["values"] == ["1", None, "0"] and got["f"].levels == ["a", "b"] and got["f"].names == ["x", "y", "z"]
    assert got["d"].format == "date" and got["d"].boxed is False and got["o"].ordered is True
    back = json.loads(lists.rows_to_list(df).first().json)
    assert back["values"][0]["values"] == [1, None, 0]
    for bad in ({"type": "what"}, {"type": "integer", "values": ["x"]}, {"type": "factor", "levels": [], "values": [0]}, {"type": "list", "values": [{"type": "nothing"}], "names": []}, {"values": 1}):
        with pytest.raises(lists.ListError):
            list(lists.flatten(bad))
    names = lists.name_violations(lists.list_to_rows(spark.createDataFrame([("k", json.dumps({"type": "integer", "values": [1, 2, 3], "names": ["a", "a", ""]}))], "object string, json string")))
    assert sorted((r.name, r.n) for r in names.collect()) == [("", 1), ("a", 2)]


def test_rfc3339(spark):
    good = ["2023-12-04T14:41:19+01:00", "2023-12-04T14:41:19.21323+01:00", "2023-12-04T14:41:19Z", "2022-01-02T02:03:05.22Z"]
    bad = ["blah", "2023-02-30T00:00:00Z", "2023-12-04 14:41:19Z", "2023-12-04T24:00:00Z", "2023-12-04T14:41:19", "2023-12-04T14:41:19Z\n", "1"]
    df = spark.createDataFrame([(s,) for s in [*good, *bad, None]], "s string")
    marked = datetimes.mark_rfc3339(df, "s")
    assert sorted(r.s for r in marked.collect() if r.s) == sorted(good)
    assert datetimes.is_rfc3339(marked, "s") and not datetimes.is_rfc3339(df, "s")
    at = {r.s: r.t for r in df.select("s", F.date_format(datetimes.to_timestamp(F.col("s")), "HH:mm:ss.SSS").alias("t")).collect()}
    assert at[good[1]] == "13:41:19.000" and at[bad[0]] is None
    assert spark.range(3).select(datetimes.as_rfc3339(F.col("id")).alias("x")).where("x is not null").count() == 0
    stamped = spark.range(1).select(datetimes.from_timestamp(F.lit("2020-01-01 00:00:00").cast("timestamp")).alias("s"))
    assert stamped.first().s == "2020-01-01T00:00:00+00:00"
    assert datetimes.combine([df, stamped], "s").where("s is not null").count() == 5


def test_vls(spark):
    words = ["", "a", "bé", "NA", "x" * 500, "漢字", "cut\0here", None]
    df = spark.createDataFrame(list(enumerate(words)), "i long, s string")
    got = vls.read(vls.pointers(df, "i", "s", 3).drop("s"), vls.heaps(df, "i", "s", 3), placeholder="NA")
    assert [r.value for r in got.orderBy("i").collect()] == ["", "a", "bé", None, "x" * 500, "漢字", "cut", ""]
    assert df.agg(vls.use_vls(F.col("s"))).first()[0] is True
    assert df.where("length(s) < 3").agg(vls.use_vls(F.col("s"))).first()[0] is False
    assert df.where("false").agg(vls.use_vls(F.col("s"))).first()[0] is False


def test_dense_index(spark):
    df = spark.range(500).repartition(7).withColumn("k", F.col("id") * 7919 % 500)
    got = rowops.dense_index(df, "n", "k").collect()
    assert all(r.k == r.n for r in got) and len(got) == 500
    assert sorted(r.n for r in rowops.dense_index(df, "n").collect()) == list(range(500))
    assert rowops.dense_index(df.where("false"), "n", "k").collect() == []


def test_rules_name_each_corruption(spark):
    meta = spark.createDataFrame(
        [
            ("a/f.csv", "a/f.csv.json", False, ["a/c/g.csv"]),
            ("a/c/g.csv", "a/c/g.csv.json", True, []),
            ("b/f.csv", "b/other.json", False, ["a/c/g.csv", "b/x/lost.csv", "a/f.csv"]),
            ("a/b/f.csv", "a/b/f.csv.json", False, []),
            ("d/h.csv", "d/h.csv.json", True, []),
        ],
        "path string, file string, is_child boolean, children array<string>",
    )
    present = spark.createDataFrame([("a/f.csv",), ("a/c/g.csv",), ("b/f.csv",), ("d/h.csv",), ("stray.txt",), ("old",)], "path string")
    redirects = spark.createDataFrame([("alias", "nowhere"), ("old", "a/f.csv")], "path string, target string")
    got = {(r.rule, r.path) for r in setrules.all_violations(meta, present, redirects).collect()}
    assert got == {
        ("missing_path", "a/b/f.csv"), ("unexpected_path", "b/f.csv"), ("stray_child", "a/c/g.csv"), ("stray_child", "a/f.csv"),
        ("conflict", "a/f.csv"), ("duplicate_reference", "a/c/g.csv"), ("missing_child", "b/x/lost.csv"), ("missing_child", "a/f.csv"),
        ("unreferenced_child", "d/h.csv"), ("unknown_file", "stray.txt"), ("unknown_file", "old"), ("nested", "a/b"),
        ("dangling_redirect", "nowhere"), ("shadowing_redirect", "old"),
    }


def test_clone_and_paths(tmp_path):
    src = tmp_path / "src"
    (src / "x" / "y").mkdir(parents=True)
    for p in ("a", "x/b", "x/y/c"):
        (src / p).write_text(p)
    for action in ("link", "copy", "symlink", "relsymlink"):
        to = tmp_path / action
        files.clone_directory(str(src), str(to), action)
        assert [(to / p).read_text() for p in ("a", "x/b", "x/y/c")] == ["a", "x/b", "x/y/c"]
        assert (to / "a").is_symlink() == action.endswith("symlink")
    assert os.stat(tmp_path / "link" / "a").st_ino == os.stat(src / "a").st_ino
    assert not os.readlink(tmp_path / "relsymlink" / "x" / "b").startswith("/")
    with pytest.raises(FileExistsError):
        files.clone_directory(str(src), str(tmp_path / "copy"))
    assert files.absolutize("a/./b/../c", "/r") == "/r/a/c" and files.absolutize("/x//y") == "/x/y"
    assert files.absolutize("~").startswith("/")


def test_legacy_tree(spark, tmp_path):
    root = str(tmp_path / "root")
    df = spark.createDataFrame([("x", 1, 1.5), (None, None, math.nan)], "s string, i int, d double")
    legacy.quick_stage(df, root, "whee")
    assert sorted(map(repr, legacy.quick_load(spark, root, "whee").collect())) == sorted(map(repr, df.collect()))
    legacy.write_metadata(spark, legacy.stage_object(df, root, "foo/bar"), root)
    legacy.write_metadata(spark, legacy.create_redirection(spark, root, "alias", "foo/bar/simple.csv.gz"), root)
    legacy.check_directory(spark, root, attempt_load=True)
    with pytest.raises(FileExistsError):
        legacy.stage_object(df, root, "whee")
    with pytest.raises(ValueError):
        legacy.stage_object(df, root, "foo\\bar")
    assert set(legacy.load_directory(spark, root)) == {"whee", "alias"}
    assert set(legacy.load_directory(spark, root, "to")) == {"whee/simple.csv.gz", "foo/bar/simple.csv.gz"}
    assert len(legacy.load_directory(spark, root, "both")) == 4
    legacy.move_object(spark, root, "foo/bar/simple.csv.gz", "moved")
    assert legacy.acquire_metadata(spark, root, "alias")["path"] == "moved/simple.csv.gz"
    legacy.check_directory(spark, root)
    legacy.remove_object(spark, root, "moved/simple.csv.gz")
    assert set(legacy.list_directory(spark, root)) == {"whee", "whee/simple.csv.gz"}
    (tmp_path / "root" / "junk").write_text("x")
    with pytest.raises(ValueError, match="unknown_file"):
        legacy.check_directory(spark, root)
    assert legacy.strip_nulls({"a": None, "b": [{"c": None, "d": 1}]}) == {"b": [{"d": 1}]}
    assert legacy.resources({"x": [{"resource": {"path": "p"}}], "resource_": {"y": {"resource": {"path": "q"}}}}) == ["p", "q"]


def test_csv_in_pieces():
    text = '"a","b,""\n"\n"x ""y""\n",1\nNA,NA\n"""",NaN\n"z",-1.5e3\n'
    whole = parse(text)
    for size in range(1, len(text) + 1):
        p = strict_csv.Parser()
        columns = [p.feed(text[i : i + size]) for i in range(0, len(text), size)] + [p.feed("", last=True)]
        rows = [list(r) for c in columns for r in zip(*c)]
        assert (p.names, p.types, p.count, repr(rows)) == (whole.names, whole.types, whole.count, repr(whole.rows))
    # the same errors at the same places, also where a quote is never closed
    for bad in (text + '"x\n', text + "1", text + '1,"q"\n', text[:-1] + ",2\n", text + "NA,NA,NA\n", text + '"x"y,1\n', text + '"x\n\n"",1\n' + text):
        with pytest.raises(CsvError) as want:
            parse(bad)
        for size in (1, 3, 10):
            p = strict_csv.Parser(store=False)
            with pytest.raises(CsvError) as got:
                for i in range(0, len(bad), size):
                    p.feed(bad[i : i + size])
                p.feed("", last=True)
            assert str(got.value) == str(want.value)


def test_csv_parser_holds_a_piece():
    """Memory goes by the piece, whatever the file's length, and by one record behind an open quote."""
    piece = "".join(f'"text {i % 50}",{i}\n' for i in range(2000))

    def peak(n):
        p = strict_csv.Parser()
        p.feed('"a","b"\n')
        tracemalloc.start()
        try:
            for _ in range(n):
                p.feed(piece)
            p.feed("", last=True)
            return p.count, tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()

    (few, small), (many, large) = peak(5), peak(50)
    assert (few, many) == (10_000, 100_000) and large < 1.5 * small


def test_csv_files_as_they_lie(spark, tmp_path):
    """Zipped by content whatever the name, several members, marks, ends of lines; several endings, or none, and splits."""
    plain = '"a","b"\n' + "".join(f'"line\n{i} é",{i}\n' for i in range(20_000))
    half = len(plain.encode()) // 2
    zipped = gzip.compress(plain.encode()[:half]) + gzip.compress(plain.encode()[half:]) + b"\0" * 8
    want = [(f"line\n{i} é", float(i)) for i in range(20_000)]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10k")
    try:
        for name, content in (("x.csv", plain.encode()), ("x", plain.encode()), ("a b%20.gz", zipped), ("x.gz", plain.encode()), ("x.csv", zipped), ("x", zipped), ("x.bz2", plain.encode())):
            folder = tmp_path / f"{name}-{len(content)}"
            folder.mkdir()
            (folder / name).write_bytes(content)
            for at in (folder, folder / name if "%" not in name else folder):
                assert [tuple(r) for r in strict_csv.read_strict_csv(spark, str(at)).collect()] == want
            (folder / "other.gz2").write_bytes(plain.encode())
            back = strict_csv.read_strict_csv(spark, str(folder))
            assert sorted(map(tuple, back.collect())) == sorted(want + want)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    bad = {"em pty.gz": (gzip.compress(b""), 1), "open.csv": (b'"a"\n1', 2), "open.gz": (gzip.compress(b'"a"\n1'), 2), "mark.csv": (b'\xef\xbb\xbf"a"\n1\nx\n', 1), "mark": (b'\xef\xbb\xbf"a"\n1', 1)}
    good = {"good.csv": b'"a"\n1\n', "blank.csv": b"\n\n\n", "good": b'"a"\n'}
    for together in (True, False):
        for name, (content, line) in bad.items():
            folder = tmp_path / f"bad-{together}-{name}"
            folder.mkdir()
            (folder / name).write_bytes(content)
            for other, text in good.items() if together else ():
                (folder / other).write_bytes(text)
            assert [(r.path, r.line) for r in strict_csv.csv_violations(spark, str(folder)).collect()] == [(f"file:{folder}/{name}", line)]
    (tmp_path / "cut").mkdir()
    (tmp_path / "cut" / "x.gz").write_bytes(zipped[:200])
    with pytest.raises(Exception, match="EOFError"):
        strict_csv.read_strict_csv(spark, str(tmp_path / "cut"))


def test_csv_worker_memory(spark, tmp_path):
    """A Python worker keeps no file: one of 39 MB that zips to little takes less than 20 MB more than one of a row."""
    header, row = '"a","b"\n', '"' + "x" * 60 + '",1\n'

    def peak(name, n):
        (tmp_path / name).write_bytes(gzip.compress((header + row * n).encode()))

        def run(batches):
            tracemalloc.start()
            count = 0
            for _, raw in files.raw_streams(batches):
                p = strict_csv.Parser()
                for columns in strict_csv._parsed(raw, p):
                    count += len(columns[0]) if columns else 0
            top = tracemalloc.get_traced_memory()[1]
            tracemalloc.stop()
            yield pa.RecordBatch.from_arrays([pa.array([count]), pa.array([top])], names=["n", "top"])

        return tuple(files.raw_lines(spark, str(tmp_path / name)).mapInArrow(run, "n long, top long").first())

    (one, low), (many, high) = peak("one.gz", 1), peak("many.gz", 600_000)
    assert (one, many) == (1, 600_000) and high < low + 20e6
