import hashlib
import re
from collections import defaultdict

import duckdb

from cairnframe.llm import line_dedup
from tests.llm.helpers import clashing, documents, saved

B = "[\x20\x09-\x0d]+"


def key(line):
    return re.sub("[A-Z]", lambda m: m[0].lower(), re.sub(f"^{B}|{B}$", "", line))


def brute(rows, min_chars=40, min_docs=5):
    holders = defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            if d is not None and len(key(line)) >= min_chars:
                holders[key(line)].add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if d is None or len(holders.get(key(x), ())) < min_docs or max(holders[key(x)]) == d]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def test_against_sql_and_brute_force(spark, sf):
    got = sorted((tuple(r) for r in line_dedup.op10_line_dedup(spark, sf).collect()), key=str)
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert got == brute(rows)
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    assert sorted((tuple(r) for r in con.sql(line_dedup.OP10_SQL).fetchall()), key=str) == got


def test_odd_rows_and_hot_lines(spark, tmp_path):
    hot = "This very line is found in more documents than any other line"
    rows = [(i, f"own {i}\n \t{hot.upper() if i % 2 else hot}\r\nshort\nshort", "en", "s", 1) for i in range(40)]
    rows += [(100, None, None, None, None), (101, "", "en", "s", 1), (None, hot, "en", "s", 1), (3, hot + "\nother text of a repeated id", "en", "s", 1)]
    rows += [(200, hot + "\n" + hot, "en", "s", 1), (201, hot, "en", "s", 1), (202, "\n".join([hot, "x"] * 500), "en", "s", 1)]
    path = saved(clashing(documents(spark, rows)), tmp_path)
    got = sorted((tuple(r) for r in line_dedup.op10_line_dedup(spark, path).collect()), key=str)
    assert got == brute([r[:2] for r in rows])


def test_empty_table_and_bitmaps(spark):
    docs = documents(spark, [])
    assert line_dedup.apply_keep_bitmaps(docs, line_dedup.keep_bitmaps(docs)).collect() == []
    line = "a line that is long enough to be counted as shared"
    docs = documents(spark, [(i, f"a\nb\n{line}\nc", "en", "s", 1) for i in range(5)])
    maps = {r.doc_id: r.keep_runs for r in line_dedup.keep_bitmaps(docs).collect()}
    assert maps == {i: [0, 2, 3, 1] for i in range(4)}
