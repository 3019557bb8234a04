"""Strict CSV: every cell's type shows in its first character, and nothing is guessed.

Header cells and strings are quoted; missing is a bare ``NA``; numbers, booleans
and complex numbers are bare.  A file is read by one task (a quoted cell may hold
line ends, so a file cannot be split), which holds a piece of it at a time; the
writer makes one file per partition.  Validation uses the same tokenizer and
returns the first error of each file as a row instead of raising.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairnframe.functions.types import ROW_ID, check_names
from cairnframe.sources.files import ByteOrderMark, RawStream, raw_lines, raw_streams

UNKNOWN = "unknown"
_NUMBER = r"[+-]?(?:[1-9](?:\.\d+)?[eE][+-]?\d+|\d+(?:\.\d+)?(?![eE\d]))"
_CELL = re.compile(
    rf'(?P<string>"[^"]*(?:""[^"]*)*")|(?P<na>NA(?![A-Za-z]))|(?P<nan>-?[nN][aA][nN])|(?P<inf>-?[iI][nN][fF])'
    rf"|(?P<boolean>[tT][rR][uU][eE]|[fF][aA][lL][sS][eE])|(?P<complex>{_NUMBER}[+-](?:[1-9](?:\.\d+)?[eE][+-]?\d+|\d+(?:\.\d+)?)i)|(?P<number>{_NUMBER})"
)
_COMPLEX = re.compile(rf"({_NUMBER.replace('(?![eE\\d])', '')})([+-].*)i")


class CsvError(ValueError):
    def __init__(self, line: int, column: int, message: str):
        super().__init__(f"line {line}, column {column}: {message}")
        self.line, self.column, self.message = line, column, message


def _unquote(cell: str) -> str:
    return cell[1:-1].replace('""', '"')


#: Cells of a column whose type is known, for rows that are matched at once.
_CELLS = {
    "string": r'"[^"]*+(?:""[^"]*+)*+"|NA',
    "number": rf"{_NUMBER}|-?[nN][aA][nN]|-?[iI][nN][fF]|NA",
    "boolean": "[tT][rR][uU][eE]|[fF][aA][lL][sS][eE]|NA",
    "complex": rf"{_NUMBER}[+-](?:[1-9](?:\.\d+)?[eE][+-]?\d+|\d+(?:\.\d+)?)i|NA",
    UNKNOWN: "NA",
}


class Table:
    """Names, types and cells of one parsed file."""

    def __init__(self, names: list[str], types: list[str], rows: list[list], count: int):
        self.names, self.types, self.rows, self.count = names, types, rows, count


class Parser:
    """Parses one file given in pieces, and holds no more of it than a piece and the record that goes on behind it.

    ``keep`` stores those columns only, ``store=False`` none (checking goes on).
    """

    def __init__(self, keep: list[str] | None = None, store: bool = True):
        self.names: list[str] | None = None
        self.types: list[str] = []
        self.count = 0
        self.wanted: list[int] = []
        self._keep, self._store, self._line = keep, store, 1
        self._parts: list[str] = []
        self._held = self._enough = 0
        self._row, self._row_types = None, None

    def feed(self, text: str, last: bool = False) -> list[list]:
        """The wanted columns of the records that end in what was given so far."""
        self._parts.append(text)
        self._held += len(text)
        if self._held < self._enough and not last:
            return [[] for _ in self.wanted]
        text = "".join(self._parts)
        if last and self.names is None and not text:
            raise CsvError(1, 1, "the file is empty")
        if self.names == [] or self.names is None and text.startswith("\n"):
            if text.strip("\n"):
                raise CsvError(1, 1, "empty cell")
            self.count += len(text) - (self.names is None)
            self.names, at, columns = [], len(text), []
        else:
            # no cell but a string goes on behind a line end
            at, columns = self._records(text, len(text) if last else text.rfind("\n") + 1, last)
        self._parts, self._held = [text[at:]], len(text) - at
        # a record longer than a piece is tried again at twice its length
        self._enough = 2 * self._held
        return columns

    def _records(self, text: str, end: int, last: bool) -> tuple[int, list[list]]:
        """(where the records end, wanted columns)"""
        at, columns = 0, [[] for _ in self.wanted]
        if self.names is not None and self._row_types != self.types:
            self._row, self._row_types = re.compile(",".join(f"({_CELLS[t]})" for t in self.types) + "\n"), list(self.types)
        while at < end:
            if self._row is not None:
                start, found = at, []
                while m := self._row.match(text, at, end):
                    found.append(m.groups())
                    at = m.end()
                if found:
                    self.count += len(found)
                    self._line += text.count("\n", start, at)
                    if self._store:
                        cells = list(zip(*found))
                        for column, i in zip(columns, self.wanted):
                            column += _values(self._row_types[i], cells[i])
                    continue
            record = self._record(text, at, end, last)
            if record is None:
                break
            at, cells = record
            if cells is None:
                columns = [[] for _ in self.wanted]
            elif self._store:
                for column, i in zip(columns, self.wanted):
                    column.append(cells[i])
        return at, columns

    def _record(self, text: str, at: int, end: int, last: bool) -> tuple[int, list | None] | None:
        """(where it ends, cells; none for the header), or nothing if it goes on behind what is there."""
        width, line, cells, column = None if self.names is None else len(self.names), self._line, [], 0
        while True:
            column += 1
            if width is not None and column > width:
                raise CsvError(line, column, f"more than {width} cells")
            m = _CELL.match(text, at, end)
            if not m:
                if not last and text[at] == '"':
                    return None
                raise CsvError(line, column, "empty cell" if at >= end or text[at] in ",\n" else f"no cell starts with {text[at]!r} here")
            kind, raw = m.lastgroup, m[0]
            at = m.end()
            if not last and kind == "string" and text[at] == '"':
                return None
            start_line = line
            if kind == "string":
                line += raw.count("\n")
            if width is None:
                if kind != "string":
                    raise CsvError(start_line, column, "header cells are quoted")
                cells.append(_unquote(raw))
            else:
                cells.append(_typed(kind, raw, self.types, column, start_line))
            if at >= end:
                raise CsvError(line, column, "the last line has no end")
            behind = text[at]
            at += 1
            if behind == "\n":
                break
            if behind != ",":
                raise CsvError(line, column, f"{behind!r} behind a cell")
        if width is None:
            if len(set(cells)) < len(cells):
                raise CsvError(1, 1, "header names repeat")
            self.names, self.types = cells, [UNKNOWN] * len(cells)
            self.wanted = [i for i, c in enumerate(cells) if self._keep is None or c in self._keep]
            cells = None
        elif len(cells) != width:
            raise CsvError(line, len(cells), f"{len(cells)} cells instead of {width}")
        else:
            self.count += 1
        self._line = line + 1
        return at, cells


def parse(text: str, keep: list[str] | None = None, store: bool = True) -> Table:
    """Parses one file; ``keep`` stores those columns only, ``store=False`` none (checking goes on)."""
    p = Parser(keep, store)
    columns = p.feed(text, last=True)
    if not (store and p.names):
        rows = []
    else:
        rows = [list(r) for r in zip(*columns)] if columns else [[] for _ in range(p.count)]
    return Table([p.names[i] for i in p.wanted], [p.types[i] for i in p.wanted], rows, p.count)


def _values(kind: str, cells: tuple[str, ...]) -> list:
    """``_typed`` for cells that are known to be of the kind, or missing."""
    if kind == "string":
        return [None if c == "NA" else _unquote(c) for c in cells]
    if kind == "number":
        return [None if c == "NA" else math.nan if c[-1] in "nN" else float(c) for c in cells]
    return [None if c == "NA" else _typed(kind, c, [kind], 1, 0) for c in cells]


def _typed(kind: str, raw: str, types: list[str], column: int, line: int):
    if kind == "na":
        return None
    kind = "number" if kind in ("nan", "inf") else kind
    have = types[column - 1]
    if have == UNKNOWN:
        types[column - 1] = kind
    elif have != kind:
        raise CsvError(line, column, f"{kind} in a column of {have}")
    if kind == "string":
        return _unquote(raw)
    if kind == "boolean":
        return raw.lower() == "true"
    if kind == "complex":
        m = _COMPLEX.fullmatch(raw)
        return {"re": float(m[1]), "im": float(m[2])}
    low = raw.lower()
    return math.nan if low.endswith("nan") else float(raw)


def _parsed(raw: RawStream, parser: Parser) -> Iterator[list[list]]:
    """The wanted columns of one file, piece by piece."""
    try:
        try:
            for text in raw.texts():
                yield parser.feed(text)
            yield parser.feed("", last=True)
        except CsvError:
            raw.drain()  # at the end a mark may turn out, which comes before any other error
            raise
    except ByteOrderMark:
        raise CsvError(1, 1, "no cell starts with '\\ufeff' here") from None


def _checked(raw: RawStream) -> Parser:
    parser = Parser(store=False)
    for _ in _parsed(raw, parser):
        pass
    return parser


def column_types(spark: SparkSession, path: str) -> DataFrame:
    """(position, name, type) over all files of a path; ``unknown`` where every cell is missing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, raw in raw_streams(batches):
            t = _checked(raw)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(t.names)), pa.int32()), pa.array(t.names, pa.string()), pa.array(t.types, pa.string())], names=["position", "name", "type"])

    found = raw_lines(spark, path).mapInArrow(run, "position int, name string, type string")
    known = F.collect_set(F.when(F.col("type") != UNKNOWN, F.col("type")))
    return found.groupBy("position", "name").agg(F.when(F.size(known) > 1, F.lit("mixed")).otherwise(F.coalesce(F.get(known, F.lit(0)), F.lit(UNKNOWN))).alias("type"))


_SPARK = {"string": T.StringType(), "number": T.DoubleType(), "boolean": T.BooleanType(), UNKNOWN: T.BooleanType(), "complex": T.StructType([T.StructField("re", T.DoubleType()), T.StructField("im", T.DoubleType())])}


def read_strict_csv(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, row_names: bool = False, expected_rows: int | None = None, columns: list[str] | None = None
) -> DataFrame:
    """Lazy table of one file or of a folder of them.

    With ``schema`` columns are taken by position, checked for their number, cast (a value that does
    not fit is an error) and renamed; without it one pass finds the types.  ``row_names``: the first
    column holds row names.  ``expected_rows`` counts, and refuses more or fewer records.
    """
    from pyspark.sql.types import _parse_datatype_string

    if isinstance(schema, str):
        schema = _parse_datatype_string(schema)
    found = column_types(spark, path).orderBy("position").collect()
    names = [r["name"] for r in found]
    if any(r["type"] == "mixed" for r in found):
        raise ValueError("files disagree about a column's type")
    raw = T.StructType([T.StructField(r["name"], _SPARK[r["type"]]) for r in found])
    if schema is not None and len(schema) != len(names) - row_names:
        raise ValueError(f"expected {len(schema)} columns, not {len(names) - row_names}")
    if not names:

        def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, raw in raw_streams(batches):
                yield pa.RecordBatch.from_arrays([pa.array([_checked(raw).count], pa.int64())], names=["n"])

        return spark.range(raw_lines(spark, path).mapInArrow(lines, "n long").agg(F.sum("n")).first()[0] or 0).select()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(raw)
        for _, stream in raw_streams(batches):
            t = Parser()
            for columns in _parsed(stream, t):
                if t.names is not None and t.names != names:
                    raise ValueError(f"header {t.names} instead of {names}")
                for i in range(0, len(columns[0]) if columns else 0, 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 10_000], arrow.field(k).type) for k, c in enumerate(columns)], schema=arrow)

    df = raw_lines(spark, path).mapInArrow(run, raw)
    if expected_rows is not None and (n := df.count()) != expected_rows:
        raise ValueError(f"expected {expected_rows} records, found {n}")
    if columns is not None:
        df = df.select(*[f"`{c}`" for c in columns])
    if schema is None:
        return df.withColumnRenamed(names[0], "__row_name") if row_names else df
    out = [F.col(f"`{names[0]}`").alias("__row_name")] if row_names else []
    for f, name in zip(schema.fields, names[row_names:], strict=True):
        c = F.col(f"`{name}`")
        out.append((c if raw[name].dataType == f.dataType else c.cast("string") if isinstance(f.dataType, T.StringType) else c.cast(f.dataType)).alias(f.name, metadata=f.metadata))
    return df.select(*out)


def coercion_violations(df: DataFrame, column: str, kind: str) -> DataFrame:
    """Rows whose value would become missing by the cast."""
    c = F.col(f"`{column}`")
    return df.where(c.isNotNull() & c.try_cast(kind).isNull())


def csv_violations(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, column, message): the first error of each file that has one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, raw in raw_streams(batches):
            try:
                _checked(raw)
            except CsvError as e:
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([e.line], pa.int32()), pa.array([e.column], pa.int32()), pa.array([e.message])], names=["path", "line", "column", "message"])

    return raw_lines(spark, path).mapInArrow(run, "path string, line int, column int, message string")


def _quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))


def _number(c: Column) -> Column:
    text = c.cast("string")
    return F.when(F.isnan(c), F.lit("NaN")).when(c == math.inf, F.lit("Inf")).when(c == -math.inf, F.lit("-Inf")).otherwise(F.replace(text, F.lit("E"), F.lit("e")))


def cell(c: Column, kind: T.DataType) -> Column:
    """The text of one cell, made by Spark expressions."""
    if isinstance(kind, T.StructType) and kind.names == ["re", "im"]:
        im = c["im"]
        text = F.concat(_number(c["re"]), F.when((im < 0) | F.startswith(im.cast("string"), F.lit("-")), F.lit("")).otherwise(F.lit("+")), _number(im), F.lit("i"))
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        text = _number(c.cast("double"))
    elif isinstance(kind, (T.IntegralType, T.BooleanType, T.DecimalType)):
        text = c.cast("string")
    elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType, T.BinaryType)):
        raise TypeError(f"a column of {kind.simpleString()} cannot be written as CSV")
    else:
        text = _quoted(c.cast("string"))
    return F.coalesce(text, F.lit("NA"))


def write_strict_csv(df: DataFrame, path: str, gzipped: bool = False, single: bool = False, row_names: str | None = None, validate: bool = True) -> None:
    """Writes a folder of strict CSV files, one per partition (``single``: one in all)."""
    df = df.drop(ROW_ID)
    if row_names:
        df = df.select(F.col(f"`{row_names}`").cast("string"), *[F.col(f"`{c}`") for c in df.columns if c != row_names])
    check_names(df.columns)
    if df.columns:
        line = F.concat_ws(",", *[cell(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields])
        header = ",".join('"' + c.replace('"', '""') + '"' for c in df.columns)
        lines = df.select(line.alias("value"))
    else:
        header, lines = "", df.select(F.lit("").alias("value"))
    if single:
        lines = lines.coalesce(1)

    def head(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([header])], names=["value"])
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0)], names=["value"])

    out = lines.mapInArrow(head, "value string")
    out.write.option("compression", "gzip" if gzipped else "none").text(path)
    if validate and (bad := csv_violations(df.sparkSession, path).take(1)):
        raise ValueError(f"{bad[0]['path']}: {bad[0]['message']}")
