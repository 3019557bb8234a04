"""Files on any Hadoop file system, cloning of directories, lexical paths."""

from __future__ import annotations

import codecs
import gzip
import io
import itertools
import os
import posixpath
import re
import shutil
from collections.abc import Iterator
from functools import reduce
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a file that are unzipped and decoded at once.
PIECE = 1 << 18


class Files:
    """Small driver-side reads and writes through Spark's own file systems."""

    def __init__(self, spark: SparkSession):
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self._conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def is_dir(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p) and fs.getFileStatus(p).isDirectory()

    def make(self, path: str) -> None:
        fs, p = self._at(path)
        fs.mkdirs(p)

    def write(self, path: str, text: str, replace: bool = False) -> None:
        fs, p = self._at(path)
        out = fs.create(p, replace)
        out.write(text.encode())
        out.close()

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def rename(self, old: str, new: str) -> None:
        fs, p = self._at(old)
        if not fs.rename(p, self._jvm.org.apache.hadoop.fs.Path(new)):
            raise OSError(f"cannot rename '{old}' to '{new}'")

    def names(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def walk(self, root: str) -> list[str]:
        """Relative paths of all files, hidden ones and checksums left out."""
        fs, p = self._at(root)
        base = fs.makeQualified(p).toString().rstrip("/") + "/"
        found, it = [], fs.listFiles(p, True)
        while it.hasNext():
            q = it.next().getPath().toString()
            name = q.rsplit("/", 1)[1]
            if not name.startswith("."):
                found.append(q[len(base) :])
        return sorted(found)


def raw_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, line): the bytes of each file as it lies there, cut at line ends; ``raw_streams`` puts them together again.

    Spark's text reader streams them, so nobody holds a file.  A codec that passes bytes through keeps
    files from being unzipped and split; it goes by one ending of names, so files of each ending that
    some codec knows are read by themselves, and all files where they share one.  Others may be split,
    and are brought together and put in order by a shuffle.  Spark leaves out files of no bytes.
    """
    found = spark.read.format("binaryFile").load(path)
    endings = {posixpath.splitext(name)[1] for name in found.inputFiles()}
    jvm = spark._jvm.org.apache.hadoop
    codecs_by_name = jvm.io.compress.CompressionCodecFactory(spark._jsc.hadoopConfiguration())
    whole = {e for e in endings if re.fullmatch(r"\.\w+", e, re.ASCII) and (len(endings) == 1 or codecs_by_name.getCodec(jvm.fs.Path("x" + e)))}
    line = (F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"), F.col("value").cast("binary").alias("line"))
    parts = []
    for ending in sorted(whole):
        reader = spark.read.option("lineSep", "\n").option("pathGlobFilter", f"*{ending}").option("io.compression.codecs", "org.apache.hadoop.io.compress.PassthroughCodec")
        # Hadoop's shaded client knows the option by the second name
        for name in ("io.compress.passthrough.extension", "org.apache.hadoop.shaded.io.compress.passthrough.extension"):
            reader = reader.option(name, ending)
        parts.append(reader.text(path).select(*line))
    if endings - whole or not endings:
        placed = spark.read.option("lineSep", "\n").text(path)
        for ending in sorted(whole):
            placed = placed.where(~F.endswith("_metadata.file_name", F.lit(ending)))
        placed = placed.select(*line, F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
        parts.append(placed.repartition("path").sortWithinPartitions("path", "block", "at").drop("block", "at"))
    return reduce(DataFrame.union, parts)


class ByteOrderMark(ValueError):
    """A file begins with one; Spark's reader drops it."""


class RawStream(io.RawIOBase):
    """The bytes of one file, given in pieces."""

    def __init__(self, pieces: Iterator[bytes], size: int):
        self._pieces, self._size, self._seen, self._piece = pieces, size, 0, memoryview(b"")

    def readable(self) -> bool:
        return True

    def readinto(self, b) -> int:
        while not self._piece:
            piece = next(self._pieces, None)
            if piece is None:
                if self._size - self._seen in (2, 3):
                    raise ByteOrderMark
                if self._seen not in (self._size, self._size + 1):
                    raise OSError(f"{self._seen} bytes of a file of {self._size}")
                return 0
            # each line came with an end, the last one of the file may have none
            self._piece = memoryview(piece)[: self._size - self._seen]
            self._seen += len(piece)
            if self._seen > self._size + 1:
                raise OSError(f"more than the {self._size} bytes of a file")
        n = min(len(b), len(self._piece))
        b[:n] = self._piece[:n]
        self._piece = self._piece[n:]
        return n

    def drain(self) -> None:
        """Reads on to the end, where the size is checked."""
        b = bytearray(PIECE)
        while self.readinto(b):
            pass

    def texts(self) -> Iterator[str]:
        """The text in pieces, unzipped where it is zipped."""
        source = io.BufferedReader(self, PIECE)
        if source.peek(2)[:2] == b"\x1f\x8b":
            source = gzip.GzipFile(fileobj=source)
        decode = codecs.getincrementaldecoder("utf-8")().decode
        while data := source.read(PIECE):
            yield decode(data)
        decode(b"", True)


def raw_streams(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, RawStream]]:
    """(path, stream) of each file of a task of ``raw_lines``; to be read in turn."""

    def pieces() -> Iterator[tuple[str, int, bytes]]:
        for batch in batches:
            at, runs = 0, pc.run_end_encode(batch.column(0))
            for path, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist()):
                size = batch.column(1)[at].as_py()
                yield path, size, b"\n".join([*batch.column(2).slice(at, end - at).to_pylist(), b""])
                at = end

    for (path, size), found in itertools.groupby(pieces(), key=lambda p: p[:2]):
        # from the reader's URI to a path as Spark lists it
        yield re.sub("^file:///", "file:/", unquote(path)), RawStream((p[2] for p in found), size)


def absolutize(path: str, base: str | None = None) -> str:
    """Lexically absolute path: ``~``, ``.`` and ``..`` resolved, no look at the disk."""
    full = posixpath.join(base or os.getcwd(), os.path.expanduser(path))
    return "/" + posixpath.normpath(full).lstrip("/")


def absolutize_column(path: Column, base: Column) -> Column:
    """The same for a column of paths (without ``~``), folded over the components."""
    full = F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat_ws("/", base, path))
    parts = F.filter(F.split(full, "/"), lambda p: (p != "") & (p != "."))
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, p: F.when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p))),
    )
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def clone_file(source: str, target: str, action: str = "link") -> None:
    """One local file: hard link (falling back to a copy), copy, symbolic or relative symbolic link."""
    source = source.removeprefix("file:")
    target = target.removeprefix("file:")
    if action == "link":
        real = os.path.realpath(source)
        try:
            os.link(real, target)
        except OSError:
            shutil.copy2(real, target)
    elif action == "copy":
        shutil.copy2(source, target)
    elif action == "symlink":
        os.symlink(absolutize(source), target)
    elif action == "relsymlink":
        os.symlink(os.path.relpath(absolutize(source), os.path.dirname(absolutize(target))), target)
    else:
        raise ValueError(f"unknown clone action '{action}'")


def clone_directory(source: str, target: str, action: str = "link") -> None:
    """Every file of a local directory tree; the target must not exist."""
    source, target = source.removeprefix("file:"), target.removeprefix("file:")
    if os.path.exists(target):
        raise FileExistsError(target)
    for folder, _, names in os.walk(source):
        to = os.path.join(target, os.path.relpath(folder, source))
        os.makedirs(to, exist_ok=True)
        for name in names:
            clone_file(os.path.join(folder, name), os.path.join(to, name), action)


def copy_directory(spark: SparkSession, source: str, target: str) -> None:
    """Copy on any file system; object stores know no links."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    src, dst = jvm.org.apache.hadoop.fs.Path(source), jvm.org.apache.hadoop.fs.Path(target)
    if dst.getFileSystem(conf).exists(dst):
        raise FileExistsError(target)
    jvm.org.apache.hadoop.fs.FileUtil.copy(src.getFileSystem(conf), src, dst.getFileSystem(conf), dst, False, conf)
