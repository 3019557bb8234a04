"""Language identification by error-correcting output codes (operator 3).

Each language gets a codeword; for every bit one binary classifier (logistic
regression over hashed character bigrams and trigrams) is trained.  A text is
decoded by the loss of its margins against each codeword, each bit weighted by
how well it does on that language in training; the nearest codeword wins, and a
small lead over the second marks the result as ambiguous.

Training uses a bounded sample: per language the ``SAMPLE_PER_LANGUAGE``
documents with the least hash of doc_id, whole texts, fewer where
``SAMPLE_ROWS`` over all languages would be passed (but ``LEAST_PER_LANGUAGE``);
of an id that repeats one row a language is taken.  Feature counts are made on
the executors; only those vectors reach the driver.  Prediction is one narrow
pass over all texts with a model of fixed size; n-grams are those of the whole
text, however it is cut into slices.

Defined results: a null text or one without letters is ``und`` with score 0;
null languages are not learned from; if nothing can be learned every text is
``und``; with one language every text with letters gets it with score 1;
repeated rows and null doc_ids give one row each (a null id is not held out
and not learned from); an empty table gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairnframe.llm.common import cut, small, table, text_slices

SAMPLE_PER_LANGUAGE = 300
#: Rows of the sample in all: 32 KB of features each on the driver, twice.
SAMPLE_ROWS = 6000
LEAST_PER_LANGUAGE = 8
#: Hashed features per n-gram order.
BUCKETS = 4096
CODE_BITS = 31
#: Lead in mean loss over the second codeword below which a text is ambiguous.
LEAD = 0.05
UNKNOWN = "und"
_SLICE = 500_000


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature index of every n-gram, text it belongs to, has a letter per text).

    Letters are lower-cased, everything else becomes one kind of blank; n-grams of blanks only
    and n-grams over a text's end get the index 2 * BUCKETS.
    """
    code = np.frombuffer("\x00".join(["", *(t.lower().replace("\x00", " ") for t in texts), ""]).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint32)
    ends = code == 0
    letter = _letters()[code]
    x = np.where(letter, code, np.uint32(32))
    x[ends] = 0
    owner = np.cumsum(ends) - 1
    a, b, c = x[:-2], x[1:-1], x[2:]
    la, lb, lc = letter[:-2], letter[1:-1], letter[2:]
    ea, eb, ec = ends[:-2], ends[1:-1], ends[2:]
    with np.errstate(over="ignore"):
        h2 = (a * np.uint32(0x9E3779B1)) ^ (b * np.uint32(0x85EBCA77))
        h3 = h2 * np.uint32(0xC2B2AE3D) + c * np.uint32(0x27D4EB2F)
        two = ((h2 ^ (h2 >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(20)).astype(np.int64)
        three = ((h3 ^ (h3 >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(20)).astype(np.int64) + BUCKETS
    two[ea | eb | ~(la | lb)] = 2 * BUCKETS
    three[ea | eb | ec | ~lb] = 2 * BUCKETS
    has = np.bincount(owner[letter], minlength=len(texts) + 1)[: len(texts)] > 0
    return np.concatenate([two, three]), np.concatenate([owner[:-2], owner[:-2]]), has


def features(text: str) -> np.ndarray:
    """Relative frequency of each hashed n-gram of one text, slice by slice."""
    total = np.zeros(2 * BUCKETS + 1)
    count = lambda part: np.bincount(_grams([part])[0], minlength=2 * BUCKETS + 1)
    text = text.lower()
    for i in range(0, max(1, len(text)), _SLICE):
        # a slice reaches two characters into the next one; what lies within these two counts there
        total += count(text[i : i + _SLICE + 2])
        if i + _SLICE < len(text):
            total -= count(text[i + _SLICE : i + _SLICE + 2])
    total = total[:-1]
    return total / max(1.0, total.sum())


def codewords(n: int, bits: int = CODE_BITS) -> np.ndarray:
    """+-1 codewords of n languages: the exhaustive code up to six, else the best of seeded random ones."""
    if n <= 1:
        return np.ones((n, 0))
    if n <= 6:
        width = 2 ** (n - 1) - 1
        code = np.ones((n, width))
        for k in range(1, n):
            run = 2 ** (n - 1 - k)
            code[k] = [-1 if (j // run) % 2 == 0 else 1 for j in range(width)]
        return code
    best, far = None, -1
    for seed in range(200):
        code = np.random.default_rng(seed).choice([-1.0, 1.0], size=(n, bits))
        if (np.abs(code.sum(axis=0)) == n).any():
            continue
        least = min(int((code[i] != code[j]).sum()) for i in range(n) for j in range(i))
        if least > far:
            best, far = code, least
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray  # features x bits, a zero row at the end
    bias: np.ndarray
    trust: np.ndarray  # languages x bits, rows sum to 1

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(best language index, score, ambiguous) of margins, one row a text."""
        n = len(self.languages)
        if n == 1:
            return np.zeros(len(margins), int), np.ones(len(margins)), np.zeros(len(margins), bool)
        loss = np.logaddexp(0, -margins[:, None, :] * self.code[None]) * self.trust[None]
        loss = loss.sum(axis=2)
        order = np.sort(loss, axis=1)
        p = np.exp(-(loss - order[:, :1]) * 4)
        return loss.argmin(axis=1), 1 / p.sum(axis=1), order[:, 1] - order[:, 0] < LEAD

    def predict(self, texts: list[str]) -> list[tuple[str, float, bool]]:
        if not self.languages:
            return [(UNKNOWN, 0.0, True)] * len(texts)
        index, owner, has = _grams(texts)
        known = index < 2 * BUCKETS
        index, owner = index[known], owner[known]
        n = np.maximum(1, np.bincount(owner, minlength=len(texts))[: len(texts)])
        margins = np.empty((len(texts), self.weights.shape[1]))
        for b in range(self.weights.shape[1]):
            margins[:, b] = np.bincount(owner, weights=self.weights[:, b][index], minlength=len(texts))[: len(texts)]
        best, score, close = self.decode(margins / n[:, None] + self.bias)
        return [(self.languages[k], float(s), bool(c)) if h else (UNKNOWN, 0.0, True) for k, s, c, h in zip(best, score, close, has)]

    def predict_one(self, text: str) -> tuple[str, float, bool]:
        """One text too long for a slice: margins are means over its slices, weighted by their n-grams."""
        x = features(text)
        if not self.languages or not any(c.isalpha() for c in text):
            return UNKNOWN, 0.0, True
        best, score, close = self.decode((x @ self.weights[:-1] + self.bias)[None])
        return self.languages[best[0]], float(score[0]), bool(close[0])


def fit(x: np.ndarray, y: list[str], rounds: int = 150) -> Model:
    """One logistic regression per code bit by full-batch gradient steps with momentum."""
    languages = sorted(set(y))
    code = codewords(len(languages))
    label = np.array([languages.index(v) for v in y], dtype=int)
    bits = code.shape[1]
    if not bits:
        return Model(languages, code, np.zeros((2 * BUCKETS + 1, 0)), np.zeros(0), np.ones((len(languages), 0)))
    scale = 1 / (x.std(axis=0) + 1e-4)
    mean = x.mean(axis=0)
    z = ((x - mean) * scale).astype(np.float32) / np.sqrt(x.shape[1])
    target = code[label].astype(np.float32)
    share = np.bincount(label, minlength=len(languages))
    weight = (1 / share[label])[:, None].astype(np.float32) / len(languages)
    w, b = np.zeros((x.shape[1], bits), np.float32), np.zeros(bits, np.float32)
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    for _ in range(rounds):
        g = -target / (1 + np.exp(target * (z @ w + b))) * weight
        vw = 0.9 * vw - 2.0 * (z.T @ g + 1e-4 * w)
        vb = 0.9 * vb - 0.5 * g.sum(axis=0)
        w, b = w + vw, b + vb
    right = (np.sign(z @ w + b) == target).astype(float)
    trust = np.stack([right[label == k].mean(axis=0) for k in range(len(languages))]) + 1e-3
    folded = w * scale[:, None] / np.sqrt(x.shape[1])
    bias = b - mean @ folded
    return Model(languages, code, np.vstack([folded, np.zeros((1, bits))]).astype(np.float64), bias.astype(np.float64), trust / trust.sum(axis=1, keepdims=True))


def train(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """Model of the labelled rows (text, lang) of ``docs``; see the module for the sample's bound."""
    labelled = docs.where("lang is not null and doc_id is not null").select("lang", "doc_id", F.xxhash64("doc_id").alias("__h"))
    counts = cut(labelled.groupBy("lang").agg(F.count("*").alias("__n")))
    # a hash bound leaves about four times the sample of each language before anything is ordered
    most = max(LEAST_PER_LANGUAGE, min(per_language, SAMPLE_ROWS // max(1, counts.count())))
    share = F.least(F.lit(1.0), F.lit(4.0 * most + 100) / F.col("__n"))
    likely = labelled.join(small(counts), "lang").where(F.shiftrightunsigned("__h", 11) < share * float(1 << 53))
    order = Window.partitionBy("lang").orderBy("__h", "doc_id")
    ids = likely.withColumn("__k", F.row_number().over(order)).where(F.col("__k") <= most).select("doc_id").distinct()
    ids = small(cut(ids))
    own = docs.where("lang is not null").join(ids, "doc_id", "left_semi").select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    chosen = own.groupBy("doc_id", "lang").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = features(text.as_py() or "")
                at = np.flatnonzero(x).astype("<u2")
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([at.tobytes()], pa.binary()), pa.array([x[at].astype("<f4").tobytes()], pa.binary())], names=["lang", "at", "x"])

    rows = sorted((r["lang"], bytes(r["at"]), bytes(r["x"])) for r in chosen.mapInArrow(count, "lang string, at binary, x binary").collect())
    x = np.zeros((len(rows), 2 * BUCKETS), np.float32)
    for i, (_, at, value) in enumerate(rows):
        x[i, np.frombuffer(at, "<u2")] = np.frombuffer(value, "<f4")
    return fit(x, [r[0] for r in rows])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (doc_id, text) -> doc_id, lang_pred, score, ambiguous; one narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[str, float, bool]] = []
            for _, texts in text_slices((t.as_py() for t in batch.column(1)), _SLICE):
                out += model.predict(texts) if len(texts) > 1 or len(texts[0]) <= _SLICE else [model.predict_one(texts[0])]
            lang, score, close = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(close, pa.bool_())], names=["doc_id", "lang_pred", "score", "ambiguous"])

    schema = "doc_id long, lang_pred string, score double, ambiguous boolean"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def label(docs: DataFrame, model: Model, columns: str = "lang_pred string, score double, ambiguous boolean") -> DataFrame:
    """``docs`` with its own columns and the prediction beside them."""
    from pyspark.sql.types import StructType

    schema = StructType([*docs.schema.fields, *StructType.fromDDL(columns).fields])
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[str, float, bool]] = []
            for _, texts in text_slices((t.as_py() for t in batch.column(at)), _SLICE):
                out += model.predict(texts) if len(texts) > 1 or len(texts[0]) <= _SLICE else [model.predict_one(texts[0])]
            lang, score, close = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(close, pa.bool_())], names=schema.names)

    return docs.mapInArrow(run, schema)


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, ambiguous."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.where(~held_out(F.col("doc_id"))))
    return predict(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")
