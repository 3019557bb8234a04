"""Secret scans with character Markov models (operator 5), DataFrame functions only.

Three base rules find assignments, access keys and hexadecimal runs.  Beyond
them, long tokens with a letter in what the base rules leave of a text are judged by two first-order
character models, one of random strings and one of ordinary identifiers: the
mean log-likelihood ratio per transition decides.  The models are counted from
labelled samples with ``groupBy`` and enter the scan as one literal table of
fixed size (alphabet squared), so scanning is a single narrow pass over the
texts without any shuffle.  Matches and replacements are placed block by block, so a text costs
little more than its length however many it holds.

The default labelled samples are strings derived from SHA-256 (random) and
identifiers composed of words of at most ``SAMPLE_DOCS`` documents (ordinary).

Defined results: a null text counts as empty; repeated rows and null doc_ids
give one row each; an empty table gives an empty result; other columns are
carried by ``scan`` and ignored by the query.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnframe.llm.common import cut, table

# The base rules.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "random")

#: Tokens that the models judge.
TOKEN = r"[A-Za-z0-9+/_=-]{16,}"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-."
#: Mean log-likelihood ratio per transition from which a token counts as random.
THRESHOLD = 0.5
SAMPLE_DOCS = 1000
SAMPLE_RANDOM = 3000
#: Matches placed one after the other; more go in blocks of so many.
BLOCK = 128
_SPAN = "array<struct<start:int,stop:int,kind:int,hit:string>>"


def labelled_samples(docs: DataFrame) -> DataFrame:
    """(value, random): at most ``SAMPLE_RANDOM`` rows of random strings per form, and identifiers
    from at most ``SAMPLE_DOCS`` documents (least hashes of doc_id, one row of each, whole texts, base hits removed)."""
    spark = docs.sparkSession
    digest = F.sha2(F.concat(F.lit("sample"), F.col("id").cast("string")), 256)
    b64 = F.base64(F.unhex(digest))
    plain = F.translate(b64, "+/=", "xYz")
    random = spark.range(SAMPLE_RANDOM).select(
        F.explode(F.array(F.substring(digest, 1, 40), F.substring(b64, 1, 40), F.substring(plain, 1, 32), F.upper(F.substring(plain, 1, 24)))).alias("value"),
        F.lit(True).alias("random"),
    )
    ids = docs.where("doc_id is not null").select("doc_id")
    chosen = ids.distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS)
    own = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id", "left_semi")
    # one row of an id that repeats; cut, so that nothing below is done to texts that were not chosen
    texts = cut(own.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("text"))
    clean = texts.select(F.regexp_replace(F.regexp_replace(F.regexp_replace("text", ASSIGN, " "), ACCESS, " "), HEX, " ").alias("text"))
    words = clean.select(F.filter(F.split(F.regexp_replace("text", "[^A-Za-z]+", " "), " "), lambda w: F.length(w).between(2, 24)).alias("w")).where(F.size("w") >= 3)
    at = F.sequence(F.lit(0), F.size("w") - 3, F.lit(3))
    w = lambda i, k: F.get("w", i + k)
    forms = F.flatten(
        F.transform(
            at,
            lambda i: F.array(
                F.concat_ws("_", F.lower(w(i, 0)), F.lower(w(i, 1)), F.lower(w(i, 2))),
                F.concat(F.lower(w(i, 0)), F.initcap(w(i, 1)), (i % 100).cast("string")),
                F.concat_ws("-", F.upper(w(i, 1)), w(i, 2), (F.lit(1990) + i % 40).cast("string")),
                F.concat_ws("/", w(i, 0), w(i, 2)),
            ),
        )
    )
    ordinary = words.select(F.explode(forms).alias("value"), F.lit(False).alias("random"))
    return random.unionByName(ordinary)


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratio of each character transition, row by row of ``ALPHABET``; add-one smoothed."""
    pairs = samples.where(F.length("value") >= 2).select(
        "random", F.explode(F.transform(F.sequence(F.lit(1), F.length("value") - 1), lambda i: F.substring(F.col("value"), i, F.lit(2)))).alias("pair")
    )
    counts = {(r["random"], r["pair"]): r["n"] for r in pairs.groupBy("random", "pair").agg(F.count("*").alias("n")).where(F.col("pair").rlike(f"^[{ALPHABET[:62]}+/_=.-]{{2}}$")).collect()}
    k = len(ALPHABET)
    sums = {(label, a): k + sum(counts.get((label, a + b), 0) for b in ALPHABET) for label in (True, False) for a in ALPHABET}
    return [
        math.log((counts.get((True, a + b), 0) + 1) / sums[True, a]) - math.log((counts.get((False, a + b), 0) + 1) / sums[False, a])
        for a in ALPHABET
        for b in ALPHABET
    ]


def _table(model: list[float]) -> Column:
    return F.split(F.lit(",".join(f"{x:.6f}" for x in model)), ",").cast("array<double>")


def mean_llr(token: Column, model: Column) -> Column:
    """Mean log-likelihood ratio per transition of a token of ``ALPHABET`` characters."""
    k = len(ALPHABET)
    symbols = F.transform(F.sequence(F.lit(1), F.length(token)), lambda i: F.instr(F.lit(ALPHABET), F.substring(token, i, F.lit(1))) - 1)
    steps = F.zip_with(F.slice(symbols, 1, F.size(symbols) - 1), F.slice(symbols, 2, F.size(symbols) - 1), lambda a, b: F.get(model, a * k + b))
    return F.aggregate(steps, F.lit(0.0), lambda s, x: s + x) / (F.length(token) - 1)


def _blocks(items: Column) -> Column:
    """An array in arrays of ``BLOCK`` items, none of an empty one."""
    at = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / BLOCK).cast("int"))
    return F.when(F.size(items) > 0, F.transform(at, lambda i: F.slice(items, i * BLOCK + 1, F.lit(BLOCK)))).otherwise(F.slice(F.array(items), 1, 0))


def _before(amounts: Column, add) -> Column:
    """What stands before each of an array of whole numbers, beginning with 0: ``add`` of all earlier ones; one item more than the array."""
    return F.aggregate(amounts, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(add(F.element_at(acc, -1), x).cast("int"))))


def _hits(text: Column, pattern: str) -> Column:
    """(gap, hit) of all leftmost non-overlapping matches, and what is left behind them as a last gap without a hit."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.zip_with(F.split(text, pattern, -1), hits, lambda gap, hit: F.struct(gap.alias("gap"), hit.alias("hit")))


def _spans(hits: Column, kind: int) -> Column:
    """Spans of ``_hits``: positions follow from the lengths of what lies between."""
    empty = F.array().cast(_SPAN)
    length = lambda x: F.length(x["gap"]) + F.coalesce(F.length(x["hit"]), F.lit(0))
    blocks = _blocks(hits)
    sizes = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda n, x: n + length(x)))

    def step(acc, x):
        start = acc["at"] + F.length(x["gap"])
        stop = start + F.coalesce(F.length(x["hit"]), F.lit(0))
        span = F.struct(start.alias("start"), stop.alias("stop"), F.lit(kind).alias("kind"), x["hit"].alias("hit"))
        return F.struct(stop.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    placed = F.zip_with(
        blocks, F.slice(_before(sizes, lambda a, b: a + b), F.lit(1), F.size(blocks)), lambda b, at: F.aggregate(b, F.struct(at.alias("at"), empty.alias("out")), step, lambda acc: acc["out"])
    )
    return F.filter(F.flatten(placed), lambda s: s["hit"].isNotNull())


def _masked(hits: Column, which) -> Column:
    """The text of ``_hits`` with hits for which ``which`` holds turned into as many spaces."""
    plain = lambda hit: F.coalesce(F.when(which(hit), F.repeat(F.lit(" "), F.length(hit))).otherwise(hit), F.lit(""))
    return F.array_join(F.transform(hits, lambda x: F.concat(x["gap"], plain(x["hit"]))), "")


def scan(docs: DataFrame, model: list[float], threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``__base`` and ``__all``: arrays of spans (start, stop, kind, hit), sorted by start and kind."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    enough = lambda hit: F.length(F.regexp_extract(hit, ASSIGN, 2)) >= 8
    found = docs.withColumn("__text", text)
    # one rule after the other; what is null has no match
    found = found.withColumn("__h0", F.when(F.col("__text").rlike(ASSIGN), _hits(F.col("__text"), ASSIGN)))
    found = found.withColumn("__h1", F.when(F.col("__text").contains("AKIA"), _hits(F.col("__text"), ACCESS)))
    found = found.withColumn("__h2", F.when(F.col("__text").rlike(HEX), _hits(F.col("__text"), HEX)))
    none = F.array().cast(_SPAN)
    kept = F.filter(_spans(F.col("__h0"), 0), lambda s: enough(s["hit"]))
    base = F.concat(F.coalesce(kept, none), F.coalesce(_spans(F.col("__h1"), 1), none), F.coalesce(_spans(F.col("__h2"), 2), none))
    found = found.withColumn("__base", F.array_sort(base))
    # tokens are sought in what the base rules leave
    left = F.coalesce(_masked(F.col("__h0"), enough), F.col("__text"))
    for pattern, hits in ((ACCESS, "__h1"), (HEX, "__h2")):
        found = found.withColumn("__text", left)
        # what is masked already can only take matches away
        left = F.when(F.col(hits).isNotNull(), _masked(_hits(F.col("__text"), pattern), lambda hit: hit.isNotNull())).otherwise(F.col("__text"))
    found = found.withColumn("__text", left)
    found = found.withColumn("__h3", F.when(F.col("__text").rlike(TOKEN), _hits(F.col("__text"), TOKEN)))
    table_ = _table(model)
    judged = F.filter(F.coalesce(_spans(F.col("__h3"), 3), none), lambda s: s["hit"].rlike("[A-Za-z]") & (mean_llr(s["hit"], table_) >= threshold))
    return found.withColumn("__all", F.array_sort(F.concat(F.col("__base"), judged))).drop("__text", "__h0", "__h1", "__h2", "__h3")


def span_string(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def redact(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with every span replaced by ``mark``; spans that overlap the one before are merged."""
    blocks = _blocks(spans)
    stops = F.transform(blocks, lambda b: F.array_max(F.transform(b, lambda s: s["stop"])))
    reach = _before(stops, lambda a, b: F.greatest(a, b))  # how far the blocks before have come

    def replaced(block: Column, at: Column) -> Column:
        stop = F.greatest(at, F.array_max(F.transform(block, lambda s: s["stop"])))
        piece = F.substring(text, at + 1, stop - at)

        def step(acc, s):
            between = F.substring(acc["piece"], acc["at"] - at + 1, s["start"] - acc["at"])
            fresh = s["start"] >= acc["at"]
            return F.struct(
                acc["piece"].alias("piece"),
                F.greatest(acc["at"], s["stop"]).alias("at"),
                F.when(fresh, F.concat(acc["out"], between, F.lit(mark))).otherwise(acc["out"]).alias("out"),
            )

        return F.aggregate(block, F.struct(piece.alias("piece"), at.alias("at"), F.lit("").alias("out")), step, lambda acc: acc["out"])

    parts = F.zip_with(blocks, F.slice(reach, F.lit(1), F.size(blocks)), replaced)
    whole = F.concat(F.array_join(parts, ""), F.substring(text, F.element_at(reach, -1) + 1, F.length(text)))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def find_secrets(docs: DataFrame) -> DataFrame:
    """``scan`` with models trained on the default labelled samples."""
    return scan(docs, train(labelled_samples(docs)))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    out = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = lambda kind: F.size(F.filter("__base", lambda s: s["kind"] == kind)).cast("long")
    return out.select(
        "doc_id",
        n(0).alias("n_assign"),
        n(1).alias("n_access"),
        n(2).alias("n_hex"),
        F.sha2(span_string(F.col("__base")), 256).alias("base_sha256"),
        span_string(F.col("__all")).alias("spans"),
    )
