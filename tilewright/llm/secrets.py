"""Secret scans with Spark expressions only.

Base rules find assignments to secret names, access keys and long runs of hex
digits. Beyond them, two first-order Markov models over characters are
compared: one of random strings, one of ordinary identifiers. A run of 20 or
more key characters with a letter and a digit is a secret of the kind
``random`` if the log-likelihood ratio of its character pairs is over
``RATIO``, and it overlaps no base span.

Both models are learnt from labelled samples: the random strings are made from
digests in five alphabets (``MADE`` of each, a fixed number), the identifiers are
all runs of 12 or more key characters in all documents that no base rule
matches and that aren't candidates themselves. Only counts of character pairs come to the driver: one for each pair of
the 67 key characters at most.

Scanning is a projection of each whole text: nothing is shuffled. Defined
results: null text is empty; empty texts and tables have no spans; rows that
repeat give the same result each; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm.common import cut_out, let, running_most, running_total, table, whole_text

#: Base rules: kind, pattern, what the last group of a match must have at least.
ASSIGN = r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"(AKIA[A-Z0-9]+)"
HEX = r"([0-9a-f]{32,})"  # whole runs: a shorter one can't hold a longer one
BASE = (("assign", ASSIGN, 8), ("access", ACCESS, 16), ("hex", HEX, 32))
KEY_CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
KEY = r"[A-Za-z0-9+/_=-]"
CANDIDATE = rf"(?<!{KEY})((?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z]){KEY}{{20,}})"
ORDINARY = rf"{KEY}{{12,}}"
MADE, RATIO, PRIOR, BACK = 2_000, 10.0, 0.5, 5.0


def found(text: Column, pattern: str) -> Column:
    """array<struct<first, end, last>>: leftmost matches that don't overlap, in code points, and the last group's length.

    ``pattern`` has one capturing group.
    """
    whole = rf"\G([\s\S]*?)((?:{pattern}))"  # \G: without it the text after the last match is tried from each of its characters
    sizes = [F.transform(F.regexp_extract_all(text, F.lit(whole), F.lit(g)), lambda s: F.char_length(s)) for g in (0, 2, 3)]
    spans = F.transform(
        F.arrays_zip(running_total(sizes[0]).alias("end"), sizes[1].alias("n"), sizes[2].alias("last")),
        lambda z: F.struct((z["end"] - z["n"]).alias("first"), z["end"].alias("end"), z["last"].alias("last")),
    )
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast("array<struct<first:bigint,end:bigint,last:int>>"))


def base_spans(text: Column) -> Column:
    """array<struct<first, rank, kind, end>> of the base rules, by start and then kind as listed."""

    def of(rank: int, kind: str, pattern: str, least: int) -> Column:
        return F.transform(
            F.filter(found(text, pattern), lambda m: m["last"] >= least),
            lambda m: F.struct(m["first"].alias("first"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), m["end"].alias("end")),
        )

    return F.array_sort(F.concat(*(of(rank, *rule) for rank, rule in enumerate(BASE))))


def redact(text: Column, spans: Column, mark: str) -> Column:
    """``text`` with ``mark`` for each run of overlapping or touching spans; ``spans`` are sorted by start.

    Works on the gaps between runs, in time linear in the text and its spans; a text without spans is returned as it is.
    """

    def pieces(most: Column) -> Column:  # how far the spans up to each go
        before = lambda i: F.coalesce(F.get(most, i - 1), F.lit(0).cast("bigint"))
        gaps = F.transform(spans, lambda x, i: F.struct(before(i).alias("first"), x["first"].cast("bigint").alias("end"), (i == 0).alias("whole")))
        gaps = F.filter(gaps, lambda g: g["whole"] | (g["end"] > g["first"]))
        rest = F.struct(F.element_at(most, -1).alias("first"), F.char_length(text).cast("bigint").alias("end"), F.lit(True).alias("whole"))
        return F.array_join(cut_out(text, F.concat(gaps, F.array(rest))), mark)

    return F.when(F.size(spans) == 0, text).otherwise(let(running_most(F.transform(spans, lambda x: x["end"])), pieces))


def _pairs(token: Column) -> Column:
    """array<int>: a number for each pair of neighbouring key characters."""
    codes = F.transform(F.split(token, ""), lambda c: F.position(c, F.lit(KEY_CHARS)) - 1)

    def pairs(own: Column) -> Column:  # bound once, so that the work is linear in the token's length
        ends = F.arrays_zip(F.slice(own, 1, F.greatest(F.size(own) - 1, F.lit(0))).alias("a"), F.slice(own, 2, F.greatest(F.size(own) - 1, F.lit(0))).alias("b"))
        return F.transform(ends, lambda e: e["a"] * len(KEY_CHARS) + e["b"])

    return let(codes, pairs)


def _counts(tokens: DataFrame) -> dict[int, int]:
    """Character pairs of the column ``token``; at most 67 * 67 of them come to the driver."""
    rows = tokens.select(F.explode(_pairs(F.col("token"))).alias("p")).groupBy("p").count().collect()
    return {r["p"]: r["count"] for r in rows if r["p"] is not None and r["p"] >= 0}


def random_strings(spark: SparkSession, made: int = MADE) -> DataFrame:
    """(token): ``made`` random strings in each of five alphabets, from digests of numbers."""
    base = spark.range(made).select(F.sha2(F.concat(F.lit("tilewright:"), F.col("id").cast("string")), 256).alias("h"))
    b64 = F.regexp_replace(F.base64(F.unhex("h")), "=", "")
    kinds = (b64, F.translate(b64, "+/", "-_"), F.translate(b64, "+/", "x7"), F.col("h"), F.upper(F.substring("h", 1, 32)))
    return base.select(F.explode(F.array(*kinds)).alias("token"))


def log_ratios(random: dict[int, int], ordinary: dict[int, int]) -> list[float]:
    """For each pair of characters, log P(second | first, random) - log P(second | first, ordinary)."""
    n = len(KEY_CHARS)

    def model(counts: dict[int, int]) -> list[float]:
        sums = [sum(counts.get(a * n + b, 0) for b in range(n)) for a in range(n)]
        ends = [sum(counts.get(a * n + b, 0) for a in range(n)) for b in range(n)]
        alone = [(e + PRIOR) / (sum(ends) + PRIOR * n) for e in ends]  # what pairs that weren't seen fall back on
        return [math.log((counts.get(a * n + b, 0) + BACK * alone[b]) / (sums[a] + BACK)) for a in range(n) for b in range(n)]

    return [r - o for r, o in zip(model(random), model(ordinary), strict=True)]


def fit(docs: DataFrame, text_col: str = "text") -> list[float]:
    """The log-ratio table, from made random strings and the identifiers of all documents."""
    text = whole_text(text_col)
    marked = docs.select(text.alias("text")).select("text", base_spans(F.col("text")).alias("base"))
    rest = marked.select(redact(F.col("text"), F.col("base"), " ").alias("text"))
    tokens = rest.select(F.explode(F.regexp_extract_all("text", F.lit(ORDINARY), F.lit(0))).alias("token"))
    tokens = tokens.where(~F.col("token").rlike(CANDIDATE))  # those are what is to be judged, and carry no label
    return log_ratios(_counts(random_strings(docs.sparkSession)), _counts(tokens))


def ratio(token: Column, table_: Iterable[float]) -> Column:
    """The log-likelihood ratio of a token's pairs."""
    numbers = F.split(F.lit(" ".join(f"{x:.6f}" for x in table_)), " ").cast("array<double>")
    return F.aggregate(_pairs(token), F.lit(0.0), lambda s, p: s + F.coalesce(F.get(numbers, p), F.lit(0.0)))


def _with_spans(df: DataFrame, text_col: str, log_ratio: list[float]) -> DataFrame:
    """``df`` with __text, __base and __spans (all spans); array<struct<first, rank, kind, end>> sorted by start."""
    text = F.col("__text")
    marked = df.withColumn("__text", whole_text(text_col))
    marked = marked.withColumns({"__base": base_spans(text), "__seen": found(text, CANDIDATE)})
    apart = F.filter("__seen", lambda c: ~F.exists("__base", lambda b: (b["first"] < c["end"]) & (c["first"] < b["end"])))
    token = lambda c: F.substring(text, (c["first"] + 1).cast("int"), (c["end"] - c["first"]).cast("int"))
    more = F.transform(
        F.filter(apart, lambda c: ratio(token(c), log_ratio) > RATIO),
        lambda c: F.struct(c["first"].alias("first"), F.lit(len(BASE)).alias("rank"), F.lit("random").alias("kind"), c["end"].alias("end")),
    )
    return marked.withColumn("__spans", F.array_sort(F.concat("__base", more))).drop("__seen")


def scan(docs: DataFrame, log_ratio: list[float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, base, spans): the base spans, and all spans."""
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return _with_spans(own, "text", log_ratio).select("id", F.col("__text").alias("text"), F.col("__base").alias("base"), F.col("__spans").alias("spans"))


def _written(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["first"].cast("string"), s["end"].cast("string"))), ",")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets in every document."""
    docs = table(spark, sf_dir, "documents")
    found_ = scan(docs, fit(docs))
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")
    return found_.select(
        F.col("id").alias("doc_id"),
        *(n(kind).alias(f"n_{kind}") for kind, _, _ in BASE),
        F.sha2(_written("base"), 256).alias("base_sha256"),
        _written("spans").alias("spans"),
    )


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: all documents, with ``[SECRET]`` in place of each secret and n_chars counted anew where it changed."""
    marked = _with_spans(docs, "text", fit(docs))
    hit = F.size("__spans") > 0
    new = marked.withColumn("__new", F.when(hit, redact(F.col("__text"), F.col("__spans"), "[SECRET]")).otherwise(F.col("text")))
    size = F.when(hit, F.char_length("__new").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    changed = {"text": F.col("__new").alias("text"), "n_chars": size.alias("n_chars")}
    return new.select(*[changed.get(c, F.col(c)) for c in docs.columns])
