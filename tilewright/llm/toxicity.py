"""Toxicity by maximum-scoring segments of token log-odds.

Learning reads at most ``SAMPLE`` labelled rows, those whose ids hash lowest;
rows whose crc32(id as text) mod 4 is 2 are held out and never learnt from.
Rows of the same whole
text share the weight of one document; texts that only begin alike don't.
For each word and each word beginning of 3 to 6 letters that several words
share, the share of toxic
documents among those that have it gets a Dirichlet prior centred on the next
shorter beginning's posterior share, and at last on the overall share. Its
log-odds against the overall share is a token's score; tokens without evidence
of toxicity take off a small constant each, so scores drift down in clean text.

Scoring scans each whole text once and finds all maximal-scoring segments in
linear time (Ruzzo and Tompa, 1999). Under the background of clean documents
the best segment of m tokens reaches S with probability 1 - exp(-K m e^(-lambda S))
(Karlin and Altschul, 1990); lambda solves the background's equation and K is
fitted to the clean learning rows. Passages with an E-value of at most
``SIGNIFICANT`` are reported; the sum of their surprisals is turned into a
probability of the label by a logistic curve fitted on the learning rows.

Defined results: null and empty texts score as texts without a passage; an id
with several labels counts as toxic if any says so; without labels of both
kinds every score is the share of toxic labels (0 without labels). Repeated
rows score alike. Only the id, the text and the labels are read; other columns
are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm.common import cut, table, texts

#: Most labelled rows that the model is fitted on.
SAMPLE = 40_000
#: Beginnings of words, the weight of a prior, the least share and number of toxic documents of a hit.
PREFIXES, PRIOR, HIT_SHARE, HIT_DOCS = (3, 4, 5, 6), 6.0, 0.6, 2.0
#: What a token that isn't a hit takes off, the highest score of one, and the E-value of a significant passage.
DRIFT, MOST, SIGNIFICANT = 0.05, 6.0, 0.05
THRESHOLD = 0.3
#: Words that a task remembers; bounds memory and changes no result.
MEMO_WORDS = 1 << 18
#: Features that a task counts before it sends them on; bounds memory and changes no count.
COUNTED = 200_000
WORDS = re.compile(r"[^\W\d_]+")


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def features(word: str) -> list[str]:
    """A word's own feature, then its beginnings from the longest on."""
    return [f"={word}", *(word[:k] for k in reversed(PREFIXES) if len(word) >= k)]


@dataclass
class Model:
    scores: dict[str, float] = field(default_factory=dict)
    share: float = 0.0
    rate: float = 1.0  # lambda
    k: float = 1.0
    intercept: float = -20.0
    slope: float = 0.0

    def word(self, word: str) -> float:
        for f in features(word):
            if f in self.scores:
                return self.scores[f]
        return 0.0

    def evidence(self, passages: list[tuple[int, int, float]], n: int) -> tuple[list[tuple[int, int, float, float]], float]:
        """The significant passages with their E-values, and the sum of their surprisals."""
        out, total = [], 0.0
        for a, b, s in passages:
            log_e = math.log(self.k * max(n, 1)) - self.rate * s
            if log_e <= math.log(SIGNIFICANT):
                out.append((a, b, s, math.exp(log_e)))
                total -= log_e
        return out, total

    def probability(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, self.intercept + self.slope * math.log1p(evidence)))))


def segments(places: list[int], scores: list[float], drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, end, score) where tokens at ``places`` score and all others take off ``drift``."""
    stack: list[tuple[float, float, int, int, int]] = []  # sum before, sum with, first, last, the nearest below with a lower sum before
    total, last = 0.0, -1
    for at, s in zip(places, scores, strict=True):
        before = total - drift * (at - last - 1)
        total, last = before + s, at
        low, first = before, at
        j = len(stack) - 1
        while True:
            while j >= 0 and stack[j][0] >= low:
                j = stack[j][4]
            if j < 0 or stack[j][1] >= total:
                stack.append((low, total, first, at, j))
                break
            low, first, j = stack[j][0], stack[j][2], stack[j][4]
            del stack[_index(stack, first) :]
    return [(a, b + 1, high - low) for low, high, a, b, _ in stack]


def _index(stack: list, first: int) -> int:
    """Where the segment that begins at ``first`` stands; it is near the end."""
    i = len(stack) - 1
    while stack[i][2] != first:
        i -= 1
    return i


class _Scores(dict):
    """Scores of words, worked out when first met."""

    def __init__(self, of: Callable[[str], float]):
        self.of = of

    def __missing__(self, word: str) -> float:
        self[word] = s = self.of(word)
        return s


class _Scanner:
    def __init__(self, model: Model):
        self.scores = _Scores(model.word)

    def __call__(self, text: str) -> tuple[int, np.ndarray, np.ndarray]:
        """The number of tokens; the places and scores of hits."""
        if len(self.scores) > MEMO_WORDS:
            self.scores.clear()
        words = WORDS.findall(text.lower())
        own = np.fromiter(map(self.scores.__getitem__, words), np.float32, len(words))
        places = np.flatnonzero(own)
        return len(words), places, own[places]


def _counts(weights: dict[int, float]) -> Callable:
    """(feature, toxic, clean): weights of the documents that have a feature, summed in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = (Counter(), Counter())

        def rows() -> Iterator[pa.RecordBatch]:
            keys = [*sums[0], *(f for f in sums[1] if f not in sums[0])]
            for k in range(0, len(keys), 50_000):
                part = keys[k : k + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part, pa.string()), *(pa.array([float(s[f]) for f in part], pa.float64()) for s in sums)],
                    names=["feature", "toxic", "clean"],
                )
            for s in sums:
                s.clear()

        for batch in batches:
            for text, toxic, copy in zip(*batch.columns, strict=True):
                words = set(WORDS.findall(text.as_py().lower()))
                own, w = {f for word in words for f in features(word)}, 1 / weights.get(copy.as_py(), 1)
                kind = sums[0 if toxic.as_py() else 1]
                for f in own:
                    kind[f] += w
                if len(sums[0]) + len(sums[1]) > COUNTED:
                    yield from rows()
        yield from rows()

    return run


def _background(model: Model, floor: float) -> Callable:
    """(n, hits, over): of the clean learning rows of a task, the tokens, the hits among them and the rows whose best segment reaches ``floor``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan, sums = _Scanner(model), [0, 0, 0]
        for batch in batches:
            for text, toxic, _ in zip(*batch.columns, strict=True):
                if not toxic.as_py():
                    n, places, scores = scan(text.as_py())
                    best = max((s for _, _, s in segments(places.tolist(), scores.tolist())), default=0.0)
                    sums = [x + y for x, y in zip(sums, (n, len(places), int(best >= floor)), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in sums], names=["n", "hits", "over"])

    return run


def _evidence(model: Model) -> Callable:
    """(toxic, copy, evidence) of each learning row, as scoring sees it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = _Scanner(model)
        for batch in batches:
            out = []
            for text in batch.column(0):
                n, places, scores = scan(text.as_py())
                out.append(model.evidence(segments(places.tolist(), scores.tolist()), n)[1])
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(out, pa.float64())], names=["toxic", "copy", "evidence"])

    return run


def _varied(counts: DataFrame) -> set[str]:
    """Beginnings whose evidence comes from several words: no word has more than half of it."""
    words = counts.where(F.col("feature").startswith("=") & (F.col("toxic") > 2 * F.col("clean")))
    starts = F.explode(F.array(*[F.substring("feature", 2, k) for k in PREFIXES]))
    by = words.select(starts.alias("start"), "feature", "toxic").distinct().where(F.length("feature") > F.length("start"))
    by = by.groupBy("start").agg(F.sum("toxic").alias("all"), F.max("toxic").alias("most"))
    return {r["start"] for r in by.where((F.col("all") >= 2 * HIT_DOCS) & (F.col("most") <= F.col("all") / 2)).collect()}


def _posteriors(rows: list, share: float, varied: set[str]) -> dict[str, float]:
    """Scores of the features that speak for toxicity, each share drawn to that of the next shorter beginning."""
    counts = {r["feature"]: (r["toxic"], r["clean"]) for r in rows}
    shares: dict[str, float] = {}

    def posterior(f: str) -> float:
        if f not in shares:
            longest = (f[1:] + " ") if f[0] == "=" else f
            shorter = next((longest[:k] for k in reversed(PREFIXES) if k < len(longest) and longest[:k] in counts), None)
            prior = posterior(shorter) if shorter else share
            t, c = counts[f]
            shares[f] = (t + PRIOR * prior) / (t + c + PRIOR)
        return shares[f]

    base = math.log(share / (1 - share))
    return {
        f: min(MOST, math.log(p / (1 - p)) - base)
        for f, (t, _) in counts.items()
        if t >= HIT_DOCS and (f[0] == "=" or f in varied) and (p := posterior(f)) >= HIT_SHARE
    }


def _rate(hits: float, tokens: float, scores: list[float]) -> float:
    """lambda: the positive root of E[e^(lambda s)] = 1 over the clean tokens, with one more hit of each score than was seen."""
    weight = (hits + 1) / max(1, len(scores)) / (tokens + 1)
    low, high = 1e-3, 50.0
    for _ in range(60):
        mid = (low + high) / 2
        up = sum(math.exp(min(700, mid * s)) for s in scores) * weight
        low, high = (mid, high) if up + (1 - weight * len(scores)) * math.exp(-mid * DRIFT) < 1 else (low, mid)
    return low


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Intercept and slope, by damped Newton steps with a weak prior."""
    beta, design = np.zeros(2), np.stack([np.ones_like(x), x], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        grad = design.T @ (w * (y - p)) - 1e-2 * beta
        hess = (design * (w * p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(beta[0]), float(beta[1])


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE
) -> Model:
    """Learns from at most ``sample`` labelled rows that aren't held out."""
    known = labels.select(F.col(id_col).alias("l_id"), F.col(label_col).cast("int").alias("toxic")).where("l_id IS NOT NULL AND toxic IS NOT NULL")
    known = known.where(~held_out(F.col("l_id"))).groupBy("l_id").agg(F.max("toxic").alias("toxic"))
    known = F.broadcast(known.orderBy(F.xxhash64("l_id"), "l_id").limit(sample))  # at most `sample` rows of 12 bytes
    own = texts(docs, id_col, text_col).join(known, F.col("id") == F.col("l_id"))
    # copies of a text share one weight; the sample is read several times, so it is written once
    own = cut(own.select("text", "toxic", F.xxhash64("text").alias("copy")))
    sizes = own.groupBy("copy").agg(F.count("*").alias("n"), F.sum("toxic").alias("t")).collect()  # at most `sample` rows
    weights = {r["copy"]: r["n"] for r in sizes if r["n"] > 1}
    toxic, rows = sum(r["t"] / r["n"] for r in sizes), len(sizes)
    if not 0 < toxic < rows:
        share = toxic / rows if rows else 0.0
        return Model(share=share, intercept=math.log((share + 1e-9) / (1 - share + 1e-9)))
    model = Model(share=toxic / rows)
    counts = own.mapInArrow(_counts(weights), "feature string, toxic double, clean double").groupBy("feature")
    counts = counts.agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    seen = counts.where((F.col("toxic") >= HIT_DOCS) & (F.col("toxic") >= HIT_SHARE / 2 * (F.col("toxic") + F.col("clean"))))
    model.scores = _posteriors(seen.collect(), model.share, _varied(counts))
    levels = sorted({round(s, 1) for s in model.scores.values()}) or [1.0]
    sums = own.mapInArrow(_background(model, levels[0]), "n bigint, hits bigint, over bigint").agg(*[F.sum(c).alias(c) for c in ("n", "hits", "over")]).first()
    model.rate = _rate(sums["hits"], sums["n"], levels)
    model.k = (sums["over"] + 1) / (sums["n"] + 1) * math.exp(model.rate * levels[0])
    found = own.mapInArrow(_evidence(model), "toxic int, copy bigint, evidence double").collect()  # at most `sample` rows of three numbers
    x = np.array([math.log1p(r["evidence"]) for r in found])
    w = np.array([1 / weights.get(r["copy"], 1) for r in found])
    model.intercept, model.slope = _logistic(x, np.array([r["toxic"] for r in found], float), w)
    return model


_PASSAGES = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("e_value", pa.float64())]))


def _scorer(model: Model) -> Callable[[str], tuple[float, list[tuple[int, int, float, float]]]]:
    """The score of a text and its significant passages."""
    scan = _Scanner(model)

    def of(text: str) -> tuple[float, list[tuple[int, int, float, float]]]:
        n, places, own = scan(text)
        kept, evidence = model.evidence(segments(places.tolist(), own.tolist()), n)
        return model.probability(evidence), kept

    return of


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, passages array<struct<first, end, score, e_value>>): passages count words, ends exclusive."""
    own = texts(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _scorer(shared.value)
        for batch in batches:
            found = [of(text.as_py()) for text in batch.column(1)]
            passages = [[dict(zip(("first", "end", "score", "e_value"), p, strict=True)) for p in kept] for _, kept in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([s for s, _ in found], pa.float64()), pa.array(passages, _PASSAGES)], names=["id", "score", "passages"]
            )

    kind = dict(own.dtypes)["id"]
    return own.mapInArrow(run, f"id {kind}, score double, passages array<struct<first: int, end: int, score: double, e_value: double>>")


def rows_below(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns unchanged, whose text scores below ``threshold``; each row by its own text alone."""
    texts(docs, None, text_col)  # for the batch size
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _scorer(shared.value)
        for batch in batches:
            yield batch.filter(pa.array([of(text.as_py() or "")[0] < threshold for text in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, by a model of the labels that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    found = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return found.select(
        F.col("id").alias("doc_id"),
        F.coalesce(held_out(F.col("id")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        F.size("passages").cast("bigint").alias("n_passages"),
    )


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the rows that aren't predicted toxic, unchanged.

    Each row is judged by its own text, so a null or repeated id, or a namesake's text, decides nothing;
    null and empty texts, which hold no passage, stay unless labels leave nothing else to go by.
    """
    return rows_below(docs, fit(docs, table(spark, sf_dir, "labels")))
