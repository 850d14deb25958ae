"""Document quality from weak labels.

Seven overlapping heuristics vote good, junk or nothing on each document. Their
accuracies are unknown; expectation-maximisation estimates them, and the share
of good documents, from how often each pattern of votes occurs in all documents
(two classes, votes independent given the class; Dawid and Skene, 1979). At
most 3^7 patterns with their counts come to the driver. Posterior labels of at
most ``SAMPLE`` documents, those whose ids hash lowest, train a logistic scorer
on hashed features: byte trigrams of the whole text and binned shape statistics,
square roots of shares in ``DIM`` bins. The scorer rates every document.

Defined results: null text is empty; an empty text has no votes and no trigram
and is scored from its shape alone; rows that repeat score alike; an empty
table gives no rows. Columns other than id and text are ignored. Human labels
aren't read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm.common import table, texts

#: Most documents that the scorer is trained on, its bins, and the score from which a document is kept.
SAMPLE, DIM, KEEP = 20_000, 1024, 0.5
#: Bytes hashed at a time; bounds memory and changes no result.
CHUNK = 1 << 20
GOOD, NOTHING, JUNK = 1, 0, -1
PLAIN = re.compile(r"(?<!\S)[^\W\d_]+[.,;:!?]?(?!\S)")

_CLASS = np.zeros(256, np.uint8)  # 0 letters and all else, 1 capitals, 2 digits, 3 white space, 4 symbols
for _b in range(128):
    _c = chr(_b)
    _CLASS[_b] = 1 if "A" <= _c <= "Z" else 2 if _c.isdigit() else 3 if _c.isspace() else 0 if _c.isalpha() else 4


def shape(text: str) -> dict[str, float]:
    """Shares that the heuristics and the scorer look at."""
    data = np.frombuffer(text.encode(), np.uint8)
    counts = np.bincount(_CLASS[data], minlength=5)
    words, lines = text.split(), [x for x in text.split("\n") if x]
    letters = max(1, int(counts[0] + counts[1]))
    return {
        "bytes": len(data),
        "words": len(words),
        "lines": len(lines),
        "symbols": counts[4] / max(1, len(data)),
        "capitals": counts[1] / letters,
        "digits": counts[2] / max(1, len(data)),
        "different": len(set(words)) / max(1, len(words)),
        "repeated_lines": 1 - len(set(lines)) / max(1, len(lines)),
        "plain": len(PLAIN.findall(text)) / max(1, len(words)),
        "ends": sum(text.count(c) for c in ".!?") / max(1, len(words)),
    }


def votes(s: dict[str, float]) -> tuple[int, ...]:
    """What each heuristic says: 1 good, -1 junk, 0 nothing."""

    def between(x: float, good: float, junk: float, enough: bool) -> int:
        return NOTHING if not enough else GOOD if x <= good else JUNK if x >= junk else NOTHING

    long, many = s["words"] >= 10, s["words"] >= 40
    odd = (s["symbols"] > 0.06) + (s["capitals"] > 0.1) + (s["different"] < 0.45) + (s["repeated_lines"] > 0.3)
    return (
        between(s["symbols"], -1, 0.08, long),
        between(s["capitals"], -1, 0.2, long),
        between(-s["different"], -2, -0.35, many),
        between(s["repeated_lines"], -1, 0.4, s["lines"] >= 5),
        between(s["ends"], -1, 0.4, s["words"] >= 30),
        between(-s["plain"], -0.85, -0.7, long),
        between(odd, 0, 1, many),
    )


def features(text: str, s: dict[str, float]) -> np.ndarray:
    """Square roots of the shares of hashed trigrams, and hashed bins of the shape."""
    data = np.frombuffer(text.encode(), np.uint8)
    counts = np.zeros(DIM, np.int64)
    for at in range(0, max(0, len(data) - 2), CHUNK):
        b = data[at : at + CHUNK + 2].astype(np.uint32)
        h = (b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA6B)) ^ (b[2:] * np.uint32(0xC2B2AE35))
        counts += np.bincount((h >> np.uint32(16)) % np.uint32(DIM), minlength=DIM)
    out = np.sqrt(counts / max(1, counts.sum())).astype(np.float32)
    for name in ("symbols", "capitals", "digits", "different", "repeated_lines"):
        out[xxhash.xxh3_64_intdigest(f"{name}:{min(9, int(s[name] * 10))}") % DIM] += 0.5
    return out


def estimate(patterns: dict[tuple[int, ...], int], rounds: int = 200) -> tuple[dict[tuple[int, ...], float], np.ndarray, float]:
    """By expectation-maximisation: P(good) of each pattern, P(vote | class) of each heuristic, P(good).

    The second array is [heuristic, class (junk, good), vote (-1, 0, 1)].
    """
    keys = sorted(patterns)
    if not keys:
        return {}, np.zeros((0, 2, 3)), 0.5
    v, n = np.array(keys), np.array([patterns[k] for k in keys], float)
    good = 1 / (1 + np.exp(-v.sum(1).astype(float)))
    one_hot = np.stack([v == JUNK, v == NOTHING, v == GOOD], 2).astype(float)  # pattern, heuristic, vote
    for _ in range(rounds):
        by_class = np.stack([n * (1 - good), n * good])
        table_ = np.einsum("cp,phv->hcv", by_class, one_hot) + 0.1
        table_ /= table_.sum(2, keepdims=True)
        prior = (by_class[1].sum() + 1) / (n.sum() + 2)
        log = np.einsum("phv,hcv->pc", one_hot, np.log(table_)) + np.log([1 - prior, prior])
        new = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -60, 60)))
        done = np.abs(new - good).max() < 1e-9
        good = new
        if done:
            break
    return dict(zip(keys, good.tolist(), strict=True)), table_, float(prior)


def _pattern_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[tuple[int, ...], int] = {}
    for batch in batches:
        for text in batch.column(0):
            p = votes(shape(text.as_py()))
            counts[p] = counts.get(p, 0) + 1
    yield pa.RecordBatch.from_arrays(
        [pa.array([list(p) for p in counts], pa.list_(pa.int32())), pa.array(list(counts.values()), pa.int64())], names=["votes", "n"]
    )


def train(x: np.ndarray, y: np.ndarray, steps: int = 400) -> np.ndarray:
    """Weights, the last one the intercept, of a logistic scorer for soft labels; Adam on the whole sample."""
    x = np.concatenate([x, np.ones((len(x), 1), np.float32)], 1)
    w, m, v = (np.zeros(x.shape[1]) for _ in range(3))
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w.astype(np.float32), -30, 30)))
        g = x.T @ (p - y).astype(np.float32) / max(1, len(x)) + 1e-5 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> tuple[dict, np.ndarray]:
    """(P(good) of each pattern of votes, weights of the scorer)."""
    own = texts(docs, id_col, text_col)
    counted = own.select("text").mapInArrow(_pattern_rows, "votes array<int>, n bigint").groupBy("votes").agg(F.sum("n").alias("n"))
    posterior, _, _ = estimate({tuple(r["votes"]): r["n"] for r in counted.collect()})  # at most 3^7 rows
    chosen = own.select("id").where("id IS NOT NULL").distinct().orderBy(F.xxhash64("id"), "id").limit(sample)
    chosen = F.broadcast(chosen.withColumnRenamed("id", "c_id"))  # at most `sample` ids
    some = own.join(chosen, F.col("id") == F.col("c_id")).select("id", "text")

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shapes = [(t, shape(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([features(t, s).astype(np.float16).tobytes() for t, s in shapes], pa.binary()),
                    pa.array([posterior[votes(s)] for _, s in shapes], pa.float64()),
                ],
                names=["id", "x", "y"],
            )

    def trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        xs, ys = [], []
        for batch in batches:
            xs += [np.frombuffer(b.as_py(), np.float16) for b in batch.column(1)]
            ys += batch.column(2).to_pylist()
        w = train(np.stack(xs).astype(np.float32), np.array(ys)) if xs else np.zeros(DIM + 1)
        yield pa.RecordBatch.from_arrays([pa.array([w.tolist()])], names=["w"])

    kind = dict(own.dtypes)["id"]
    rows = some.mapInArrow(sampled, f"id {kind}, x binary, y double")
    # the sample has a bound, and so one task trains on it; sorted, for the same weights whatever order rows come in
    w = rows.repartition(1).sortWithinPartitions("id", "y").mapInArrow(trained, "w array<double>").first()
    return posterior, np.array(w["w"]) if w else np.zeros(DIM + 1)


def score(docs: DataFrame, posterior: dict, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, votes, weak, score): the votes, the weak label P(good | votes), and the scorer's P(good)."""
    own = texts(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shapes = [(t, shape(t)) for t in batch.column(1).to_pylist()]
            v = [votes(s) for _, s in shapes]
            z = [float(features(t, s) @ weights[:-1] + weights[-1]) for t, s in shapes]
            p = 1 / (1 + np.exp(-np.clip(np.array(z), -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([list(x) for x in v], pa.list_(pa.int32())), pa.array([posterior.get(x, 0.5) for x in v], pa.float64()), pa.array(p, pa.float64())],
                names=["id", "votes", "weak", "score"],
            )

    return own.mapInArrow(run, f"id {dict(own.dtypes)['id']}, votes array<int>, weak double, score double")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality and whether it is kept."""
    docs = table(spark, sf_dir, "documents")
    found = score(docs, *fit(docs))
    return found.select(
        F.col("id").alias("doc_id"),
        F.array_join(F.col("votes").cast("array<string>"), ",").alias("votes"),
        F.col("weak").alias("weak_label"),
        "score",
        (F.col("score") >= KEEP).alias("keep"),
        (F.col("score") >= KEEP).cast("int").alias("predicted"),
    )
