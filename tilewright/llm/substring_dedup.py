"""Substring dedup by sliding sentence spans.

A text is cut into sentences at line ends and after ``.``, ``!`` or ``?``
before white space; a sentence of more than ``LONG`` words is cut further
where two neighbouring words hash so, which depends on those words alone and
so falls alike in every copy. From every sentence a run goes on for ``RUN``
consecutive sentences, and further until it has ``LEAST_WORDS`` words, so runs
of short lines begin and end alike in every copy too; a text of fewer than
``RUN`` sentences is one run. The words of each run are hashed (lower-cased,
white space made even) and joined over all documents. The first run of those
with the same words, by (id, text's hash, place), stays; the sentences that any
other covers are removed.

Texts are parsed once; each row's sentence starts and run hashes are written to
the checkpoint folder. Runs are first counted by 64 bits of their hash, a
pre-aggregated shuffle; those met more than once are then told apart by 96 bits
(two runs of different words share them with a probability of 2^-96 a pair: one
in ten million for a corpus of 10^11 runs). Hashes with more than one in ``HOT`` of all runs, of which there are
fewer than ``HOT``, are joined by broadcast, so a run that a third of all
documents share stays in the tasks that read it; all others by a shuffle. No
group of runs is collected; what is collected is a document's own places.

What stays of a repeated passage is at most the end of a sentence at its
beginning and, at its end, sentences of fewer than ``LEAST_WORDS`` words.
``find_repeats`` takes ``least_words``; with 1, any ``RUN`` sentences repeat.

Defined results: null and empty texts have no sentences and stay as they are;
rows that repeat both id and text count as one document, and texts that share
an id as documents of their own; rows with a null id take no part and stay;
empty tables give no rows. Columns other than id and text are ignored by
``find_repeats``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm.common import cut, table, text_hash, texts, whole_text

RUN, LEAST_WORDS, LONG, CUT_EVERY = 2, 24, 24, 8
#: A hash is joined by broadcast if more than one run in so many has it.
HOT = 1000
BOUNDARY = re.compile(r"(?<=[.!?])\s+|\s*\n\s*")
WORD = re.compile(r"\S+\s*")


def sentences(text: str) -> list[tuple[int, list[str]]]:
    """(start, lower-cased words) of each sentence; a sentence ends where the next one starts."""
    out: list[tuple[int, list[str]]] = []
    at = 0
    for end in [*(m.end() for m in BOUNDARY.finditer(text)), len(text)]:
        words = text[at:end].lower().split()
        if len(words) > LONG:
            starts = [m.start() for m in WORD.finditer(text, at, end)]
            begin = 0
            for i in range(1, len(starts)):
                if i - begin > 1 and xxhash.xxh3_64_intdigest(f"{words[i - 1]} {words[i]}") % CUT_EVERY == 0:
                    out.append((at if begin == 0 else starts[begin], words[begin:i]))
                    begin = i
            out.append((at if begin == 0 else starts[begin], words[begin:]))
        elif words:
            out.append((at, words))
        at = end
    if out:
        out[0] = (0, out[0][1])
    return out


def runs(own: list[list[str]], least_words: int = LEAST_WORDS) -> list[int]:
    """The end of the run that begins at each sentence; sentences near the end of the text begin none."""
    sizes, out, end, words = list(map(len, own)), [], 0, 0
    for i in range(len(own)):
        while end < len(own) and (words < least_words or end - i < RUN):
            words += sizes[end]
            end += 1
        if words < least_words or end - i < min(RUN, len(own)):
            break
        out.append(end)
        words -= sizes[i]
    return out


def _parsed(least_words: int) -> Callable:
    """(id, th, starts, h, g, size): where sentences start; 128 bits of the run from each, and its number of sentences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                starts, sizes, digests = [], [], []
                for text in part.column(1).to_pylist():
                    own = sentences(text)
                    lines = [" ".join(words) for _, words in own]
                    ends = runs([words for _, words in own], least_words)
                    starts.append([s for s, _ in own])
                    sizes.append([end - i for i, end in enumerate(ends)])
                    digests.extend(xxhash.xxh3_128_digest("\n".join(lines[i:end])) for i, end in enumerate(ends))
                halves = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)
                offsets = pa.array(np.cumsum([0, *map(len, sizes)]), pa.int32())
                h, g = (pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(halves[:, i]))) for i in (0, 1))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(starts, pa.list_(pa.int32())), h, g, pa.array(sizes, pa.list_(pa.int32()))],
                    names=["id", "th", "starts", "h", "g", "size"],
                )

    return run


def _cut_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the sentences of the runs that begin at their ``places``."""
    kind = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        counts, gone, kept, spans = [], [], [], []
        for text, starts, size, places in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3, 4)), strict=True):
            counts.append(len(sentences(text or "") if starts is None else starts))
            if not places:
                gone.append(0), kept.append(text), spans.append([])
                continue
            ends = [*starts[1:], len(text)]
            drop = sorted({i for p in places for i in range(p, p + size[p])})
            own: list[list[int]] = []
            for i in drop:
                if own and own[-1][1] == starts[i]:
                    own[-1][1] = ends[i]
                else:
                    own.append([starts[i], ends[i]])
            edges = [0, *(x for span in own for x in span), len(text)]
            gone.append(len(drop))
            kept.append("".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            spans.append([{"first": a, "end": b} for a, b in own])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string()), pa.array(spans, kind)],
            names=["id", "n_sentences", "n_removed", "text", "removed"],
        )


def _repeated_places(parsed: DataFrame, hot: int) -> DataFrame:
    """(p_id, p_th, places array<int>): where the runs of each text begin that aren't the first of their words."""
    # a run is a row of four numbers; tag is 32 more bits of its hash, and its place
    tag = F.col("r.g").bitwiseAND(F.lit(-1 << 32)).bitwiseOR(F.col("place").cast("bigint"))
    every = parsed.select("id", "th", F.posexplode(F.arrays_zip("h", "g")).alias("place", "r")).select("id", "th", F.col("r.h").alias("h"), tag.alias("tag"))
    total = parsed.agg(F.sum(F.size("h"))).first()[0] or 0
    counts = cut(every.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").withColumnRenamed("h", "r_h"))
    often = F.col("n") > total / hot
    crowded = F.broadcast(counts.where(often).select("r_h"))  # fewer than `hot` rows
    few = counts.where(~often).select("r_h")
    same = F.col("h") == F.col("r_h")
    met = every.join(crowded, same, "left_semi").withColumn("hot", F.lit(True)).unionByName(
        every.join(crowded, same, "left_anti").join(few, same, "left_semi").withColumn("hot", F.lit(False))
    )
    place = F.col("tag").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")
    met = cut(met.select("hot", "h", F.shiftright("tag", 32).alias("g"), "id", "th", place.alias("place")))
    own = F.struct("id", "th", "place")
    firsts = met.groupBy("h", "g", "hot").agg(F.min(own).alias("first"))
    firsts = firsts.select(F.col("h").alias("f_h"), F.col("g").alias("f_g"), F.col("hot").alias("f_hot"), "first")
    join = (F.col("h") == F.col("f_h")) & (F.col("g") == F.col("f_g"))
    later = met.where("hot").join(F.broadcast(firsts.where("f_hot")), join)  # a hash has one row for each of its words: `hot` rows or so
    later = later.unionByName(met.where("NOT hot").join(firsts.where("NOT f_hot"), join)).where(own != F.col("first"))
    places = later.groupBy("id", "th").agg(F.collect_set("place").alias("places"))
    return places.select(F.col("id").alias("p_id"), F.col("th").alias("p_th"), "places")


def find_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS, hot: int = HOT
) -> DataFrame:
    """(id, n_sentences, n_removed, text, removed array<struct<first, end>>): each row's text without repeated spans."""
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), text_hash(text_col).alias("th"))
    kind = dict(own.dtypes)["id"]
    out = f"id {kind}, th bigint, starts array<int>, h array<bigint>, g array<bigint>, size array<int>"
    parsed = cut(texts(own.where("id IS NOT NULL"), "id", "text").withColumn("th", text_hash("text")).mapInArrow(_parsed(least_words), out))
    places = _repeated_places(parsed, hot)
    named = parsed.groupBy("id", "th").agg(F.first("starts").alias("starts"), F.first("size").alias("size"))  # rows that repeat have the same
    found = named.join(places, (F.col("id") == F.col("p_id")) & (F.col("th") == F.col("p_th")), "left")
    found = found.select(F.col("id").alias("f_id"), F.col("th").alias("f_th"), "starts", "size", "places")
    met = own.where("id IS NOT NULL").join(found, (F.col("id") == F.col("f_id")) & (F.col("th") == F.col("f_th")))
    met = met.select("id", "text", "starts", "size", "places")
    none = F.lit(None).cast("array<int>")
    unnamed = own.where("id IS NULL").select("id", "text", none.alias("starts"), none.alias("size"), none.alias("places"))
    out = f"id {kind}, n_sentences bigint, n_removed bigint, text string, removed array<struct<first: int, end: int>>"
    return met.unionByName(unnamed).mapInArrow(_cut_rows, out)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages that stand elsewhere before."""
    found = find_repeats(table(spark, sf_dir, "documents"))
    spans = F.transform("removed", lambda s: F.concat_ws(":", s["first"].cast("string"), s["end"].cast("string")))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_sentences",
        "n_removed",
        F.char_length(whole_text("text")).cast("bigint").alias("kept_chars"),
        F.sha2(whole_text("text"), 256).alias("kept_sha256"),
        F.array_join(spans, ",").alias("removed"),
    )
