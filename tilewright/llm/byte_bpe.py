"""Byte-level BPE encoding and decoding by a global distinct-word shuffle.

Texts are cut into pre-tokens. A block of consecutive documents keeps its
pre-tokens as two columns: the distinct words, and for every position the
number of its word. Words are shuffled by their hash, so that all blocks'
copies of a word meet in one task, which encodes it once; their ids go back to
the block by a second shuffle, where they are joined to the positions and put
together again in order. Only words, numbers and ids move: no text is shuffled,
and no task holds more than a block of documents and a bounded memo of words.

A block's key is a digest of all that it holds. Words and positions come from
two passes over the same scan; should those ever deal the rows out differently,
the keys don't meet and the job fails instead of giving wrong ids.

Ranks are read by the driver (about 50,000 entries, a fixed size) and broadcast.

Defined results: null and empty texts have no tokens; rows that repeat give
rows that repeat; a text longer than a block is a block of its own; an empty
table gives no rows. Columns other than id and text are ignored. Special tokens
have no meaning: their strings are ordinary text.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import regex
import tiktoken
import xxhash
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm.common import table, texts

#: Characters of text in a block, and words a task remembers; they bound memory and change no result.
BLOCK_CHARS, MEMO_WORDS = 4 << 20, 1 << 18
#: At most so many parts of the distinct words.
MOST_PARTS = 1024


def parse_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}


@functools.lru_cache(maxsize=2)
def _encoder(data: bytes, pattern: str) -> Callable[[bytes], list[int]]:
    """The encoder of one pre-token."""
    return tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=parse_ranks(data), special_tokens={})._encode_single_piece


def _zip(*arrays: np.ndarray | bytes) -> bytes:
    """Arrays one after another, each after its length in bytes, compressed."""
    parts = [a if isinstance(a, bytes) else a.tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(len(p).to_bytes(8, "little") + p for p in parts))


def _unzip(data: bytes) -> list[bytes]:
    raw, out, at = zstandard.ZstdDecompressor().decompress(data), [], 0
    while at < len(raw):
        size = int.from_bytes(raw[at : at + 8], "little")
        out.append(raw[at + 8 : at + 8 + size])
        at += 8 + size
    return out


def _u4(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u4")


def _sizes(items: list) -> np.ndarray:
    return np.fromiter(map(len, items), "<u4", len(items))


class _Numbers(dict):
    """A number for each word, in the order in which words are first met."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


class _Block:
    """Consecutive documents: their ids, their pre-tokens as numbers, and the distinct words."""

    def __init__(self) -> None:
        self.ids: list[Any] = []
        self.docs: list[np.ndarray] = []
        self.numbers = _Numbers()
        self.chars = 0
        self.digest = xxhash.xxh3_128()

    def add(self, doc_id: Any, text: str, words: list[str]) -> None:
        self.ids.append(doc_id)
        self.docs.append(np.fromiter(map(self.numbers.__getitem__, words), "<u4", len(words)))
        self.chars += len(text)
        self.digest.update(f"{doc_id!r}:{len(text)}:".encode())
        self.digest.update(text.encode())

    def key(self) -> bytes:
        return self.digest.digest()

    def ranked(self, parts: int) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The distinct words, the most frequent first; the part of each; the word at each position as its rank."""
        at = np.concatenate(self.docs)
        order = np.argsort(-np.bincount(at, minlength=len(self.numbers)), kind="stable")
        rank = np.empty(len(order), "<u4")
        rank[order] = np.arange(len(order))
        words = list(self.numbers)
        own = [words[i] for i in order.tolist()]
        return own, np.fromiter((xxhash.xxh3_64_intdigest(w) % parts for w in own), "<u2", len(own)), rank[at]


def _blocks(batches: Iterator[pa.RecordBatch], pattern: str) -> Iterator[_Block]:
    find, block = regex.compile(pattern).findall, _Block()
    for batch in batches:
        for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
            own = text.as_py()
            block.add(doc_id.as_py(), own, find(own))
            if block.chars >= BLOCK_CHARS:
                yield block
                block = _Block()
    if block.ids:
        yield block


def _word_rows(pattern: str, parts: int) -> Callable:
    """(block, part, data): a block's distinct words that belong to a part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, pattern):
            words, part, _ = block.ranked(parts)
            by_part: dict[int, list[bytes]] = {}
            for word, p in zip(words, part.tolist(), strict=True):
                by_part.setdefault(p, []).append(word.encode())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([block.key()] * len(by_part), pa.binary()),
                    pa.array(list(by_part), pa.int32()),
                    pa.array([_zip(_sizes(ws), b"".join(ws)) for ws in by_part.values()], pa.binary()),
                ],
                names=["block", "part", "data"],
            )

    return run


def _position_rows(pattern: str, parts: int) -> Callable:
    """(block, part -1, data, ids): the word number at each position, and each word's part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, pattern):
            _, part, at = block.ranked(parts)
            planes = at.view(np.uint8).reshape(-1, 4).T  # bytes of one weight together compress better
            data = _zip(_sizes(block.docs), part, np.ascontiguousarray(planes))
            yield pa.RecordBatch.from_arrays(
                [pa.array([block.key()], pa.binary()), pa.array([-1], pa.int32()), pa.array([data], pa.binary()), pa.array([block.ids])],
                names=["block", "part", "data", "ids"],
            )

    return run


def _encode_words(ranks: Broadcast, pattern: str) -> Callable:
    """(block, part, data): words replaced by their ids, each distinct word of the task encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, memo = _encoder(ranks.value, pattern), {}
        for batch in batches:
            out = []
            for packed in batch.column(2):
                sizes, raw = _unzip(packed.as_py())
                ids, at = [], 0
                for size in _u4(sizes).tolist():
                    word = raw[at : at + size]
                    at += size
                    if (own := memo.get(word)) is None:
                        if len(memo) >= MEMO_WORDS:
                            memo.clear()
                        own = memo[word] = np.array(encode(word), "<u4").tobytes()
                    ids.append(own)
                flat = np.frombuffer(b"".join(ids), np.uint8).reshape(-1, 4).T
                out.append(_zip(_sizes(ids) // 4, np.ascontiguousarray(flat)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["block", "part", "data"])

    return run


def _from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1)


def _gather(values: np.ndarray, counts: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The runs of ``values`` numbered ``which``, in a row; run i has ``counts[i]`` values."""
    starts = np.cumsum(counts, dtype=np.int64) - counts
    sizes = counts[which].astype(np.int64)
    ends = np.cumsum(sizes)
    return values[np.repeat(starts[which] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]


def _reassemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, ids as little-endian unsigned 32-bit integers), from rows sorted by (block, part)."""
    key, waiting, coded = None, [], {}

    def done() -> Iterator[pa.RecordBatch]:
        for own, data in waiting:
            sizes, part, planes = _unzip(data)
            sizes, part, at = _u4(sizes), np.frombuffer(part, "<u2"), _from_planes(planes)
            order = np.argsort(part, kind="stable")
            runs = [coded[p] for p in np.unique(part).tolist()]  # a part that didn't come raises KeyError
            counts = np.concatenate([c for c, _ in runs]) if runs else np.zeros(0, "<u4")
            if len(counts) != len(part):
                raise ValueError("the words of a block and their ids don't agree")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            values = np.concatenate([v for _, v in runs]) if runs else np.zeros(0, "<u4")
            which = place[at]
            flat = _gather(values, counts, which).astype("<u4").tobytes()
            ends = np.concatenate([[0], np.cumsum(counts[which], dtype=np.int64)])[np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])] * 4
            texts = [flat[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            for k in range(0, len(texts), 1024):
                yield pa.RecordBatch.from_arrays([own[k : k + 1024], pa.array(texts[k : k + 1024], pa.binary())], names=["id", "ids"])

    for batch in batches:
        for block, part, data, ids in zip(*batch.columns, strict=True):
            if (b := block.as_py()) != key:
                yield from done()
                key, waiting, coded = b, [], {}
            if (p := part.as_py()) < 0:
                waiting.append((ids.values, data.as_py()))
            elif p not in coded:
                counts, planes = _unzip(data.as_py())
                coded[p] = _u4(counts), _from_planes(planes)
    yield from done()


def encode(docs: DataFrame, ranks: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids binary): each row's token ids as little-endian unsigned 32-bit integers.

    ``ranks`` is the content of a rank file, ``pattern`` cuts the pre-tokens.
    """
    spark = docs.sparkSession
    own = texts(docs, id_col, text_col)
    id_type = dict(own.dtypes)["id"]
    parts = min(MOST_PARTS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    shared = spark.sparkContext.broadcast(ranks)
    words = own.mapInArrow(_word_rows(pattern, parts), "block binary, part int, data binary")
    coded = words.repartition(parts, "part").mapInArrow(_encode_words(shared, pattern), "block binary, part int, data binary")
    places = own.mapInArrow(_position_rows(pattern, parts), f"block binary, part int, data binary, ids array<{id_type}>")
    rows = places.unionByName(coded, allowMissingColumns=True)
    return rows.repartition("block").sortWithinPartitions("block", "part").mapInArrow(_reassemble, f"id {id_type}, ids binary")


def decode(tokens: DataFrame, ranks: bytes, keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """The rows of ``tokens`` with the column ``decoded``: the bytes that the ids stand for, joined from the token-byte table."""
    own = tokens.select(*keep, "ids")
    shared = tokens.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_id = {i: b for b, i in parse_ranks(shared.value).items()}
        of = by_id.__getitem__
        for batch in batches:
            texts = [b"".join(map(of, _u4(ids.as_py()).tolist())) for ids in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], names=[*batch.schema.names, "decoded"])

    types = dict(own.dtypes)
    return own.mapInArrow(run, ", ".join(f"{c} {types[c]}" for c in own.columns) + ", decoded binary")


def encode_and_decode(docs: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) by the public multilingual vocabulary."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = f.read()
    both = decode(encode(docs, ranks, public_tokenizers.PATTERN), ranks)
    return both.select(
        F.col("id").alias("doc_id"),
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes and decodes every document."""
    return encode_and_decode(table(spark, sf_dir, "documents"))


def encode_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the token counts and digests of all documents."""
    return encode_and_decode(docs)
