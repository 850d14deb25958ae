import hashlib
import random

import numpy as np
import public_tokenizers
import regex
import tiktoken

from tests.llm.util import documents, folder, rows
from tilewright.llm import byte_bpe as m

RANKS = open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb").read()
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=m.parse_ranks(RANKS), special_tokens={})


def awkward():
    r = random.Random(1)
    alphabet = "ab C'sé\n\t   \u0085\x1c\x1f字😀,.!12½٣́​'llre<|endoftext|>"
    made = [(100 + i, "".join(r.choices(alphabet, k=r.randrange(60)))) for i in range(300)]
    return [(0, None), (1, ""), (2, "   x  "), (3, "don't we'll"), (4, "x" * 30_000), (5, "Ünï çode " * 20_000), (5, "again"), (5, "again"), *made]


def want(text):
    ids = LIBRARY.encode_ordinary(text or "")
    raw = np.array(ids, "<u4").tobytes()
    return len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_same_ids_as_the_library(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(m, "BLOCK_CHARS", 5_000)
    given = awkward()
    d = folder(tmp_path, documents=documents(spark, given).selectExpr("*", "1 AS block", "2 AS ids", "3 AS part"))
    got = sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows(m.op5_byte_bpe(spark, d)))
    assert got == sorted((i, *want(t)) for i, t in given)


def test_repeated_blocks_and_a_small_memo(spark, monkeypatch):
    monkeypatch.setattr(m, "MEMO_WORDS", 3)
    given = [(i % 3, "the same words in each block") for i in range(6)]
    df = documents(spark, given).repartition(6)
    got = m.decode(m.encode(df, RANKS, public_tokenizers.PATTERN), RANKS)
    assert sorted((r["id"], bytes(r["decoded"]).decode()) for r in rows(got)) == sorted(given)


def test_other_ids_and_empty_table(spark):
    df = spark.createDataFrame([("a", "x y"), (None, "z")], "doc_id string, text string")
    got = {r["id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in rows(m.encode(df, RANKS, public_tokenizers.PATTERN))}
    assert got == {"a": LIBRARY.encode_ordinary("x y"), None: LIBRARY.encode_ordinary("z")}
    assert rows(m.encode_and_decode(documents(spark, []))) == []
    assert [r["n_tokens"] for r in rows(m.encode_and_decode(documents(spark, [(1, None), (2, "")])))] == [0, 0]


def test_words_are_cut_as_the_library_cuts_them():
    find = regex.compile(public_tokenizers.PATTERN).findall
    for _, t in awkward():
        assert [i for w in find(t or "") for i in LIBRARY._encode_single_piece(w)] == LIBRARY.encode_ordinary(t or "")
