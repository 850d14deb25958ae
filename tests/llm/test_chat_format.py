import hashlib

from tests.llm.util import folder, rows
from tilewright.llm.chat_format import FORGED, format_conversations, op3_chat_format, trained_text

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
TURNS = [
    (1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 2, "assistant", "c<|im_cont|>"), (1, 3, "user", ""),
    (2, 0, "assistant", r"x <\| <\\| <|im_end|>"), (2, 1, None, None),
    (3, 0, "user", "same"), (3, 0, "user", "same"), (3, None, "user", "no turn"),
    (None, 0, "assistant", "é" * 50_000 + "<"), (4, 0, "as<|im_sep|>sistant", "|>\n<|im_start|>"),
]


def digest(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_reads_back_every_turn(spark, tmp_path):
    d = folder(tmp_path, conversations=spark.createDataFrame(TURNS, SCHEMA))
    got = {r["conv_id"]: r for r in rows(op3_chat_format(spark, d))}
    given = {}
    for c, t, r, x in [*TURNS, (-1, 0, "user", FORGED), (-1, 1, "assistant", FORGED)]:
        given.setdefault(c, []).append((-1 if t is None else t, r or "", x or ""))
    assert set(got) == set(given)
    for c, turns in given.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == digest("".join(f"{r}\n{x}\n" for _, r, x in turns))
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), digest(loss))


def test_merges_adjacent_turns_of_a_role(spark):
    df = spark.createDataFrame(TURNS[:4], SCHEMA).selectExpr("*", "'x' AS turns", "1 AS starts", "2 AS formatted")
    (got,) = rows(format_conversations(df))
    assert got["formatted"] == (
        "<|im_start|>user<|im_sep|>a<|im_end|>\n<|im_start|>assistant<|im_sep|>b<|im_cont|>c<\\|im_cont|><|im_end|>\n"
        "<|im_start|>user<|im_sep|><|im_end|>\n"
    )
    assert [got["formatted"][s["first"] : s["end"]] for s in got["loss"]] == ["b", "c<\\|im_cont|>"]


def test_a_given_conversation_of_the_forged_ones_id_stays_apart(spark, tmp_path):
    d = folder(tmp_path, conversations=spark.createDataFrame([(-1, 0, "assistant", "mine")], SCHEMA))
    got = sorted((r["n_turns"], r["loss_chars"]) for r in rows(op3_chat_format(spark, d)))
    assert got == [(1, 4), (2, len(FORGED))]


def test_mask_of_a_long_conversation(spark):
    turns = [(1, i, "assistant" if i % 3 else "user", f"é😀{i}<|" * (i % 200)) for i in range(1500)]
    (got,) = rows(format_conversations(spark.createDataFrame(turns, SCHEMA)))
    want = [t.replace("<|", "<\\|") for _, _, role, t in turns if role == "assistant"]
    assert [got["formatted"][s["first"] : s["end"]] for s in got["loss"]] == want
    df = format_conversations(spark.createDataFrame(turns, SCHEMA))
    (read,) = rows(df.select(trained_text(df.formatted, df.loss).alias("t")))
    assert read["t"] == "".join(t for _, _, role, t in turns if role == "assistant")


def test_empty_table(spark):
    assert rows(format_conversations(spark.createDataFrame([], SCHEMA))) == []
