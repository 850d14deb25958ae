import hashlib
import re
from string import ascii_lowercase, ascii_uppercase

from tests.llm.util import documents, folder, rows
from tilewright.llm import decontaminate as m

LOW = str.maketrans(ascii_uppercase, ascii_lowercase)
ITEM = "Alpha beta, gamma delta Épsilon zeta eta theta iota kappa lambda mu."
ITEMS = [(1, ITEM), (2, "Short item É"), (3, ""), (4, None), (5, ITEM), (10, "one two three four five six seven eight nine ten eleven")]
TEXTS = [
    (1, "x " + ITEM.upper().replace("É", "É") + " y"), (2, "short—ITEM é short, item É!"), (3, None), (4, ""),
    (5, "one two three four five six seven eight nine"), (6, "so one-two three four five six seven eight nine ten, one two"),
    (7, "clean words only here"), (7, "clean words only here"), (8, ("short item É " + "pad " * 9) * 3000), (None, ITEM),
]


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def brute(text, items):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        iw = words(t)
        k = min(10, len(iw))
        grams = {tuple(iw[i : i + k]) for i in range(len(iw) - k + 1)} if k else set()
        for i in range(len(w) - k + 1 if k else 0):
            if tuple(w[i : i + k]) in grams:
                hit.update(range(i, i + k))
                found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def test_against_brute_force(spark, tmp_path, monkeypatch):
    bench = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    d = folder(tmp_path, documents=documents(spark, TEXTS), benchmark=bench)
    want = sorted((str(i), *brute(t, ITEMS)) for i, t in TEXTS)
    names = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    for rows_allowed in (m.BROADCAST_ROWS, 0):  # the broadcast and the shuffled hash set
        monkeypatch.setattr(m, "BROADCAST_ROWS", rows_allowed)
        got = rows(m.op10_decontaminate(spark, d))
        assert sorted((str(r["doc_id"]), *(r[n] for n in names)) for r in got) == want


def test_stage_keeps_clean_documents(spark, tmp_path):
    d = folder(tmp_path, benchmark=spark.createDataFrame(ITEMS, "item_id bigint, text string"))
    kept = m.drop_contaminated(spark, documents(spark, TEXTS), d)
    assert sorted(r["doc_id"] for r in rows(kept)) == [3, 4, 5, 7, 7]


def test_stage_knows_rows_by_id_and_text(spark, tmp_path):
    d = folder(tmp_path, benchmark=spark.createDataFrame([*ITEMS, (None, "an item without any id")], "item_id bigint, text string"))
    given = [(1, ITEM), (1, "clean words only here"), (None, ITEM), (None, "clean words only here"), (None, None), (2, "so an item without any id is"), (2, "")]
    kept = sorted(((str(r["doc_id"]), r["text"]) for r in rows(m.drop_contaminated(spark, documents(spark, given), d))), key=str)
    assert kept == sorted([("1", "clean words only here"), ("None", "clean words only here"), ("None", None), ("2", "")], key=str)


def test_items_without_an_id_are_one(spark):
    bench = spark.createDataFrame([(None, "an item without any id"), (3, "an item without any id")], "item_id bigint, text string")
    (got,) = rows(m.find_contamination(documents(spark, [(2, "so an item without any id is")]), bench))
    assert got["items"] == ["", "3"] and got["hit_words"] == [1, 2, 3, 4, 5]


def test_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], "item_id bigint, text string")
    docs = documents(spark, TEXTS).selectExpr("*", "1 AS h", "2 AS pos", "3 AS w")
    assert all(not r["hit_words"] and not r["items"] for r in rows(m.find_contamination(docs, none)))
    bench = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert rows(m.find_contamination(documents(spark, []), bench)) == []
