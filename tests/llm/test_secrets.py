import hashlib
import math
import random
import re

from tests.llm.util import documents, folder, rows
from tilewright.llm import secrets as m

ASSIGN = re.compile(r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]+")
RANDOM = "q7Rk2VxT9zLw4NpB8sYd1HgJ"


def brute_base(text):
    text = text or ""
    out = [(x.start(), 0, "assign", x.end()) for x in ASSIGN.finditer(text) if len(x[2]) >= 8]
    out += [(x.start(), 1, "access", x.end()) for x in ACCESS.finditer(text) if len(x[0]) >= 16]
    out += [(x.start(), 2, "hex", x.end()) for x in HEX.finditer(text) if len(x[0]) >= 32]
    return sorted(out)


def given():
    r = random.Random(6)
    made = []
    parts = ["token", "secret", "PassWord", "api_key", "apikey", "=", ":", " ", "'", '"', "abcdefgh", "AKIA", "ABCDEFGHIJKL", "0" * 31, "ab", "é", "😀", "\n", "."]
    for i in range(300):
        made.append((100 + i, "".join(r.choices(parts, k=r.randrange(1, 30)))))
    words = " ".join("".join(r.choices(["tion", "the", "an", "er", "ment"], k=4)) for _ in range(3000))
    return [
        (0, None), (1, ""), (2, "token: secret: abcdefghijk"), (3, "token=secret=abcdefgh"), (4, "ſecret=abcdefghij"),
        (5, "é😀 token = 'abcd1234' AKIA1234567890ABCD " + "0f" * 20), (6, words), (7, f"so {RANDOM} it is"),
        (8, "x" * 200_000 + f" {RANDOM} " + "password=abcdefgh1 " * 5000), (9, "thementtion12thementtionanertion"), (5, None), *made,
    ]


def test_base_spans_against_brute_force(spark, tmp_path):
    d = folder(tmp_path, documents=documents(spark, given()).selectExpr("*", "1 AS base", "2 AS spans", "3 AS id"))
    want = sorted(
        (i, *(sum(k == kind for _, _, k, _ in b) for kind in ("assign", "access", "hex")), hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, k, e in b).encode()).hexdigest())
        for i, t in given()
        for b in [brute_base(t)]
    )
    got = rows(m.op7_secret_scan(spark, d))
    assert sorted((r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in got) == want
    texts = dict(given())
    for r in got:  # base spans stay, and others don't overlap them
        spans = [s.split(":") for s in r["spans"].split(",") if s]
        assert spans == sorted(spans, key=lambda s: int(s[1]))
    by = {r["doc_id"]: [s for s in r["spans"].split(",") if s.startswith("random")] for r in got if r["doc_id"] != 5}
    assert by[7] == ["random:3:27"] and by[6] == by[9] == []
    assert [texts[8][int(s.split(":")[1]) : int(s.split(":")[2])] for s in by[8]] == [RANDOM]


def test_ratio_is_the_sum_over_pairs(spark):
    table = m.log_ratios({1: 5, 68: 2}, {1: 1, 70: 9})
    (got,) = spark.createDataFrame([("AB+z9",)], "t string").select(m.ratio(m.F.col("t"), table).alias("r")).collect()
    code = [m.KEY_CHARS.index(c) for c in "AB+z9"]
    assert abs(got["r"] - sum(table[a * 67 + b] for a, b in zip(code, code[1:]))) < 1e-5


def test_samples_are_told_apart(spark):
    df = documents(spark, given())
    table = m.fit(df)
    fresh = m.random_strings(spark, m.MADE + 200).subtract(m.random_strings(spark))
    caught = fresh.select(m.ratio(m.F.col("token"), table).alias("r")).where(f"r > {m.RATIO}").count()
    assert caught > 0.95 * fresh.count()


def test_stage_redacts(spark):
    df = documents(spark, given()).drop("n_chars").selectExpr("*", "char_length(text) AS n_chars")
    out = rows(m.redact_secrets(spark, df, ""))
    assert len(out) == len(given())
    by = {r["doc_id"]: r for r in out if r["doc_id"] != 5}
    assert by[7]["text"] == "so [SECRET] it is" and by[7]["n_chars"] == 17
    assert by[6]["text"] == dict(given())[6] and by[0]["text"] is None
    assert all(not brute_base(r["text"]) or "SECRET" in r["text"] for r in out)


def test_redacts_overlapping_spans_against_brute_force(spark):
    r = random.Random(7)
    given = []
    for i in range(60):
        text = "".join(r.choices("abé😀 \n", k=r.choice([0, 5, 300, 9000])))
        cuts = [sorted((r.randrange(len(text) + 1), r.randrange(len(text) + 1))) for _ in range(r.choice([0, 1, 3, 200]))]
        given.append((i, text, sorted((a, min(b, a + r.choice([3, 4000]))) for a, b in cuts if a < b)))

    def brute(text, spans):
        merged = []
        for a, b in spans:
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        for a, b in reversed(merged):
            text = f"{text[:a]}#{text[b:]}"
        return text

    df = spark.createDataFrame(given, "id bigint, text string, spans array<struct<first: bigint, end: bigint>>")
    got = dict(df.select("id", m.redact(m.F.col("text"), m.F.col("spans"), "#")).collect())
    assert got == {i: brute(t, spans) for i, t, spans in given}


def brute_candidates(text):
    """Runs of 20 or more key characters with a letter and a digit, whole ones only."""
    runs = re.finditer(r"[A-Za-z0-9+/_=-]+", text or "")
    return [(x.start(), x.end()) for x in runs if len(x[0]) >= 20 and re.search(r"[A-Za-z]", x[0]) and re.search(r"[0-9]", x[0])]


def test_added_spans_against_brute_force(spark, tmp_path):
    """All spans of the query: base ones, and candidates apart from them that the two models call random."""
    docs = given() + [(50 + i, " ".join(t)) for i, t in enumerate([[f"x{RANDOM}", "a1" * 12], ["Zk9" * 9 + "=", "snake_case_name_1234567890"], [RANDOM * 30]])]
    d = folder(tmp_path, documents=documents(spark, docs))
    n = len(m.KEY_CHARS)
    made = [t["token"] for t in rows(m.random_strings(spark))]
    ordinary = []
    for _, t in docs:
        text = t or ""
        at, kept = 0, ""
        for a, _, _, b in brute_base(text):
            if a > at or not at and not kept:
                kept += text[at:a] + " "
            at = max(at, b)
        for x in re.findall(r"[A-Za-z0-9+/_=-]{12,}", kept + text[at:]):
            if not brute_candidates(x):
                ordinary.append(x)

    def model(tokens):
        pairs = [[0] * n for _ in range(n)]
        for t in tokens:
            for a, b in zip(t, t[1:]):
                pairs[m.KEY_CHARS.index(a)][m.KEY_CHARS.index(b)] += 1
        ends = [sum(row[b] for row in pairs) for b in range(n)]
        alone = [(e + m.PRIOR) / (sum(ends) + m.PRIOR * n) for e in ends]
        return [[math.log((pairs[a][b] + m.BACK * alone[b]) / (sum(pairs[a]) + m.BACK)) for b in range(n)] for a in range(n)]

    random_model, ordinary_model = model(made), model(ordinary)

    def ratio(token):
        code = [m.KEY_CHARS.index(c) for c in token]
        return sum(random_model[a][b] - ordinary_model[a][b] for a, b in zip(code, code[1:]))

    def spans(text):
        base = brute_base(text)
        more = [(a, 3, "random", b) for a, b in brute_candidates(text) if not any(s < b and a < e for s, _, _, e in base) and ratio(text[a:b]) > m.RATIO]
        return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(base + more))

    got = sorted((r["doc_id"], r["spans"]) for r in rows(m.op7_secret_scan(spark, d)))
    assert got == sorted((i, spans(t)) for i, t in docs)
    assert sum("random" in s for _, s in got) >= 4


def test_empty_table(spark):
    df = documents(spark, [])
    assert rows(m.scan(df, m.fit(df))) == [] and rows(m.redact_secrets(spark, df, "")) == []
