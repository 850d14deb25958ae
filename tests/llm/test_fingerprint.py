import hashlib
import random

import regex
import xxhash

from tests.llm.util import documents, folder, rows
from tilewright.llm import fingerprint as m


def xx(*parts):
    """Spark's xxhash64: each part's hash is the next one's seed."""
    h = 42
    for p in parts:
        data = p.encode() if isinstance(p, str) else (p & (2**64 - 1)).to_bytes(8, "little")
        h = xxhash.xxh64_intdigest(data, seed=h)
    return h


def brute(text):
    low = (text or "").lower()
    words = regex.findall(r"[\p{L}\p{N}]+", low)
    terms = list(zip(words, words[1:])) or ([(words[0],)] if words else None)
    votes = [(xx(*t), sum(map(len, t))) for t in terms] if terms else [(xx(low), 1)]
    all_ = sum(w for _, w in votes)
    bits = 0
    for half, hs in ((1, [(xx(h), w) for h, w in votes]), (0, votes)):
        for k in range(64):
            if 2 * sum(w for h, w in hs if h >> k & 1) > all_:
                bits |= 1 << (k + 64 * half)
    return bits


def given():
    r = random.Random(9)
    vocab = ["".join(r.choices("abcdeéß", k=r.randrange(2, 9))) for _ in range(200)]
    made = [(10 * i + 60, " ".join(r.choices(vocab, k=r.randrange(5, 80)))) for i in range(90)]
    near = [(i + 1, t + " x") for i, t in made[:30]]
    return [(0, None), (3, ""), (5, "One"), (7, "!!! ??"), (9, "a😀b c"), (50, made[0][1]), *made, *near, (2000, "long words " * 60_000)]


def test_against_brute_force(spark, tmp_path):
    docs = sorted(given())
    d = folder(tmp_path, documents=documents(spark, docs).selectExpr("*", "1 AS tie", "2 AS hi", "3 AS n"))
    got = {r["doc_id"]: r for r in rows(m.op2_fingerprint(spark, d))}
    assert len(got) == len(docs)
    fps = {i: brute(t) for i, t in docs}
    for (i, t), (j, u) in zip(docs, docs[1:] + docs[:1]):
        t, u = t or "", u or ""
        k = len(t) // 2
        edited = t[: len(t) - k] + u[:k]
        r = got[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert int(r["fingerprint"], 16) == fps[i] and len(r["fingerprint"]) == 32
        assert int(r["edited_fingerprint"], 16) == brute(edited)
        assert r["near_edited"] == 1 - (fps[i] ^ brute(edited)).bit_count() / 128
        assert r["near_next"] == 1 - (fps[i] ^ fps[j]).bit_count() / 128
        want = sum((fps[i] ^ f).bit_count() <= m.RADIUS for o, f in fps.items() if o != i) if i % 50 == 0 else None
        assert r["n_near"] == want


def test_search_finds_every_pair_within_the_radius(spark):
    r = random.Random(3)
    fps = {r.getrandbits(128) for _ in range(50)}
    for _ in range(600):
        f = r.choice(sorted(fps))
        for b in r.sample(range(128), r.randrange(1, 9)):
            f ^= 1 << b
        fps.add(f)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(f >> 64), signed(f & (2**64 - 1))) for f in fps], "hi bigint, lo bigint")
    got = [((a % 2**64) << 64 | b % 2**64, (c % 2**64) << 64 | d % 2**64) for a, b, c, d in m.search(df, df).collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(f, g) for f in fps for g in fps if (f ^ g).bit_count() <= m.RADIUS}


def test_repeated_rows_null_ids_and_empty_table(spark, tmp_path):
    d = folder(tmp_path, documents=documents(spark, [(1, "b c d"), (1, "b c d"), (1, "a"), (2, "x y"), (None, "no id")]))
    got = rows(m.op2_fingerprint(spark, d))
    assert sorted((str(r["doc_id"]), r["n_chars"]) for r in got) == [("1", 1), ("1", 5), ("1", 5), ("2", 3), ("None", 5)]
    assert {r["edited_sha256"] for r in got if r["doc_id"] == 2} == {hashlib.sha256(b"x a"[:2] + b"a").hexdigest()}
    assert [(r["near_edited"], r["near_next"]) for r in got if r["doc_id"] is None] == [(1.0, 1.0)]
    assert rows(m.fingerprints(documents(spark, []))) == []
