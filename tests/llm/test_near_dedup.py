import random
import re

import numpy as np
import xxhash

from tests.llm.util import documents, rows
from tilewright.llm import near_dedup as m


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(nodes):
    """nodes: (id, fp) pairs."""
    root = {i: i for i, _ in nodes}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, f) in enumerate(nodes):
        for j, g in nodes[:k]:
            if (f ^ g).bit_count() <= 3:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i, _ in nodes}


def brute_similar(docs, words=5, least=0.8):
    """docs: (id, text); the least id of each row's component, of links by shared shingles."""
    sets = []
    for _, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} or ({tuple(w)} if w else set()))
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, a in enumerate(sets):
        for j, b in enumerate(sets[:k]):
            if len(a & b) >= least * len(a | b):
                x, y = find(k), find(j)
                root[x] = y
    ids = [min(docs[j][0] for j in range(len(docs)) if find(j) == find(i)) for i in range(len(docs))]
    return ids


def edited(r, words, share):
    """``words`` with a run of new words, which leaves about ``share`` of the five-word shingles alike."""
    new, out = round(len(words) * (1 - share) / (1 + share)), list(words)
    at = r.randrange(len(words) - new)
    out[at : at + new] = [f"n{r.random()}" for _ in range(new)]
    return out


def test_similar_groups_against_brute_force(spark):
    r = random.Random(8)
    vocab = [f"w{i}é" for i in range(3000)]
    given = [(0, None), (1, ""), (2, " \t\n"), (3, "One"), (4, "one"), (5, "one two"), (6, "a b a b"), (7, "a b"), (8, "Éa b c d"), (9, "éa b c d")]
    for _ in range(15):
        base = r.choices(vocab, k=r.choice([60, 300, 900]))
        given.append((len(given), " ".join(base)))
        for share in (0.6, 0.7, 0.9, 0.95, 0.97):
            given.append((len(given), " ".join(edited(r, base, share)).title()))
    long = r.choices(vocab, k=150_000)
    given += [(len(given), " ".join(long)), (len(given) + 1, " ".join(edited(r, long, 0.93)))]
    df = documents(spark, given).selectExpr("*", "1 AS id", "2 AS node", "3 AS f0", "4 AS key")
    ids = [i for i, _ in given]
    want, sure = (dict(zip(ids, brute_similar(given, least=x))) for x in (0.8, 0.9))
    got = {x["id"]: x["component"] for x in rows(m.similar_groups(df))}
    # no link that isn't one; from 0.9 on all are found, and nearly all of the others
    assert len(got) == len(given) and all(want[i] == want[c] for i, c in got.items())
    assert all(got[i] == got[c] for i, c in sure.items())
    assert 30 < len(set(want.values())) <= len(set(got.values())) <= 1.1 * len(set(want.values()))
    assert rows(m.similar_groups(documents(spark, []))) == []


def test_similar_groups_of_a_chain_and_a_large_group(spark, monkeypatch):
    """A chain links ends that are unlike; many copies of one text with an outsider near them; by the shuffle join, too."""
    r = random.Random(9)
    words = [f"w{r.randrange(5000)}" for _ in range(200)]
    given, cur = [], list(words)
    for k in range(60):  # each step replaces two neighbours, so that far steps share little
        given.append((1000 - k, " ".join(cur)))
        cur[3 * k : 3 * k + 2] = [f"c{k}", f"d{k}"]
    base = [f"v{r.randrange(5000)}" for _ in range(300)]
    for k in range(300):
        copy = list(base)
        copy[k] = "other"
        given.append((2000 + k, " ".join(copy)))
    given.append((1, " ".join(edited(r, base, 0.7))))
    want = dict(zip([i for i, _ in given], brute_similar(given)))
    assert len(set(want.values())) == 3
    for most in (m.BROADCAST_ENDS, 0):
        monkeypatch.setattr(m, "BROADCAST_ENDS", most)
        assert {x["id"]: x["component"] for x in rows(m.similar_groups(documents(spark, given)))} == want


def test_crossing_loses_no_similar_pair(spark):
    """Sets around one base with edits of their own or shared ones, a lone set and an empty one: all similar pairs are left, some others go."""
    r = random.Random(11)
    base, given = list(range(60)), [(0, 0, []), (1, 1, [10**6 + i for i in range(40)])]
    for i in range(2, 50):
        own = set(r.sample(base, r.randrange(45, 61)))
        own |= {1000 * i + k for k in range(r.randrange(0, 14))} | {5000 + r.randrange(6) for _ in range(r.randrange(0, 5))}
        given.append((i, i % 7, sorted(own)))
    sets = spark.createDataFrame([(i, s) for i, _, s in given], "node bigint, s array<bigint>")
    apart = spark.createDataFrame([(k, i, root) for i, root, _ in given for k in (1, 2) if i % 3 or k == 1], "key bigint, node bigint, root bigint")

    def alike(a, b):
        shared = len(set(a) & set(b))
        return shared >= m.SIMILARITY * (len(a) + len(b) - shared)

    across = {tuple(sorted((i, j))) for i, x, _ in given for j, y, _ in given if x < y}
    of = {i: s for i, _, s in given}
    want = {p for p in across if alike(of[p[0]], of[p[1]])}
    pairs = m._crossing(apart, sets)
    found = {tuple(sorted((x["a"], x["b"]))) for x in rows(pairs)}
    assert want <= found < across and len(want) > 20
    assert {tuple(sorted((x["a"], x["b"]))) for x in rows(m._alike(pairs, sets))} == want


def test_crossing_of_a_large_group_makes_few_pairs(spark):
    """Edits of one base, each edit in a few of the texts, so that no shingle is alone: pairs grow with the texts, not with their square."""
    r = random.Random(12)
    base, given = list(range(150)), []
    for i in range(600):
        own = set(base)
        for e in r.sample(range(900), r.randrange(4, 7)):  # an edit replaces five shingles in a row, always by the same five
            own -= set(range(e % 30 * 5, e % 30 * 5 + 5))
            own |= {10_000 + 5 * e + k for k in range(5)}
        given.append((i, sorted(own)))
    sets = spark.createDataFrame(given, "node bigint, s array<bigint>")
    apart = spark.createDataFrame([(1, i, i) for i, _ in given], "key bigint, node bigint, root bigint")
    of = {i: set(s) for i, s in given}
    want = {(i, j) for j in of for i in range(j) if len(of[i] & of[j]) >= m.SIMILARITY * len(of[i] | of[j])}
    found = {(x["a"], x["b"]) for x in rows(m._crossing(apart, sets))}
    assert want <= found and len(found) < 20 * len(given)


def test_crossing_of_texts_that_share_one_edit_makes_few_pairs(spark):
    """Texts of one base that have one edit in common and six of their own are unlike, so no pair of them is made, whatever shingles they meet in; like ones stay."""
    r = random.Random(15)
    given = []
    for i in range(600):
        own, edits = set(range(300)), [i % 30, *r.sample(range(30, 60), 6)]
        for e in edits:  # an edit replaces five shingles in a row
            own -= set(range(5 * e, 5 * e + 5))
        own |= {1000 + 5 * (i % 30) + k for k in range(5)} | {10_000 + 30 * i + k for k in range(30)}
        given.append((i, sorted(own)))
        if i % 20 == 0:  # a text like it
            given.append((1000 + i, sorted(own - {1000 + 5 * (i % 30)} | {10**7 + i})))
    sets = spark.createDataFrame(given, "node bigint, s array<bigint>")
    apart = spark.createDataFrame([(1, i, i) for i, _ in given], "key bigint, node bigint, root bigint")
    found = {(x["a"], x["b"]) for x in rows(m._crossing(apart, sets))}
    assert {(i, 1000 + i) for i in range(0, 600, 20)} <= found and len(found) < 100


def test_parities_are_a_least_difference(spark):
    r = random.Random(16)
    given = [(i, [r.getrandbits(63) - 2**62 for _ in range(n)]) for i, n in enumerate((0, 1, 40, 300, 2000))]
    given += [(10 + i, s[: len(s) * 9 // 10] + [7 * k for k in range(len(s) // 10)]) for i, s in given]
    spec = ", ".join(f"{c} bigint" for c in ("p_node", *m.PARITY_WORDS))
    of = {x["p_node"]: [x[w] for w in m.PARITY_WORDS] for x in rows(spark.createDataFrame(given, "node bigint, s array<bigint>").mapInArrow(m._parities, spec))}
    for i, a in given:
        for j, b in given:
            bits, differ = sum(((x ^ y) & (2**64 - 1)).bit_count() for x, y in zip(of[i], of[j])), len(set(a) ^ set(b))
            assert bits <= differ and (bits >= 0.75 * differ or differ > 150)


def test_band_keys_by_their_definition():
    assert len(m.band_keys(np.zeros(0, np.uint64))) == 0
    r, mask = random.Random(13), 2**64 - 1
    hashes = [r.getrandbits(64) for _ in range(3000)]
    least = [min(h * int(f) & mask for h in hashes) for f in m.FACTORS]
    want = []
    for band in range(m.BANDS):
        key = band
        for k in range(m.ROWS):
            key = (key ^ least[k * m.BANDS + band]) * int(m.MIX) & mask
            key ^= key >> 32
        want.append(m._signed(key))
    assert m.band_keys(np.array(hashes, np.uint64)).tolist() == want


def test_texts_at_the_least_similarity_meet():
    """Sets of 40 to 400 of which 0.8 is shared have a band in common; of two that share a tenth, hardly any do."""
    r, met = np.random.default_rng(14), {0.8: 0, 0.1: 0}
    for _ in range(1000):
        for share in met:
            n = int(r.integers(40, 400))
            h = r.integers(0, 1 << 64, 2 * n, np.uint64)
            alike = round(share * n)
            a, b = h[:n], np.concatenate([h[:alike], h[n : n + (n - alike) // 2]])
            a = a[: alike + (n - alike) // 2 + (n - alike) % 2]
            met[share] += bool(np.intersect1d(m.band_keys(a), m.band_keys(b)).size)
    assert met[0.8] >= 998 and met[0.1] <= 3


def test_wide_fingerprint_by_its_definition():
    for text in ("", "One", "a b a b", " ".join(f"w{i % 37}" for i in range(500))):
        w = text.encode().lower().split()
        pairs = {b" ".join(w[i : i + 2]) for i in range(len(w) - 1)} or ({w[0]} if w else set())
        digests = []
        for x in pairs:
            d = xxhash.xxh3_128_digest(x)
            low, high = (int.from_bytes(h, "little") for h in (d[:8], d[8:]))
            y = (low * 0x9E3779B97F4A7C15 ^ high) % 2**64
            y = (y ^ y >> 29) * 0x9E3779B97F4A7C15 % 2**64
            digests.append(int.from_bytes(d + (y ^ y >> 32).to_bytes(8, "little"), "big"))
        want = sum(1 << b for b in range(192) if 2 * sum(d >> b & 1 for d in digests) > len(digests))
        assert m.wide_fingerprint(w).tobytes() == want.to_bytes(24, "big")


def texts(seed=3):
    r = random.Random(seed)
    vocab = [f"w{i}é" for i in range(300)]
    out = [(0, None), (1, ""), (2, " \t\n"), (3, "One"), (4, "one"), (5, "one\x0btwo"), (6, "Éa b c d")]
    for g in range(12):
        base = r.choices(vocab, k=400)
        for _ in range(5):
            copy = list(base)
            for _ in range(r.choice([0, 1, 3, 8])):
                copy[r.randrange(400)] = "new"
            out.append((len(out), " ".join(copy)))
    return [*out, (len(out), " ".join(r.choices(vocab, k=150_000))), (7, out[7][1])]


def test_fingerprints_and_components_against_brute_force(spark):
    given = texts()
    df = documents(spark, given).selectExpr("*", "1 AS fp", "2 AS id", "3 AS component")
    want_fp = {i: brute_fingerprint(t) for i, t in given}
    want = brute_components(sorted(want_fp.items()))
    got = rows(m.near_duplicate_groups(df))
    assert len(got) == len(given)
    assert {r["id"]: r["fp"] & (2**64 - 1) for r in got} == want_fp
    assert {r["id"]: r["component"] for r in got} == want
    assert len(set(want.values())) < len(set(want_fp.values()))  # there are links between different texts


def test_both_ways_link_the_same_fingerprints(spark):
    r = random.Random(5)
    fps = set()
    while len(fps) < 400:  # chains of flips around a few centres, and strangers
        c = r.getrandbits(64) if len(fps) % 100 == 0 else r.choice(sorted(fps))
        for _ in range(r.choice([1, 2, 3, 3, 4])):
            c ^= 1 << r.randrange(64)
        fps.add(c)
    nodes = list(enumerate(sorted(fps)))
    want = brute_components(nodes)
    df = spark.createDataFrame([(i, m._signed(f)) for i, f in nodes], "id bigint, fp bigint")
    true = {(i, j) for j, f in nodes for i, g in nodes[:j] if (f ^ g).bit_count() <= 3}
    for hot in (10**9, 3, 0):
        edges = m.links(df, hot)
        found = {(e["a"], e["b"]) for e in rows(edges)}
        assert found <= true and (hot < 10**9 or found == true)
        roots = {e["id"]: e["root"] for e in rows(m.components(edges))}
        assert {i: roots.get(i, i) for i, _ in nodes} == want


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)], "a bigint, b bigint")
    assert {r["root"] for r in rows(m.components(edges))} == {0}


def test_stage_and_empty_table(spark):
    given = [(4, "a b c d e"), (2, "A b c d e"), (9, "quite other words than these are"), (3, None), (8, "")]
    kept = m.keep_one_of_each(spark, documents(spark, given), "")
    assert sorted(r["doc_id"] for r in rows(kept)) == [2, 3, 9]
    assert rows(m.near_duplicate_groups(documents(spark, []))) == []


def test_stage_knows_rows_by_id_and_text(spark):
    other = "quite other words than these are"
    given = [
        (1, "a b c d e"), (1, other), (2, "a b c d e"), (2, "the second text of an id stays"), (5, other), (5, other),
        (None, "A b c d e"), (None, "only here without an id"), (None, "only here without an id"), (None, "and this one too"), (7, "said twice"), (7, "said twice"),
    ]
    df = documents(spark, given).selectExpr("*", "1 AS id", "2 AS th", "3 AS first")
    kept = sorted((str(r["doc_id"]), r["text"]) for r in rows(m.keep_one_of_each(spark, df, "")))
    assert kept == sorted([
        ("1", "a b c d e"), ("1", other), ("2", "the second text of an id stays"), ("None", "only here without an id"), ("None", "and this one too"), ("7", "said twice"),
    ])
    by = {(r["id"], r["fp"]): r["component"] for r in rows(m.near_duplicate_groups(df))}
    assert [by[i, m._signed(brute_fingerprint(t))] for i, t in given] == [1, 1, 1, 2, 1, 1, 1, None, None, None, 7, 7]


def test_nothing_that_grows_is_broadcast(spark, monkeypatch):
    plans, cut = [], m.cut

    def noted(df):
        done = cut(df)
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return done

    monkeypatch.setattr(m, "cut", noted)
    words = "one two three four five six seven eight nine ten".split()
    docs = documents(spark, [(i, " ".join(words * 20) + f" w{i // 3} x{i % 2}") for i in range(40)])
    found = m.near_duplicate_groups(docs, hot=2)
    assert found.count() == 40
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert any("Join" in p for p in plans) and not any("Broadcast" in p for p in plans)
