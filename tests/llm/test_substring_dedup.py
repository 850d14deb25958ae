import hashlib
import random
import re

import pytest
import xxhash

from tests.llm.test_fingerprint import xx
from tests.llm.util import documents, folder, rows
from tilewright.llm import substring_dedup as m

r = random.Random(8)
VOCAB = ["".join(r.choices("abcdefghijklé", k=r.randrange(3, 9))) for _ in range(2000)]


def sentence(n=None):
    return " ".join(r.choices(VOCAB, k=n or r.randrange(4, 14))).capitalize() + r.choice([". ", "! ", ".\n", "\n"])


def prose(n):
    return "".join(sentence() for _ in range(n))


PASSAGE, FLAT = prose(8), " ".join(r.choices(VOCAB, k=80))
LINES = "".join(" ".join(r.choices(VOCAB, k=5)) + "\n" for _ in range(12))  # a passage of 60 words in short lines
WORDS24 = " ".join(f"word{i}" for i in range(24))
GIVEN = [
    (0, None), (1, ""), (2, prose(10)), (3, prose(5) + PASSAGE + prose(5)), (4, prose(3) + PASSAGE + prose(3)),
    (5, "so " + FLAT + " then"), (6, prose(4).rstrip() + " " + FLAT.upper() + " " + prose(2)), (7, "Short. Lines. Here."), (8, "Short. Lines. Here."),
    (9, f"{WORDS24}."), (12, f"{WORDS24.capitalize().replace(' ', '  ', 1)}."), (14, f"{WORDS24} and more."),
    (13, "the same words again and again in each line here\n" * 20), (20, prose(12_000)), (7, "Short. Lines. Here."), (21, PASSAGE), (None, PASSAGE), (None, PASSAGE),
    (30, prose(3) + "\n" + LINES + prose(2)), (31, prose(2) + "\n" + LINES + prose(4)), (31, prose(6)), (30, PASSAGE + prose(2)), (30, PASSAGE + "Other end. "),
]


def brute_sentences(text):
    """(start, end, words), from the rules: a place at a time, without the operator's code."""
    cuts = [0]
    for i, c in enumerate(text):
        before, after = text[:i], text[i:]
        if not c.isspace() and before and before[-1].isspace():
            gap = before[len(before.rstrip()) :]
            if "\n" in gap or before.rstrip()[-1:] in tuple(".!?") and before.rstrip():
                cuts.append(i)
    out = []
    for a, b in zip(cuts, [*cuts[1:], len(text)]):
        words = [(w.start() + a, w.group().lower()) for w in re.finditer(r"\S+", text[a:b])]
        if len(words) <= m.LONG:
            out += [(a, b, [w for _, w in words])] if words else []
            continue
        begin = 0
        for k in range(1, len(words) + 1):
            if k == len(words) or k - begin > 1 and xxhash.xxh3_64_intdigest(f"{words[k - 1][1]} {words[k][1]}") % m.CUT_EVERY == 0:
                out.append((a if begin == 0 else words[begin][0], b if k == len(words) else words[k][0], [w for _, w in words[begin:k]]))
                begin = k
    return [(0 if k == 0 else a, b, w) for k, (a, b, w) in enumerate(out)]


def brute(given, least):
    """{(id, text): (sentences, removed, what stays)}, by trying every run from every sentence."""
    seen, out = {}, {}
    for i, t in sorted({(i, t or "") for i, t in given if i is not None}, key=lambda x: (x[0], signed(xx(x[1])))):
        own = brute_sentences(t) if len(t) < 50_000 else [(a, b, w) for (a, w), b in zip(m.sentences(t), [s for s, _ in m.sentences(t)][1:] + [len(t)])]
        drop = set()
        for p in range(len(own)):
            end = p + min(m.RUN, len(own))
            while end < len(own) and sum(len(w) for _, _, w in own[p:end]) < least:
                end += 1
            run = tuple(tuple(w) for _, _, w in own[p:end])
            if end <= len(own) and sum(map(len, run)) >= least and seen.setdefault(run, (i, t, p)) != (i, t, p):
                drop.update(range(p, end))
        out[i, t] = (len(own), len(drop), "".join(t[a:b] for k, (a, b, _) in enumerate(own) if k not in drop) if own else t)
    return out


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def by_given(spark, **options):
    """Each row's id and text beside what was found for it."""
    df = documents(spark, GIVEN).selectExpr("*", "1 AS h", "2 AS place", "3 AS first", "text AS given")
    found = rows(m.find_repeats(df, **options))
    assert len(found) == len(GIVEN)
    return found


@pytest.mark.parametrize("options", [{}, {"hot": 1}, {"hot": 20}, {"least_words": 1}, {"least_words": 60}])
def test_against_brute_force(spark, options):
    want = brute(GIVEN, options.get("least_words", m.LEAST_WORDS))
    got = sorted((g["id"], g["n_sentences"], g["n_removed"], g["text"] or "") for g in by_given(spark, **options) if g["id"] is not None)
    assert got == sorted((i, *want[i, t or ""]) for i, t in GIVEN if i is not None)


def test_query(spark, tmp_path):
    d = folder(tmp_path, documents=documents(spark, GIVEN).selectExpr("*", "1 AS h", "2 AS place", "3 AS first"))
    got = rows(m.op9_substring_dedup(spark, d))
    want = brute(GIVEN, m.LEAST_WORDS)
    kept = sorted((i, len(want[i, t or ""][2]), hashlib.sha256(want[i, t or ""][2].encode()).hexdigest()) for i, t in GIVEN if i is not None)
    assert sorted((g["doc_id"], g["kept_chars"], g["kept_sha256"]) for g in got if g["doc_id"] is not None) == kept
    assert all(g["n_removed"] == 0 for g in got if g["doc_id"] is None)
    by = {g["doc_id"]: g for g in got if g["doc_id"] not in (30, 31)}
    assert by[2]["n_removed"] == by[3]["n_removed"] == by[5]["n_removed"] == by[8]["n_removed"] == by[14]["n_removed"] == 0
    assert by[4]["n_removed"] >= 7 and by[21]["kept_chars"] == 0 and by[12]["kept_chars"] == 0 and by[13]["n_removed"] >= 17
    assert by[6]["n_removed"] > 0  # a passage without sentence ends, inside other sentences
    assert {g["n_removed"] > 0 for g in got if g["doc_id"] == 31} == {True, False}  # short lines; the other text of that id stays
    assert max(g["n_removed"] for g in got if g["doc_id"] == 31) >= 8


def test_sentences_cover_the_text():
    for _, t in GIVEN:
        if t:
            own = m.sentences(t)
            assert own[0][0] == 0 and [s for s, _ in own] == sorted({s for s, _ in own})
            assert [w for _, ws in own for w in ws] == t.lower().split()


def test_empty_table(spark):
    assert rows(m.find_repeats(documents(spark, []))) == []
