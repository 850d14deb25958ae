import random
from itertools import product

import numpy as np

from tests.llm.util import documents, folder, rows
from tilewright.llm import quality as m


def corpus(n=600, seed=3):
    r = random.Random(seed)
    vocab = ["".join(r.choices("abcdefghijé", k=r.randrange(3, 9))) for _ in range(900)]
    out = []
    for i in range(n):
        text = "".join(" ".join(r.choices(vocab, k=r.randrange(5, 14))).capitalize() + ".\n" for _ in range(r.randrange(4, 20)))
        junk = i % 4 == 0
        if junk:
            text = r.choice([text.upper().replace(" ", "!! "), text.replace(" ", "$$$ "), text[:60] + (text[:20] + "\n") * 40])
        out.append((i, text, not junk))
    return out


def test_em_recovers_accuracies_and_labels():
    rng = np.random.default_rng(1)
    truth = rng.random(20_000) < 0.7
    accuracy = np.array([0.95, 0.9, 0.8, 0.7, 0.6])
    v = np.where(rng.random((20_000, 5)) < accuracy, 1, -1) * np.where(truth, 1, -1)[:, None]
    v[rng.random((20_000, 5)) < 0.2] = 0
    patterns = {}
    for p in map(tuple, v.tolist()):
        patterns[p] = patterns.get(p, 0) + 1
    posterior, table, prior = m.estimate(patterns)
    assert abs(prior - 0.7) < 0.02
    est = table[:, 1, 2] / (1 - table[:, 1, 1])
    assert np.abs(est - accuracy).max() < 0.03
    # posteriors are Bayes' rule of the estimated tables
    for p in list(posterior)[:50]:
        like = [np.prod([table[h, c, x + 1] for h, x in enumerate(p)]) * (prior if c else 1 - prior) for c in (0, 1)]
        assert abs(posterior[p] - like[1] / sum(like)) < 1e-6


def test_scores_tell_junk_from_prose(spark, tmp_path):
    made = corpus()
    extra = [(1000, None), (1001, ""), (1002, "Hi."), (1003, made[1][1] * 300), (1, made[1][1])]
    d = folder(tmp_path, documents=documents(spark, [(i, t) for i, t, _ in made] + extra).selectExpr("*", "1 AS x", "2 AS votes", "3 AS score"))
    got = rows(m.op4_quality(spark, d))
    assert len(got) == len(made) + len(extra) and all(0 <= g["score"] <= 1 and g["keep"] == (g["score"] >= 0.5) for g in got)
    by = {g["doc_id"]: g for g in got}
    assert sum(by[i]["keep"] == good for i, _, good in made) / len(made) > 0.97
    assert by[1002]["keep"] and not by[1003]["keep"] and by[1000]["score"] == by[1001]["score"]


def test_features_against_brute_force():
    text = "aXé1 aX"
    s = m.shape(text)
    want = np.zeros(m.DIM)
    b = text.encode()
    for x, y, z in zip(b, b[1:], b[2:]):
        h = (x * 0x9E3779B1 % 2**32) ^ (y * 0x85EBCA6B % 2**32) ^ (z * 0xC2B2AE35 % 2**32)
        want[(h >> 16) % m.DIM] += 1 / (len(b) - 2)
    got = m.features(text, s)
    bins = np.abs(got - np.sqrt(want)) > 1e-6
    assert bins.sum() <= 5 and s["words"] == 2 and s["capitals"] == 2 / 6  # of bytes of letters: é has two


def test_votes_are_of_three_kinds():
    seen = {x for _, t, _ in corpus(80) for x in m.votes(m.shape(t))}
    assert seen == {-1, 0, 1}
    assert len(list(product((-1, 0, 1), repeat=len(m.votes(m.shape("")))))) == 3**7


def test_empty_table(spark):
    df = documents(spark, [])
    assert rows(m.score(df, *m.fit(df))) == []
