import random

import pytest

from tests.llm.util import documents, folder, rows
from tilewright.llm import toxicity as m

BAD = ["vileone", "viletwo", "vilethree", "vilefour", "grubby"]


def corpus(n=400, seed=2):
    r = random.Random(seed)
    vocab = ["".join(r.choices("abcdefghij", k=r.randrange(4, 9))) for _ in range(900)]
    docs, labels = [], []
    for i in range(n):
        words = r.choices(vocab, k=r.randrange(20, 200))
        toxic = i % 5 == 0
        if toxic:
            for _ in range(4):
                words.insert(r.randrange(len(words)), r.choice(BAD))
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def brute_segments(scores, low=0):
    """The best segment (shortest, first among equals), then the same on both sides of it."""
    best = None
    for a in range(len(scores)):
        total = 0.0
        for b in range(a, len(scores)):
            total += scores[b]
            if total > 1e-9 and (best is None or total > best[2] + 1e-9):
                best = (a, b + 1, total)
    if best is None:
        return []
    a, b, s = best
    return [*brute_segments(scores[:a], low), (low + a, low + b, s), *brute_segments(scores[b:], low + b)]


def test_segments_against_brute_force():
    r = random.Random(4)
    for _ in range(200):
        scores = [r.choice([1.3, 2.1, 0.7]) if r.random() < 0.3 else -0.45 for _ in range(r.randrange(60))]
        at = [i for i, s in enumerate(scores) if s > 0]
        got = m.segments(at, [scores[i] for i in at], 0.45)
        want = brute_segments(scores)
        assert [g[:2] for g in got] == [w[:2] for w in want]
        assert [g[2] for g in got] == pytest.approx([w[2] for w in want])


def test_a_long_text_is_scanned_in_linear_time():
    n = 300_000
    assert len(m.segments(list(range(0, 40 * n, 40)), [1.0] * n, 0.05)) == n


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    docs, labels = corpus()
    extra = [(900, None), (901, ""), (902, "vileunheard and vilestill"), (903, docs[5][1] + " word" * 200_000), (1, docs[1][1])]
    df = documents(spark, docs + extra).selectExpr("*", "'x' AS toxic", "2 AS score")
    lab = spark.createDataFrame([*labels, (3, 1, 0), (None, 1, 1), (5000, 1, 1)], "doc_id bigint, quality int, toxic int")
    return folder(tmp_path_factory.mktemp("tox"), documents=df, labels=lab), dict((i, t) for i, _, t in labels), df, lab


def test_learns_held_out_labels(spark, made):
    d, truth, _, _ = made
    got = rows(m.op8_toxicity(spark, d))
    assert len(got) == 405
    import zlib

    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    held = [(r["predicted"], truth[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in truth]
    assert sum(p == t for p, t in held) / len(held) > 0.97
    by = {r["doc_id"]: r for r in got}
    assert by[900]["score"] == by[901]["score"] < 0.3 and by[902]["predicted"] == 1 and by[903]["score"] > 0
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)


def test_held_out_labels_are_never_read(spark, made):
    _, _, df, lab = made
    kept = lab.where(~m.held_out(lab.doc_id))
    changed = kept.unionByName(lab.where(m.held_out(lab.doc_id)).selectExpr("doc_id", "quality", "1 - toxic AS toxic"))
    assert m.fit(df, changed).scores == m.fit(df, lab).scores


def test_stage_and_empty_tables(spark, made, tmp_path):
    d, truth, df, lab = made
    kept = {r["doc_id"] for r in rows(m.drop_toxic(spark, df, d))}
    assert len([i for i, t in truth.items() if t == 0 and i not in kept]) <= 3 and {900, 901} <= kept
    none = lab.limit(0)
    assert m.fit(df, none).probability(5.0) < 1e-6
    assert rows(m.score(df.limit(0), m.fit(df.limit(0), lab))) == []


def test_stage_judges_each_row_by_its_own_text(spark, made):
    d, truth, df, lab = made
    bad, good = dict(corpus()[0])[0], dict(corpus()[0])[1]
    given = documents(spark, [(None, bad), (None, good), (None, None), (1, bad), (1, good), (3, bad)]).selectExpr("*", "'x' AS toxic", "array(1) AS id")
    model = m.fit(df, lab)
    kept = rows(m.rows_below(given, model))
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept if r["text"]) == [("1", good), ("None", good)]
    assert len(kept) == 3 and all(r["toxic"] == "x" and r["id"] == [1] for r in kept)


def test_a_sample_that_binds_and_shared_beginnings_leave_predictions_right(spark):
    """What the pipeline goes by is ``predicted``: recall and precision of it, with more labels than are learnt from."""
    docs, labels = corpus(900, seed=5)
    start = "This line of a licence stands before every document of one large source, whatever follows. "
    given = documents(spark, [(i, start + t if i % 3 else t) for i, t in docs])
    lab = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    for sample in (100_000, 300):
        model = m.fit(given, lab, sample=sample)
        got = {r["id"]: r["score"] >= m.THRESHOLD for r in rows(m.score(given, model))}
        toxic = {i for i, _, y in labels if y}
        caught = sum(got[i] for i in toxic)
        assert caught > 0.9 * len(toxic) and caught > 0.9 * sum(got.values())


def test_a_learning_row_counts_with_all_its_passages(spark):
    """A text of many passages is calibrated on the evidence that it is scored with."""
    docs, labels = corpus()
    clean = " ".join(t for (_, t), (_, _, y) in zip(docs, labels) if not y).split()
    long = " ".join(w for k in range(100) for w in [*BAD[:4], *clean[100 * k % 5000 :][:800]])
    df = documents(spark, [*docs, *[(1000 + i, long + f" end{i}") for i in range(8)]])
    lab = spark.createDataFrame([*labels, *[(1000 + i, 1, 1) for i in range(8)]], "doc_id bigint, quality int, toxic int")
    model = m.fit(df, lab)
    (batch,) = m._evidence(model)(iter([m.pa.RecordBatch.from_arrays([m.pa.array([long]), m.pa.array([1]), m.pa.array([0])], names=["text", "toxic", "copy"])]))
    found = rows(m.score(documents(spark, [(1, long)]), model))[0]["passages"]
    assert len(found) > 64
    import math

    assert batch.column(2)[0].as_py() == pytest.approx(-sum(math.log(p["e_value"]) for p in found))


def test_only_copies_of_a_whole_text_share_a_weight(spark):
    banner = "This line of a licence stands before every document of one large source, " * 2
    ids = [i for i in range(400) if i % 4]
    given = [(i, banner + (f"vileword nasty{i}" if i % 3 == 0 else f"plain talk{i}")) for i in ids]
    lab = spark.createDataFrame([(i, int(i % 3 == 0)) for i in ids], "doc_id bigint, toxic int")
    assert "=vileword" in m.fit(documents(spark, given), lab).scores
    same = [(i, "vileword again and again" if i % 3 == 0 else t) for i, t in given]
    assert "=vileword" not in m.fit(documents(spark, same), lab).scores
