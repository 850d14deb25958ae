import re

import corpus_pipeline as p
from tests.llm.test_byte_bpe import want
from tests.llm.test_decontaminate import ITEM, ITEMS, brute as contaminated
from tests.llm.test_near_dedup import brute_similar
from tests.llm.test_secrets import RANDOM, brute_base, given as given_secrets
from tests.llm.test_toxicity import corpus
from tests.llm.util import documents, folder, rows
from tilewright.llm import toxicity


def test_against_brute_force(spark, tmp_path):
    docs, labels = corpus(200)
    clean = [t for (i, t), (_, _, y) in zip(docs, labels) if not y]
    docs += [
        (500, clean[0]), (501, clean[3].upper()), (502, clean[4] + " " + ITEM), (503, f"{clean[5][:90]} api_key = 'abcd1234efgh' {RANDOM} and AKIA1234567890ABCD"),
        (504, None), (505, ""), (509, dict(given_secrets())[6]), (506, "a" * 50_000 + " end"), (507, "Short item É"), (508, f"password: x{RANDOM} only this one here {clean[6][:40]}"),
    ]
    bench = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    lab = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    d = folder(tmp_path, documents=documents(spark, docs), benchmark=bench, labels=lab)
    # each document's toxicity is taken from the rule itself: the scores of its words, scanned by a plain loop
    model = toxicity.fit(documents(spark, docs), lab)

    def toxic(text):
        words = toxicity.WORDS.findall((text or "").lower())
        best = [(i, model.word(w)) for i, w in enumerate(words) if model.word(w) > 0]
        found = toxicity.segments([i for i, _ in best], [s for _, s in best])
        return model.probability(model.evidence(found, len(words))[1]) >= 0.3

    left = [(i, t) for i, t in docs if not toxic(t)]
    assert 150 < len(left) < len(docs) - 30
    left = [(i, t) for (i, t), least in zip(left, brute_similar(left)) if least == i]
    left = [(i, t) for i, t in left if not contaminated(t, ITEMS)[4]]
    assert not {500, 501, 502, 507, 505} & {i for i, _ in left}

    def redact(text):
        spans = [(s, e) for s, _, _, e in brute_base(text)]
        spans += [m.span() for m in re.finditer(rf"(?<![A-Za-z0-9+/_=-]){RANDOM}(?![A-Za-z0-9+/_=-])", text or "")]
        for s, e in sorted(spans, reverse=True):
            text = f"{text[:s]}[SECRET]{text[e:]}"
        return text

    expected = sorted((i, *want(redact(t))) for i, t in left)
    got = sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows(p.run(spark, d)))
    assert got == expected


def test_stages_keep_the_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in p.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.dtypes == docs.dtypes
        assert rows(stage(spark, docs.limit(0), sf_dir)) == []
