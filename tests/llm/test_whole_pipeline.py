"""The pipeline's stages judge rows, whatever their ids."""

import random

import corpus_pipeline


def test_null_and_repeated_ids(spark):
    rng = random.Random(1)
    text = lambda: " ".join(f"w{rng.randrange(10_000)}" for _ in range(40))
    same = text()
    rows = [(None, text()), (None, text()), (7, text()), (7, text()), (8, same), (None, same), (8, same), (9, "too short"), (9, text())]
    docs = spark.createDataFrame([(i, t, "en", f"s{n}", len(t)) for n, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.text for r in corpus_pipeline.quality(spark, docs, "").collect()) == sorted(t for _, t in rows if t != "too short")
    kept = corpus_pipeline.near_dedup(spark, docs, "").collect()
    assert sorted(r.text for r in kept) == sorted({t for _, t in rows})
    assert [r.doc_id for r in kept if r.text == same] == [8]
