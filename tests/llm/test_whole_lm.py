"""The language model learns from all training texts."""

import zlib

import numpy as np

from webloom.llm import lm

TINY = lm.Settings(head=6, words=3, sample_docs=5, epochs=1, streams=2, window=2, classes=2, hidden=4)


def test_every_text_is_trained_on(spark, monkeypatch):
    long = "long text " * 30_000  # beyond what one text could have before
    rows = [(i, long if i == 13 else f"word{i} is here") for i in range(60)]
    model, counts = lm.fit(spark.createDataFrame(rows, "doc_id long, text string"), TINY)
    allowed = [t for i, t in rows if zlib.crc32(str(i).encode()) % 10]
    start = lm.Network.fresh(np.concatenate([[model.unknown, model.ends], model.head_counts[:3]]).astype(float), TINY)
    # Inputs that some text has moved away from the start.
    buckets = {5 + lm.unknown_bucket(w, TINY.unknown_inputs) for t in allowed for w in t.encode().split()[:-1] if w not in model.head[:3]}
    moved = {i for i in range(5, len(start.weights["inputs"])) if (model.network.weights["inputs"][i] != start.weights["inputs"][i]).any()}
    assert moved >= buckets and len(buckets) > 5
    # Spelling knows the words that are not in the head.
    words = [(bytes(r.word), r.c) for r in counts.collect() if bytes(r.word) not in model.head[:3]]
    whole = lm.Spelling(lm.Spelling.sums_of([w for w, _ in words], np.array([c for _, c in words])))
    assert len(words) > len(model.head)
    assert np.allclose(model.spelling.log10([b"word7", b"zzz"]), whole.log10([b"word7", b"zzz"]))


def test_remainders_are_trained_on():
    s = lm.Settings(classes=2, hidden=4)
    net = lm.Network.fresh(np.array([5.0, 2, 9, 4, 1]), s)
    before = net.weights["inputs"].copy()
    n = 1024 + 5 * 16 + 3
    inputs, targets = np.zeros(n, np.int32), np.full(n, 2)
    inputs[-1] = 4  # in no full window
    lm.train_whole(net, inputs, targets, s, lm.Adam(net.weights, 3))
    assert (net.weights["inputs"][4] != before[4]).any()


def test_large_ids_are_learnt_from(spark):
    s = lm.Settings(head=6, words=3, epochs=1, classes=2, hidden=4)
    own = {i: f"{chr(97 + i % 26)}{chr(97 + i // 26)}x" for i in range(40)}
    rows = [(i, "common " * 20_000 + f"{own[i]} end") for i in own]  # 800000 tokens, held-out ones included
    model, _ = lm.fit(spark.createDataFrame(rows, "doc_id long, text string"), s)
    start = lm.Network.fresh(np.concatenate([[model.unknown, model.ends], model.head_counts[:3]]).astype(float), s)
    for i, word in own.items():
        if zlib.crc32(str(i).encode()) % 10 and word.encode() not in model.head[:3]:
            at = 5 + lm.unknown_bucket(word.encode(), s.unknown_inputs)
            assert (model.network.weights["inputs"][at] != start.weights["inputs"][at]).any(), i


def test_gradients_through_time():
    s = lm.Settings(hidden=4, classes=3, streams=2, window=4, epochs=1, unknown_inputs=2)
    net = lm.Network.fresh(np.array([5.0, 2, 9, 4, 1, 3, 2]), s)
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    rng = np.random.default_rng(0)
    inputs, targets, h, ended = rng.integers(0, 9, (4, 3)), rng.integers(0, 7, (4, 3)), rng.standard_normal((3, 4)) * 0.5, np.array([True, False, False])
    _, _, grads, rows = lm.gradients(net, inputs, targets, h, ended)
    whole = np.zeros_like(net.weights["inputs"])
    whole[rows] = grads["inputs"]
    grads["inputs"] = whole
    for name, w in net.weights.items():
        for at in np.ndindex(*w.shape):
            before, losses = w[at], []
            for step in (1e-5, -1e-5):
                w[at] = before + step
                losses.append(lm.gradients(net, inputs, targets, h, ended)[0])
            w[at] = before
            assert abs((losses[0] - losses[1]) / 2e-5 - grads[name][at]) < 1e-6, (name, at)


def test_words_as_bytes_split_them():
    texts = [None, "", " A b\x0bC\x1cd\u00c9 ", "x" * 70_000 + " y", "\n\n", "tail"]
    words, owner = lm.words_of(lm.pa.array(texts, lm.pa.string()))
    assert [(int(o), bytes(w)) for o, w in zip(owner, words.to_pylist())] == [(i, w) for i, t in enumerate(texts) for w in (t or "").encode().lower().split()]


def test_score_equals_score_in_one_go(spark):
    rows = [(i, f"word{i % 7} is here and word{i % 3}") for i in range(40)] + [(None, "no id"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    settings = lm.replace(TINY, epochs=2)
    one, two = lm.fit_and_score(docs, settings).collect(), lm.score(docs, *lm.fit(docs, settings)).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.n_tokens)
    assert [tuple(r)[:6] for r in sorted(one, key=key)] == [tuple(r)[:6] for r in sorted(two, key=key)]
    assert np.allclose([r.score for r in sorted(one, key=key)], [r.score for r in sorted(two, key=key)], atol=1e-4)
