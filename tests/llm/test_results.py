"""Operators against brute force, exact round trips and held-out accuracy."""

import collections
import hashlib
import itertools
import json
import os
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from webloom.llm import ann, bpe, langid, lm, mixing, neardup, quality_clf, quality_rules, queries, toxicity, warc

SF = "/root/testdata/sf0.01"
RANKS = public_tokenizers.path(queries.RANK_FILE)
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


@needs_data
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.sql(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{SF}/{file}'")
    frames = queries.queries()[name](spark, SF).toPandas(), con.sql(queries.SQL[name]).df()
    rows = [sorted(map(str, f[sorted(f.columns)].astype(object).where(f[sorted(f.columns)].notna(), None).values.tolist())) for f in frames]
    assert [x.replace(".0", "") for x in rows[0]] == [x.replace(".0", "") for x in rows[1]]


@needs_data
def test_classifiers_held_out(spark):
    docs, labels = table(spark, "documents"), table(spark, "labels")
    quality = quality_clf.score(docs, quality_clf.fit(docs, labels)).join(labels, "doc_id").where("held_out")
    assert quality.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0] > 0.93
    toxic = toxicity.score(docs, toxicity.fit(docs, labels)).join(labels, "doc_id")
    assert toxic.agg(F.avg((F.col("predicted") == F.col("toxic")).cast("int"))).first()[0] > 0.93
    lang = langid.predict(docs, langid.fit(docs)).where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert lang.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0] > 0.98


def test_nnpu_leaves_unlabelled_positives():
    rng = np.random.default_rng(0)
    toxic = (rng.random((4000, 1)) < 0.2).astype(np.uint8)
    x = np.concatenate([toxic, rng.random((4000, 5)) < 0.3], 1).astype(np.uint8)
    w, b = toxicity.nnpu(x[toxic[:, 0] == 1][:200], x, 0.2, toxicity.Settings())
    assert b + w[0] > 1 and b < -1 and abs(w[1:]).max() < w[0]


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(1)
    for _ in range(60):
        n, k, switch = int(rng.integers(1, 6)), 3, float(rng.random() * 3)
        e = rng.standard_normal((n, k)) * 3
        value = lambda p: sum(e[i, s] for i, s in enumerate(p)) - switch * sum(a != b for a, b in zip(p, p[1:]))
        assert value(langid.viterbi(e, switch)) == pytest.approx(max(map(value, itertools.product(range(k), repeat=n))))


def test_mixed_language_spans(spark):
    rows = [(i, t, lang, None) for i, (t, lang) in enumerate([("the cat was in the house with this", "en"), ("der Hund ist nicht in dem Haus und", "de"), ("это кот в доме", "ru")] * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    model = langid.fit(docs, langid.Settings(switch=6.0))
    text = "the cat was in the house with this der Hund ist nicht in dem Haus und это кот в доме"
    out = langid.predict(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()
    assert [(s.first, s.end, s.lang) for s in out.spans] == [(0, 8, "en"), (8, 16, "de"), (16, 20, "ru")]


def test_bpe_pieces():
    encoding = bpe.load_encoding(RANKS, public_tokenizers.PATTERN)
    rng = random.Random(2)
    parts = ["word", " ", "  ", "\n", "it's", "é", "12", "...", " ", "\x1c", "a" * 50, "!?", "中文"]
    for _ in range(40):
        text = "".join(rng.choice(parts) for _ in range(400))
        ids = encoding.encode_ordinary(text)
        assert bpe.encode_text(encoding, text, 60) == ids and "".join(bpe.safe_pieces(text, 60)) == text
        assert encoding.decode_bytes(ids) == text.encode()


@needs_data
def test_bpe_digests(spark):
    encoding = bpe.load_encoding(RANKS, public_tokenizers.PATTERN)
    docs = table(spark, "documents").limit(50)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in bpe.round_trip_digests(docs, RANKS, public_tokenizers.PATTERN).collect():
        ids = encoding.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def targets_by_hand(sizes, weights=(5, 2, 1)):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    full, total = set(), sum(sizes.values())
    while True:
        level = (total - sum(3 * sizes[s] for s in full)) / sum(weight[s] for s in names if s not in full)
        more = {s for s in names if s not in full and level * weight[s] > 3 * sizes[s]}
        if not more:
            return {s: 3.0 * sizes[s] if s in full else level * weight[s] for s in names}
        full |= more


def test_mixing(spark):
    rng = random.Random(3)
    rows = []
    for i in range(600):
        source = rng.choice(["a", "a", "a", "b", "c", "d", "tiny", None])
        n = 3 if source == "tiny" else rng.randint(0, 300)
        rows.append((i, " ".join(f"w{rng.random():.3f}" for _ in range(n)), "en", source, 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = mixing.mix_counts(docs).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix_counts(docs.repartition(7)).collect()))
    source_of = {r[0]: r[3] for r in rows}
    sizes, taken = collections.Counter(), collections.Counter()
    for r in got:
        sizes[source_of[r.doc_id]] += r.size
        taken[source_of[r.doc_id]] += r.taken
        assert 0 <= r.taken <= 3 * r.size
    expected = targets_by_hand(sizes)
    for r in got:
        assert r.source_size == sizes[source_of[r.doc_id]] and r.target == pytest.approx(expected[source_of[r.doc_id]])
    for s, t in expected.items():
        assert abs(taken[s] - t) <= 0.02 * t + 64
    pieces = mixing.mix_pieces(docs).groupBy("doc_id").agg(F.sum(F.regexp_count("text", F.lit("[^ ]+"))).alias("w")).collect()
    assert {r.doc_id: r.w for r in pieces} == {r.doc_id: r.taken for r in got if r.taken}


def test_shards_draw_what_is_taken(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(f"w{k}" for k in range(rng.randint(20, 400))), None, rng.choice("aaabc"), 0) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    s = mixing.Settings(shard_slots=64)
    targets = mixing.source_targets(mixing.sized(docs), s)
    counts = mixing.shard_counts(targets, s)
    slots = mixing.mix_slots(targets, counts, s)
    drawn = {(r.shard, r.skey): (r.n, r.first) for r in counts.collect()}
    assert collections.Counter((r.shard, r.skey) for r in slots.collect()) == {k: n for k, (n, _) in drawn.items()}
    total, wanted = sum(n for n, _ in drawn.values()), {r.skey: r.slots for r in targets.collect()}
    shards = max(k[0] for k in drawn) + 1
    assert total == sum(wanted.values()) and shards == -(-total // 64)
    for shard in range(shards - 1):
        assert sum(drawn.get((shard, k), (0, 0))[0] for k in wanted) == 64
    for k, n in wanted.items():
        at = 0
        for shard in range(shards):  # the shards' slots of a source follow each other
            if (shard, k) in drawn:
                assert drawn[shard, k][1] == at
                at += drawn[shard, k][0]
        assert at == n
    assert len({drawn.get((shard, "sb"), (0, 0))[0] for shard in range(shards - 1)}) > 1  # drawn, not dealt out evenly
    blocks = collections.Counter((r.skey, r.number) for r in slots.collect())
    assert max(blocks.values()) - 1 <= 2 and {r.first_shard is None for r in mixing.mix_counts(docs, s).where("taken > 0").collect()} == {False}


def test_very_long_text_is_cut_once(spark):
    rows = [(1, " ".join(f"w{i}" for i in range(100_000)), None, "a", 0), (2, "b " * 300, None, "b", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    words = lambda r: r.text.split()
    pieces = mixing.mix_pieces(docs).collect()
    taken = {r.doc_id: r.taken for r in mixing.mix_counts(docs).collect()}
    assert {i: sum(len(words(r)) for r in pieces if r.doc_id == i) for i in (1, 2)} == taken
    for r in pieces:
        if r.doc_id == 1:
            assert words(r) == [f"w{i}" for i in range(int(words(r)[0][1:]), int(words(r)[-1][1:]) + 1)]


def test_permutation(spark):
    for n in (1, 2, 7, 1000):
        out = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(5)).alias("x")).collect()
        assert sorted(r.x for r in out) == list(range(n))


def test_warc_files(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"page {i % 7} {i % 13} " * 100) for i in range(600)], "page_id long, url string, html string")
    s = warc.Settings(shard_bytes_low=100_000, roll_bytes=10_000)
    sums = []
    for name in ("one", "two"):
        files = warc.write_archive(pages.repartition(3), f"file://{tmp_path}/{name}", s).orderBy("file").collect()
        sums.append([tuple(r) for r in files])
        names = sorted(os.listdir(tmp_path / name))
        assert not [n for n in names if n.endswith(".tmp")] and json.loads((tmp_path / name / "manifest.json").read_text())["records"] == 600
        assert {n for n in names if n.endswith(".warc.gz")} == {r.file for r in files}
        listed = [f for n in names if n.startswith("manifest-") for f in json.loads((tmp_path / name / n).read_text())["files"]]
        assert sum(f["records"] for f in listed) == 600
    assert sums[0] == sums[1] and len({r[0] for r in sums[0]}) > 2 and len(sums[0]) > len({r[0] for r in sums[0]})
    for shard, file, size, _, sha in sums[0]:
        data = (tmp_path / "one" / file).read_bytes()
        assert (len(data), hashlib.sha1(data).hexdigest()) == (size, sha)


@needs_data
def test_ann_recall(spark):
    rows = table(spark, "embeddings").collect()
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in rows] + [(100_000 + i, [float(x) for x in rows[3].embedding]) for i in range(60)]
    found = collections.defaultdict(list)
    for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        found[r.query_id].append((r.rank, r.vec_id, r.score))
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    hits = []
    for i in np.flatnonzero(ids % 20 == 0):
        scores = (x * x[i]).sum(1)
        scores[i] = -np.inf
        best = np.lexsort((ids, -scores))[:20]
        got = sorted(found[ids[i]])
        assert [g[0] for g in got] == list(range(1, 21)) and all(g[2] == pytest.approx(float(x[i] @ x[list(ids).index(g[1])])) for g in got)
        hits.append(len({g[1] for g in got} & set(ids[best])) / 20)
    assert np.mean(hits) >= 0.9


def test_ann_odd_sizes(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(a) for a in rng.standard_normal(8) * 1e100]) for i in range(300)] + [(1000 + i, [1e100] * 8) for i in range(50)]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    for i in np.flatnonzero(ids % 20 == 0):
        scores = (x * x[i]).sum(1)
        own = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == ids[i])
        assert [r[0] for r in own] == list(range(1, 21)) and all(r[2] == scores[list(ids).index(r[1])] for r in own)
        assert [(-r[2], r[1]) for r in own] == sorted((-r[2], r[1]) for r in own)
    huge = [(i, [float(a) for a in np.abs(rng.standard_normal(8)) * 1e160]) for i in range(60)]  # products beyond a double
    got = ann.search(spark.createDataFrame(huge, "vec_id long, embedding array<double>")).collect()
    assert len(got) == 60 and {r.score for r in got} == {float("inf")}


def brute_components(texts):
    sets = {}
    for i, t in texts.items():
        w = t.lower().split()
        sets[i] = set(zip(*(w[k:] for k in range(4)))) if len(w) >= 4 else {tuple(w)} if w else set()
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(texts, 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in texts}


def test_neardup_crowds(spark):
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(5000)}"
    texts, number = {}, 0
    for size in (250, 40, 12, 3, 2, 2):
        base = [word() for _ in range(120)]
        for _ in range(size):
            own = list(base)
            for _ in range(rng.randint(0, 2)):
                own[rng.randrange(120)] = word()
            texts[number] = " ".join(own)
            number += 1
    passage = [word() for _ in range(60)]
    for _ in range(80):
        texts[number] = " ".join([word() for _ in range(60)] + passage)
        number += 1
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs).collect()}
    assert got == brute_components(texts)


def test_components(spark):
    pairs = [(i, i + 1) for i in range(30)] + [(100, 99), (98, 100), (50, 51)]
    links = spark.createDataFrame([(bytes([a]), bytes([b])) for a, b in pairs], "a binary, b binary")
    got = {bytes(r.node)[0]: bytes(r.root)[0] for r in neardup.components(links).collect()}
    assert got == {**{i: 0 for i in range(31)}, 98: 98, 99: 98, 100: 98, 50: 50, 51: 50}


def test_components_merged(spark):
    """Links in two halves against a union-find over all: long chains, hubs, new nodes, repeats, halves without links."""
    rng = np.random.default_rng(11)
    chain = [(i, i + 1) for i in range(0, 40)]
    hub = [(60, i) for i in range(61, 90)]
    loose = [tuple(int(x) for x in rng.choice(np.arange(90, 200), 2, replace=False)) for _ in range(70)]
    every = [(min(e), max(e)) for e in chain + hub + loose]
    as_links = lambda rows: spark.createDataFrame([(bytes([a]), bytes([b])) for a, b in rows], "a binary, b binary")
    for first, second in ((every[::2], every[1::2] + every[:9]), (every, []), ([], every), (every, every[:5])):
        roots = neardup.merged(neardup.components(as_links(first)), as_links(second))
        got = {r.node[0]: r.root[0] for r in roots.collect()}
        parent = {x: x for e in first + second for x in e}
        for _ in range(len(parent)):
            for a, b in first + second:
                parent[a] = parent[b] = min(parent[a], parent[b])
        assert got == parent
        assert roots.count() == len(parent)


def test_repeat_words():
    rng = random.Random(5)
    for _ in range(50):
        words = [rng.choice("abc") for _ in range(rng.randint(0, 30))]
        windows = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        covered = {i + d for i in range(len(words) - 4) for d in range(5) if windows[tuple(words[i : i + 5])] > 1}
        assert quality_rules.repeat_words([w.encode() for w in words]) == len(covered)


def test_host_verdicts(spark):
    good, bad, soft = " ".join(f"word{i}" for i in range(30)), "too short", " ".join(f"w#{i}" for i in range(30))
    rows = [(i, good, "fine") for i in range(40)] + [(100 + i, bad if i % 10 else soft, "poor") for i in range(40)] + [(200, soft, "fine"), (201, good, "poor"), (300, bad, "new")]
    got = {r.doc_id: r for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[200].kept and not got[100].kept and got[201].kept and not got[101].kept
    assert got[100].host_rate > 0.9 > got[300].host_rate > got[0].host_rate


def test_junk_goes_on_any_host(spark):
    good, soft, junk = " ".join(f"word{i}" for i in range(30)), " ".join(f"w#{i}" if i % 2 else f"w##{i}" for i in range(16)) + " word" * 4, " ".join(f"w***{i}" for i in range(30))
    rows = [(i, good, f"s{i % 10}") for i in range(200)] + [(1000 + i, junk, f"s{i % 10}") for i in range(10)]
    rows += [(2000 + i, good if i % 2 else soft, "worse") for i in range(40)]
    got = {r.doc_id: r for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not any(got[1000 + i].kept for i in range(10)) and all(got[i].kept for i in range(200))
    assert not got[2000].kept and got[2001].kept  # a host with many failures, below one half


def test_network_gradients():
    s = lm.Settings(hidden=5, classes=3, streams=2, window=3, epochs=1, unknown_inputs=2)
    net = lm.Network.fresh(np.array([5.0, 2, 9, 4, 1, 3, 2]), s)
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    h, t = np.random.default_rng(0).standard_normal((6, 5)) * 0.5, np.array([0, 2, 3, 6, 2, 1])
    grads = {}
    net.log_probs(h, t, grads)
    for name in grads:
        at = tuple(0 for _ in grads[name].shape) if name != "word_b" else (0, 1)
        values = []
        for step in (1e-5, -1e-5):
            net.weights[name][at] += step
            values.append(-net.log_probs(h, t)[0].mean())
            net.weights[name][at] -= step
        assert (values[0] - values[1]) / 2e-5 == pytest.approx(grads[name][at], abs=1e-6)
    whole = sum(np.exp(net.log_probs(h[:1], np.array([w]))[0][0]) for w in range(7))
    assert whole == pytest.approx(1, abs=1e-6)


def test_state_is_carried():
    s = lm.Settings(hidden=6, classes=3, unknown_inputs=2)
    net = lm.Network.fresh(np.array([5.0, 2, 9, 4, 1, 3, 2]), s)
    rng = np.random.default_rng(1)
    sequences = [(rng.integers(0, 9, n).astype(np.int32), rng.integers(0, 7, n)) for n in (1, 50, 7, 0 + 33)]
    whole = lm.network_scores(net, sequences, 1000)
    assert lm.network_scores(net, sequences, 8) == pytest.approx(whole, rel=1e-4)
    for (i, t), score in zip(sequences, whole):
        h, total = np.zeros((1, 6), np.float32), 0.0
        for a, b in zip(i, t):
            h = net.step(np.array([a]), h)[0]
            total += net.log_probs(h, np.array([b]))[0][0]
        assert total / np.log(10) == pytest.approx(score, rel=1e-4)


@needs_data
def test_lm_base_and_gain(spark):
    docs = table(spark, "documents")
    words = {r.doc_id: (r.text or "").encode().lower().split() for r in docs.collect()}
    seen, ends = collections.Counter(), 0
    for i, w in words.items():
        if zlib.crc32(str(i).encode()) % 10:
            seen.update(w)
            ends += 1
    n, v = sum(seen.values()) + ends, len(seen) + 1
    got = lm.score(docs, *lm.fit(docs)).collect()
    for r in got:
        w = words[r.doc_id]
        base = sum(np.log10((seen[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w) + np.log10((ends + 0.1) / (n + 0.1 * (v + 1)))
        assert r.base_score == pytest.approx(base) and (r.n_tokens, r.n_known, r.train_tokens) == (len(w) + 1, sum(seen[x] > 0 for x in w) + 1, n)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 10 == 0)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


@needs_data
def test_pipeline(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = table(spark, "documents").limit(200).unionByName(spark.createDataFrame([(10_001, "12 34", "en", "src0", 5)], "doc_id long, text string, lang string, source string, n_chars long"))
    columns, kept = docs.columns, {}
    for name, stage in pipeline.STAGES[:4]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        assert docs.columns == columns
        kept[name] = {r.doc_id for r in docs.collect()}
    assert 10_001 not in kept["language ID"] and len(kept["language ID"]) == 200
    assert kept["MinHash near-dedup"] <= kept["quality rules"] <= kept["language ID"]
    encoding = bpe.load_encoding(RANKS, public_tokenizers.PATTERN)
    expected = collections.Counter((r.doc_id, len(encoding.encode_ordinary(r.text))) for r in docs.collect())
    assert collections.Counter((r.doc_id, r.n_tokens) for r in pipeline.STAGES[4][1](spark, docs, SF).collect()) == expected


def test_warc_ids_far_apart(spark, tmp_path):
    rows = [(i, f"h{i}", f"page {i % 50}" * 50) for i in range(1000)] + [(4 * 10**15, "far", "x"), (-9 * 10**18, "low", "y"), (9 * 10**18, "high", "z")]
    rows += [(None, None, f"none {i % 400}" * 40) for i in range(1000)] + [(7, "dup", None)] * 3
    files = warc.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string"), f"file://{tmp_path}/far", warc.Settings(shard_bytes_low=20_000))
    sizes = [r.records for r in files.collect()]
    assert sum(sizes) == len(rows) and len(sizes) > 20 and max(sizes) < 200  # rows without an id included
    back = warc.read_archive(spark, f"file://{tmp_path}/far", files)
    assert back.rdd.getNumPartitions() == files.select("shard").distinct().count()
    newest, count = {}, collections.Counter(r.page_id for r in back.collect())
    for i, _, html in rows:
        newest[html or ""] = max(newest.get(html or "") if newest.get(html or "") is not None else -(2**63), i if i is not None else -(2**63))
    assert count == collections.Counter(r[0] for r in rows)
    assert back.where("record_type = 'response'").count() == len(newest)
