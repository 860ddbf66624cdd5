"""Near duplicates, quality, language model, shards and the pipeline against plain versions."""

import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgrade.llm import common, knn_quality, near_dedup, pseudo_likelihood, sharding

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def brute_components(docs, width, percent):
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    sets = []
    for _, t in docs:
        w = lower(t).encode().split()
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    linked = [(i, j) for i in range(len(docs)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    label = list(range(len(docs)))
    for _ in docs:
        for i, j in linked:
            label[i] = label[j] = min(label[i], label[j])
    ids = {}
    for (d, _), x in zip(docs, label):
        ids[x] = min(ids.get(x, d), d)
    return {d: (len(s), ids[x]) for (d, _), s, x in zip(docs, sets, label)}


def corpus():
    r = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    docs = [(0, None), (1, ""), (2, " \n"), (3, "one"), (4, "One"), (5, "one two"), (6, "é É")]
    base = [r.choice(words) for _ in range(120)]
    drift = list(base)
    for i in range(60):  # a chain of copies, each a little further away
        drift[r.randrange(len(drift))] = r.choice(words)
        docs.append((10 + i, " ".join(drift)))
    for i in range(40):
        near = list(base)
        for _ in range(r.randrange(12)):
            near[r.randrange(len(near))] = "x%d" % r.randrange(10**6)
        docs.append((100 + i, " ".join(near)))
    common = " ".join(r.choice(words) for _ in range(30))
    docs += [(200 + i, common + " " + " ".join(r.choice(words) for _ in range(40))) for i in range(40)]
    docs += [(300 + i, docs[20][1].upper()) for i in range(5)]
    r.shuffle(docs)
    return docs


@pytest.mark.parametrize("width, percent, small, blocks", [(3, 85, 1024, None), (5, 80, 1024, None), (3, 85, 4, None), (5, 80, 4, 7)])
def test_components_equal_brute_force(spark, monkeypatch, width, percent, small, blocks):
    """Groups above ``small`` branch further; with ``blocks`` every comparison is cut into many blocks."""
    monkeypatch.setattr(near_dedup, "SMALL", small)
    if blocks:
        monkeypatch.setattr(near_dedup, "BLOCK", blocks)
        monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", 400)
        monkeypatch.setattr(near_dedup, "BROADCAST_BYTES", 0)
    docs = corpus()
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, uid int")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(df, width=width, percent=percent).collect()}
    assert got == brute_components(docs, width, percent)


def test_a_family_meets_once_on_full_sets(spark, monkeypatch):
    """Near copies that share most groups of all trees go to the blocks of full sets once, not once a tree, and no link is lost."""
    r = random.Random(11)
    base = [f"w{i}" for i in range(120)]
    docs = []
    for i in range(150):
        near = list(base)
        for _ in range(r.randrange(9)):
            near[r.randrange(len(near))] = "x%d" % r.randrange(10**6)
        docs.append((i, " ".join(near)))
    sent, by_block = [], near_dedup._by_block

    def counted(rows, plain, nested, *more):
        if "shingles" in nested:
            sent.append(rows.count())
        return by_block(rows, plain, nested, *more)

    monkeypatch.setattr(near_dedup, "_by_block", counted)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(df, width=5, percent=80).collect()}
    assert got == brute_components(docs, 5, 80)
    assert 0 < sum(sent) <= 4 * len(docs)


def test_empty_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (2, "a b c d")], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(df).collect())
    assert got == [("1", 1, True), ("1", 1, True), ("2", 1, False), ("None", 1, False)]
    assert near_dedup.near_duplicates(df.limit(0)).count() == 0


def test_a_pair_parted_in_a_large_group_is_found_elsewhere(spark, monkeypatch):
    """Tree 0 holds all in one group that branches; pairs that its levels part must be compared by later trees."""
    monkeypatch.setattr(near_dedup, "SMALL", 4)
    monkeypatch.setattr(near_dedup, "DEPTH", 2)
    r = random.Random(8)
    minwise = near_dedup.minwise

    def one_group(sets):
        out = minwise(sets)
        out[:, 0] = 7
        return out

    monkeypatch.setattr(near_dedup, "minwise", one_group)
    docs = []
    for pair in range(40):
        words = [f"p{pair}w{r.randrange(10**6)}" for _ in range(100)]
        docs.append((2 * pair, " ".join(words)))
        words[50] = "other"
        docs.append((2 * pair + 1, " ".join(words)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    nodes = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(df, width=3, percent=85).collect()}
    assert nodes == {d: d // 2 * 2 for d, _ in docs}


def test_one_document_of_each_group_stays(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text, 5), (2, text + " end", 6), (None, text, 7), (3, "other words here", 8), (3, text, 9), (4, None, 1), (5, "", 2), (4, None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, gone int")
    left = sorted(near_dedup.keep_one(df).collect(), key=str)
    assert left == sorted(df.where("gone in (5, 8, 1, 2)").collect(), key=str)
    assert near_dedup.keep_one(df.limit(0)).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(200, 201), (201, 200)], "a long, b long")
    got = {r["uid"]: r["label"] for r in near_dedup.components(edges).collect()}
    assert got == {i: 0 for i in range(101)} | {200: 200, 201: 200}


@tables
def test_quality_on_held_out_labels(spark):
    big = SF.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    rows = knn_quality.digest(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 100 and np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.95
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in rows)


def test_votes_equal_plain_loops(spark):
    r = random.Random(9)
    texts = [None, "", "one"] + [" ".join(r.choice(["word", "Text", "###", "12", "x!", "zz"]) + r.choice(["", "s", "!"]) for _ in range(r.randrange(1, 60))) for _ in range(60)]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(r.random() < 0.6)) for i in range(0, 60, 2)], "doc_id long, quality int")
    model = knn_quality.fit(docs, labels)
    held = [set(knn_quality.term_counts([(t or "").encode()])[1].tolist()) for t in texts]
    n = sum(map(bool, held))
    df = np.array([sum(k in h for h in held) for k in range(knn_quality.TERMS)])
    weight = np.log((1 + n) / (1 + df)) + 0.1
    weight[: knn_quality.WORD_TERMS] *= 0.3
    assert np.allclose(model.weight, weight)

    def unit(t):
        _, terms, shares = knn_quality.term_counts([(t or "").encode()])
        x = np.zeros(knn_quality.TERMS)
        x[terms] = np.sqrt(shares) * weight[terms]
        y = (x / (np.linalg.norm(x) or 1)) @ model.v
        return y / np.linalg.norm(y) if np.linalg.norm(y) > 1e-6 else y

    def plain(t):
        sims = [(float(unit(t) @ v), float(y)) for v, y in zip(model.labelled, model.labels)]
        near = sorted(sims, key=lambda s: -s[0])[: model.neighbours]
        votes = [(max(s, 0) ** 4, y) for s, y in near]
        total = sum(v for v, _ in votes)
        return sum(v * y for v, y in votes) / total if total else model.mean

    got = {x["doc_id"]: x["score"] for x in knn_quality.score(docs.union(docs), model).collect()}
    assert all(abs(got[i] - plain(t)) < 1e-3 for i, t in enumerate(texts))
    long = spark.createDataFrame([(1, "word " * 300_000), (2, "word " * 3)], "doc_id long, text string")
    assert all(0 <= x["score"] <= 1 for x in knn_quality.score(long, model).collect())


def test_arrays_are_summed(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(300)], "some long, value array<double>")
    assert common.sum_arrays(df).tolist() == [sum(range(300)), 300] and common.sum_arrays(df.limit(0)) is None


def test_quality_without_labels_and_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 0.1), (2, "", 0.2), (3, "a b c", 0.3)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(3, 1), (None, 0), (1, None)], "doc_id long, quality int")
    scores = {r["doc_id"]: r["score"] for r in knn_quality.digest(docs, labels).collect()}
    assert all(0 <= s <= 1 for s in scores.values()) and scores[1] == scores[2]
    assert [r["score"] for r in knn_quality.digest(docs, labels.limit(0)).collect()] == [0.5] * 3
    assert knn_quality.keep_good(docs, labels).columns == docs.columns
    assert knn_quality.digest(docs.limit(0), labels).count() == 0


def test_network_sums_to_one_and_scores_by_definition(spark):
    rng = np.random.default_rng(3)
    net = pseudo_likelihood.Network(rng.standard_normal(pseudo_likelihood.Network().flat.size) * 0.2)
    around = rng.integers(0, pseudo_likelihood.PAD + 1, (1, 4))
    every = np.arange(pseudo_likelihood.PAD)
    assert abs(np.exp(net.log_probs(np.repeat(around, len(every), axis=0), every)).sum() - 1) < 1e-3
    docs = spark.createDataFrame([(1, "a b c a"), (2, None), (3, "A"), (1, "zz a"), (None, ""), (4, "b"), (4, "b")], "doc_id long, text string")
    counts = pseudo_likelihood.word_counts(docs)
    for words in (pseudo_likelihood.vocabulary(counts), pseudo_likelihood.Vocabulary([], *grouped(counts))):
        rows = pseudo_likelihood.word_ids(docs, words)
        got = sorted(((r["key"], r["n_tokens"], r["log_prob"], r["mean_log_prob"]) for r in pseudo_likelihood.score(rows, words, net, counts).collect()), key=str)
        n = Counter(w for t in ("a b c a", "a", "zz a", "b", "b") for w in t.split())
        alike = lambda w: [x for x in n if x[-1] == w[-1]]
        want = []
        for d, t in [(1, "a b c a"), (2, ""), (3, "a"), (1, "zz a"), (None, ""), (4, "b"), (4, "b")]:
            tokens = t.split()
            ids = words.ids_of(pseudo_likelihood.word_keys([t.encode()])[0]).tolist()
            padded = [pseudo_likelihood.PAD] * 2 + ids + [pseudo_likelihood.PAD] * 2
            total = sum(net.log_probs(np.array([[*padded[i : i + 2], *padded[i + 3 : i + 5]]]), np.array([ids[i]]))[0] for i in range(len(ids)))
            for w, i in zip(tokens, ids):
                if i >= pseudo_likelihood.WORDS:
                    total += np.log((n[w] - 1 + 0.1) / (sum(n[x] for x in alike(w)) - 1 + 0.1 * len(alike(w))))
            want.append((d, len(tokens), total, total / len(tokens) if tokens else None))
        assert [(g[0], g[1]) for g in got] == [(w[0], w[1]) for w in sorted(want, key=str)]
        assert np.allclose(sorted(g[2] for g in got), sorted(w[2] for w in want), atol=1e-4)
    assert sum(g[3] is None for g in got) == 2


def grouped(counts):
    n, kinds = np.zeros(pseudo_likelihood.RARE), np.zeros(pseudo_likelihood.RARE)
    for r in counts.collect():
        n[r["word"] % pseudo_likelihood.RARE] += r["n"]
        kinds[r["word"] % pseudo_likelihood.RARE] += 1
    return n, kinds


def test_gradients_equal_differences():
    """Each parameter block's gradient against central differences of the mean loss, in double precision."""

    class Exact(pseudo_likelihood.Network):
        DTYPE = np.float64

        def _step(self, name, at, grad, seen):
            seen.setdefault(name, np.zeros(self.SHAPES[name]))[at] += grad

    rng = np.random.default_rng(4)
    net = Exact(rng.standard_normal(pseudo_likelihood.Network().flat.size) * 0.3)
    around, target = rng.integers(0, pseudo_likelihood.PAD + 1, (50, 4)), rng.integers(0, pseudo_likelihood.PAD, 50)
    around[:, 1] = 7
    grads: dict = {}
    net.learn(around, target, grads)
    for name, grad in grads.items():
        own = getattr(net, name).reshape(-1)
        for i in np.argsort(-np.abs(grad.reshape(-1)))[:4].tolist() + rng.integers(0, own.size, 2).tolist():
            loss = []
            for d in (1e-4, -2e-4):
                own[i] += d
                loss.append(-net.log_probs(around, target).mean())
            own[i] += 1e-4
            assert abs((loss[0] - loss[1]) / 2e-4 - grad.reshape(-1)[i]) < 1e-6, name


def test_training_prefers_the_order_it_saw(spark):
    r = random.Random(1)
    texts = [" ".join(f"k{(s + i) % 50}" for i in range(60)) for s in (r.randrange(50) for _ in range(300))]
    mixed = [" ".join(r.sample(t.split(), 60)) for t in texts[:30]]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    counts = pseudo_likelihood.word_counts(docs)
    words = pseudo_likelihood.vocabulary(counts)
    net = pseudo_likelihood.train(pseudo_likelihood.word_ids(docs, words), 3)

    def mean(ts):
        own = spark.createDataFrame([(i, t) for i, t in enumerate(ts)], "doc_id long, text string")
        return pseudo_likelihood.score(pseudo_likelihood.word_ids(own, words), words, net, counts).agg(F.avg("mean_log_prob")).first()[0]

    assert mean(texts[:30]) > mean(mixed) + 0.5
    assert pseudo_likelihood.lm_scores(docs.limit(0)).count() == 0


def test_parameters_are_averaged_by_positions(spark):
    parts = [(b, p // 2, float(p + 1), [float(p), 2.0 * b]) for b in (0, 1024) for p in range(5)]
    df = spark.createDataFrame(parts, "block long, some long, positions double, own array<float>")
    got = {r["block"]: r["own"] for r in pseudo_likelihood._averaged(df).collect()}
    assert np.allclose(got[0], [sum(p * (p + 1) for p in range(5)) / 15, 0]) and np.allclose(got[1024], [sum(p * (p + 1) for p in range(5)) / 15, 2048])


def test_corpus_counts_tell_words_apart(spark):
    """Words outside the vocabulary: one that stands twice is likelier than one that stands once; odd columns and long texts pass."""
    base = " ".join(f"common{i}" for i in range(50))
    rows = [(i, base, "x") for i in range(30)] + [(100, "onceword " * 1, "y"), (101, "twiceword", "y"), (102, "twiceword", "y"), (103, "w " * 400_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    counts = pseudo_likelihood.word_counts(docs)
    words = pseudo_likelihood.Vocabulary([], *grouped(counts))
    own = pseudo_likelihood.word_ids(docs, words)
    got = {r["key"]: r for r in pseudo_likelihood.score(own, words, pseudo_likelihood.Network(), counts).collect()}
    assert got[101]["log_prob"] > got[100]["log_prob"] + 1 and got[101]["log_prob"] == got[102]["log_prob"] and got[103]["n_tokens"] == 400_000
    assert len({round(got[i]["log_prob"], 9) for i in range(30)}) == 1


def test_hilbert_steps_are_adjacent():
    grid = np.array([(a, b, c) for a in range(8) for b in range(8) for c in range(8)])
    h = sharding.hilbert_index(grid, 3)
    assert sorted(h) == list(range(512)) and (np.abs(np.diff(grid[np.argsort(h)], axis=0)).sum(axis=1) == 1).all()


def test_shards_are_even_and_gapless(spark):
    r = random.Random(2)
    rows = [(i, None if i % 50 == 0 else "t" * r.randrange(400), "hot" if i % 3 else f"s{r.randrange(20)}", None if i % 9 == 0 else "en") for i in range(1003)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    got = sharding.document_shards(docs).collect()
    by = {}
    for x in got:
        by.setdefault(x["shard"], []).append(x)
    assert sorted(by) == list(range(40)) and {len(v) for v in by.values()} == {25, 26}
    assert all(sorted(x["slot"] for x in v) == list(range(len(v))) for v in by.values())
    text = {i: t for i, t, _, _ in rows}
    assert all(x["size"] == len((text[x["doc_id"]] or "").encode()) + 16 and x["text_crc32"] == zlib.crc32((text[x["doc_id"]] or "").encode()) for x in got)
    assert sharding.document_shards(docs.limit(0)).count() == 0


def test_placement_equals_plain_sorting(spark):
    """Cells by plain counting, order by plain sorting; one odd value doesn't merge the cells of the others."""
    r = random.Random(4)
    rows = [(i, r.choice(["https://a/%03d" % r.randrange(200), "https://a/hot", None]) if i else "web", r.randrange(1000) if i % 7 else None, "c%d" % r.randrange(3), "x") for i in range(900)]
    rows += rows[:40]
    df = spark.createDataFrame(rows, "doc_id long, url string, n long, t string, slot string")
    got = sharding.hilbert_shards(df, ["url", "n"], "doc_id", 7, together=("t",)).collect()
    urls = sorted(u for _, u, *_ in rows if u)
    cell = {u: urls.index(u) * 32 // len(urls) for u in urls}
    cut = [min(u for u in cell if cell[u] == c) for c in sorted(set(cell.values())) if c]
    numbers = sorted(n for _, _, n, *_ in rows if n is not None)
    cuts = sorted({numbers[max(0, -(-len(numbers) * k // 32) - 1)] for k in range(1, 32)})
    cells = np.array([(sum(u >= c for c in cut) if u else 0, sum(n >= c for c in cuts) if n is not None else 0) for _, u, n, *_ in rows])
    assert len(set(cells[:, 0])) > 15
    h = sharding.hilbert_index(cells, 5).tolist()
    first = lambda x: (x is not None, x)
    want = sorted((a, t, d, first(u), first(n)) for a, (d, u, n, t, _) in zip(h, rows))
    own = sorted(got, key=lambda x: x["position"])
    assert [(x["hilbert"], x["t"], x["doc_id"], first(x["url"]), first(x["n"])) for x in own] == want
    assert [x["position"] for x in own] == list(range(940)) and all(x["slot"] == "x" for x in own)
    assert [(x["shard"], x["_slot"]) for x in own] == [(s, k) for s in range(7) for k in range(-(-(s + 1) * 940 // 7) - -(-s * 940 // 7))]
    same = sharding.hilbert_shards(df.withColumn("url", F.lit("one")).withColumn("n", F.lit(None).cast("long")), ["url", "n"], "doc_id", 7).collect()
    assert {x["hilbert"] for x in same} == {0} and len({x["shard"] for x in same}) == 7


def test_pipeline_stages_on_odd_rows(spark, tmp_path):
    """Null and repeated keys, null, empty and equal texts, a further column with a name that stages use, and no rows at all."""
    import corpus_pipeline as P

    r = random.Random(7)
    texts = [" ".join(f"w{r.randrange(500)}" for _ in range(60)) for _ in range(13)]
    rows = [(i, t) for i, t in enumerate(texts[:12])] + [(20, texts[0]), (None, texts[1]), (3, texts[3]), (3, "quite another text of few words"), (21, None), (22, ""), (None, None), (23, "mail me@example.org " + texts[12])]
    docs = spark.createDataFrame([(d, t, "en", None, len(t or ""), "clash") for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long, n_tokens string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0), (1, 1, 0), (None, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([("a", texts[2]), (None, None)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = P.run(spark, str(tmp_path))
    got = sorted(((x["doc_id"], x["text"]) for x in out.collect()), key=str)
    assert set(docs.columns) <= set(out.columns)
    ids = [d for d, _ in got]
    assert 2 not in ids and 20 not in ids and {0, 1, 4, 6, 11, 23} <= set(ids) and ids.count(3) == 3
    assert all(t is None or "me@example.org" not in t for _, t in got)
    for name, stage in P.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name


@tables
def test_pipeline_equals_its_stages(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, ids = docs.columns, None
    for name, stage in P.STAGES:
        out = stage(spark, docs, SF)
        kept = {r["doc_id"] for r in out.select("doc_id").collect()}
        if name.startswith("MinHash"):
            rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
            assert kept == {d for d, (_, c) in brute_components(rows, 5, 80).items() if d == c}
        if name == "PII":
            assert kept == ids and out.columns == columns
        ids = kept
        docs = out if name.startswith("BPE") else spark.createDataFrame(out.collect(), out.schema)
    assert {r["doc_id"] for r in P.run(spark, SF).collect()} == ids
    assert set(columns) <= set(docs.columns)
