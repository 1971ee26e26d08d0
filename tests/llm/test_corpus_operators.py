"""Near-duplicates, decontamination, classifiers, the language model and the pipeline against brute force."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from twinlens.llm import common, decontamination, lm, quality, simhash, toxicity, vectors
from twinlens.llm.forest import Forest, components

DOCS = "doc_id long, text string, row long, fp string"


def table(spark, texts, start=0):
    return spark.createDataFrame([(i + start, t, 1, "x") for i, t in enumerate(texts)], DOCS)


def union(n, links):
    up = list(range(n))

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [root(x) for x in range(n)]


def test_forest():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 300, 400), rng.integers(0, 300, 400)
    want = union(300, zip(a.tolist(), b.tolist()))
    ids, roots = components(a, b)
    assert all(want[i] == r for i, r in zip(ids.tolist(), roots.tolist()))
    forest = Forest(most=50)
    for i in range(0, 400, 10):
        forest.add(a[i : i + 10], b[i : i + 10])
    x, y = forest.links()
    assert union(300, zip(x.tolist(), y.tolist())) == want


def test_connected_components(spark):
    rng = np.random.default_rng(2)
    links = [*zip(range(60), range(1, 61)), *((100, x) for x in range(101, 160)), *((int(a), int(b)) for a, b in rng.integers(200, 400, (150, 2)))]
    want = union(400, links)
    edges = spark.createDataFrame([*links, (5, 5), (None, 3), (61, 60)][:-1], "a long, b long")
    got = {r["id"]: r["component_id"] for r in common.connected_components(edges).collect()}
    assert got == {i: want[i] for i in {x for e in links if e[0] != e[1] for x in e}}
    assert common.connected_components(edges.limit(0)).count() == 0


def words(rng, n):
    return " ".join(f"w{x}" for x in rng.integers(0, 5000, n))


def simhash_brute(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([b" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark):
    rng = np.random.default_rng(3)
    base = [words(rng, 400) for _ in range(25)]
    texts = [*base, *(b + " tail" for b in base[:10]), *("lead " + b for b in base[5:15]), base[0], base[0].upper(), None, "", " \t\n", "One Two", "one  two", "Ä b", words(rng, 9000)]
    fps = [simhash_brute(t) for t in texts]
    want = union(len(texts), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    docs = table(spark, texts)
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    assert all(got[i]["fingerprint"] == f"{fps[i]:016x}" and got[i]["component_id"] == want[i] for i in range(len(texts)))
    again = docs.unionByName(docs.where("doc_id in (0, 3)")).unionByName(docs.where("doc_id = 2").withColumn("doc_id", F.lit(None).cast("long")))
    kept = simhash.drop_near_duplicates(again)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want))
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 and simhash.drop_near_duplicates(docs.limit(0)).count() == 0


def test_simhash_splits_large_groups(spark, monkeypatch):
    rng = np.random.default_rng(4)
    center = int(rng.integers(0, 2**63))
    near = {center ^ sum(1 << int(b) for b in rng.choice(63, rng.integers(0, 4), replace=False)) for _ in range(300)}
    fps = sorted(near | {int(x) for x in rng.integers(0, 2**63, 200)})
    monkeypatch.setattr(simhash, "BLOCK", 40)
    df = common.materialize(spark.createDataFrame([(f,) for f in fps], "fp long"), "t")
    links = [(r["a"], r["b"]) for r in simhash.fingerprint_links(df).collect()]
    at = {f: i for i, f in enumerate(fps)}
    brute = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4]
    assert union(len(fps), [(at[a], at[b]) for a, b in links]) == union(len(fps), brute)


def test_allocation_is_least():
    rng = np.random.default_rng(5)
    for _ in range(20):
        costs = [[0.0, *np.sort(rng.random(5) * 100).tolist()] for _ in range(3)]
        total, t = simhash.allocate(costs, 5)
        every = [(a, b, 5 - a - b) for a in range(6) for b in range(6 - a)]
        assert sum(x + 1 for x in t) == 5 and total == pytest.approx(min(sum(c[x] for c, x in zip(costs, e)) for e in every))
    groups = simhash.group_bits(np.eye(64), 5)
    assert sorted(b for g in groups for b in g) == list(range(64)) and {len(g) for g in groups} == {12, 13}


@pytest.mark.parametrize("block", [2048, 16])
def test_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "BLOCK", block)
    rng = np.random.default_rng(6)
    centers = rng.normal(size=(12, 16))
    rows = []
    for i in range(260):
        v = centers[i % 12] + rng.normal(size=16) * (0.2 if i % 3 else 0.0)
        rows.append((i, [float(x) for x in v], i % 2))
    rows += [(300, None, 1), (301, [], 1), (302, [0.0] * 16, 1), (303, [float("nan")] * 16, 1), (304, [None, 1.0], 1), (305, rows[0][1], None), (306, [float("inf")] * 16, 0), (307, [2 * x for x in rows[0][1]], 0), (308, [1e30] * 16, 0), (309, [1e-30] * 16, 0)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, key string")
    got = {r["vec_id"]: r for r in vectors.near_duplicate_vectors(df).collect()}
    fit = [i for i, (_, v, y) in enumerate(rows) if y is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links = []
    for p, i in enumerate(fit):
        for j in fit[:p]:
            a, b = np.array(rows[i][1]), np.array(rows[j][1])
            if rows[i][2] == rows[j][2] and len(a) == len(b) and a / np.abs(a).max() @ (b / np.abs(b).max()) / np.linalg.norm(a / np.abs(a).max()) / np.linalg.norm(b / np.abs(b).max()) >= 0.93:
                links.append((i, j))
    want, degree = union(len(rows), links), Counter(x for link in links for x in link)
    assert len(got) == len(rows)
    for i, (vec, _, _) in enumerate(rows):
        assert (got[vec]["n_links"], got[vec]["component_id"], got[vec]["kept"]) == (degree[i], rows[want[i]][0], rows[want[i]][0] == vec)
    assert vectors.near_duplicate_vectors(df.limit(0)).count() == 0


def plain_words(text):
    import re

    return re.findall(r"[^\W_]+", (text or "").lower())


def windows(w, n):
    return {" ".join(w[i : i + n]) for i in range(len(w) - n + 1)}


def test_decontamination(spark, monkeypatch):
    rng = np.random.default_rng(7)
    items = [words(rng, int(n)) for n in rng.integers(1, 60, 40)] + [None, "", "!!", "two words", "The capital of France", "one"]
    texts = [words(rng, 300) for _ in range(40)]
    for i in range(0, 40, 2):
        part = items[i].split()
        cut = part[: max(1, int(len(part) * rng.uniform(0.6, 1.0)))]
        texts[i] += " . " + ", ".join(cut).upper() + " " + words(rng, 2000)
    texts += [None, "", "Two, WORDS!", items[5], items[5], "What is the capital, of FRANCE?", "two and words", "by two words", words(rng, 30000) + " one " + words(rng, 30000)]
    docs, bench = table(spark, texts), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = {}
    for d, t in enumerate(texts):
        for i, s in enumerate(items):
            n = min(5, len(plain_words(s)))
            a, b = (windows(plain_words(x), n) if n else set() for x in (s, t))
            if a and len(a & b) / len(a) >= 0.8:
                want[d, i] = len(a & b) / len(a)
    got = {(r["doc_id"], r["item_id"]): r["containment"] for r in decontamination.contamination(docs, bench).collect()}
    assert got == pytest.approx(want) and len(want) > 10 and {(45, 44), (47, 43), (48, 45)} <= set(want) and (46, 43) not in want
    kept = decontamination.decontaminate(docs, bench)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == set(range(len(texts))) - {d for d, _ in want}
    assert decontamination.contamination(docs.limit(0), bench).count() == 0 and decontamination.decontaminate(docs, bench.limit(0)).count() == len(texts)
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", 40)
    for most in (0, 1000):  # sketches joined by a shuffle, then broadcast in parts
        monkeypatch.setattr(decontamination, "SKETCH_PARTS", most)
        assert {(r["doc_id"], r["item_id"]) for r in decontamination.contamination(docs, bench).collect()} == set(want)
    plan = decontamination.contamination(docs, bench)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_short_items_match_sql(spark):
    """The query's SQL finds short items in long documents as the operator does."""
    import duckdb

    from twinlens.llm.queries import ORACLE_SQL

    con = duckdb.connect()
    texts = ["what is the capital of france, asked the old man", "capital of", "of france the capital", None, "", "a b c d e f"]
    items = ["the capital of france", "capital", "a b c d e", None, "e f"]
    con.sql("create table documents as select * from (values " + ", ".join(f"({i}, {'NULL' if t is None else repr(t)})" for i, t in enumerate(texts)) + ") t(doc_id, text)")
    con.sql("create table benchmark as select * from (values " + ", ".join(f"({i}, {'NULL' if t is None else repr(t)})" for i, t in enumerate(items)) + ") t(item_id, text)")
    want = {r[:2] for r in con.sql(ORACLE_SQL["op4_decontamination"]).fetchall()}
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.contamination(table(spark, texts), bench).collect()}
    assert got == want == {(0, 0), (0, 1), (1, 1), (2, 1), (5, 2), (5, 4)}


def test_helper_columns_clash_with_nothing(spark):
    """Filters keep columns named like their own helpers, and columns of kinds that can't be ordered."""
    ddl = "doc_id long, text string, row long, row_ string, nth int, times map<string,int>, `a.b` string"
    rows = [(i, t, 7, "r", 3, {"k": i}, "p") for i, t in enumerate(["one two three four five six", "one two three four five six", None, "", "seven eight nine ten eleven"])] + [(4, "seven eight nine ten eleven", 7, "r", 3, {"a": 1}, "p")]
    docs = spark.createDataFrame(rows, ddl)
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted((r["doc_id"], r["row"], r["row_"], r["nth"], r["a.b"], tuple(r["times"])) for r in kept.collect()) == [(0, 7, "r", 3, "p", ("k",)), (2, 7, "r", 3, "p", ("k",)), (4, 7, "r", 3, "p", ("a",))]
    bench = spark.createDataFrame([(1, "seven eight nine ten eleven"), (2, None)], "item_id long, text string")
    left = decontamination.decontaminate(docs, bench)
    assert left.columns == docs.columns and sorted(tuple(r)[:4] for r in left.collect()) == [(i, t, 7, "r") for i, t, *_ in rows[:4]]
    assert decontamination.decontaminate(docs.limit(0), bench).count() == 0


def classified(spark, small, module, label, mod, rest):
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "x"), (-3, "x")], "doc_id long, text string")
    held = common.crc_mod(F.col("doc_id"), mod) == rest
    out = module.classify(docs.select("doc_id", "text").unionByName(odd), labels, held).toPandas()
    assert len(out) == docs.count() + 4 and out.score.between(0, 1).all() and (out.predicted == (out.score >= 0.5)).all()
    assert (out.held_out == [zlib.crc32(str(i).encode()) % mod == rest for i in out.doc_id]).all()
    met = out.merge(labels.toPandas(), on="doc_id")
    return met[met.held_out], met[~met.held_out], label


def test_quality(spark, small):
    held, _, label = classified(spark, small, quality, "quality", 3, 1)
    assert (held.predicted == held[label]).mean() > 0.95
    docs = table(spark, ["a b", None])
    empty = spark.createDataFrame([], "doc_id long, quality int")
    assert [r["score"] for r in quality.classify(docs, empty, F.lit(False)).collect()] == [0.5, 0.5]
    assert quality.classify(docs.limit(0), empty, F.lit(False)).count() == 0


def test_quality_votes(spark, small):
    """Every score is the weighted vote of the exact nearest neighbours, found one document at a time in double precision."""
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    held = common.crc_mod(F.col("doc_id"), 3) == 1
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "x"), (-4, "Some words. " * 20000)], "doc_id long, text string")
    docs = docs.select("doc_id", "text").unionByName(odd)
    votes = quality.fit(docs, labels, ~held)
    got = {r["doc_id"]: r["score"] for r in quality.classify(docs, labels, held).collect()}
    sampled = votes.vectors.astype(float)
    assert np.allclose(np.linalg.norm(sampled, axis=1), 1, atol=1e-5) and len(sampled) == len(votes.labels) > 20
    for r in docs.collect():
        z = (quality.terms((r["text"] or "").encode()).astype(float) * votes.weights) @ votes.projection
        z /= max(np.linalg.norm(z), 1e-12)
        cosines = [float(np.dot(z, v)) for v in sampled]
        near = sorted(range(len(cosines)), key=lambda i: -cosines[i])[: quality.NEIGHBOURS]
        weight = [math.exp((cosines[i] - cosines[near[0]]) / quality.TEMPERATURE) * votes.class_weights[i] for i in near]
        assert got[r["doc_id"]] == pytest.approx(sum(w * votes.labels[i] for w, i in zip(weight, near)) / sum(weight), abs=2e-3)
    good = quality.keep_good(docs, labels, ~held)
    assert {r["doc_id"] for r in good.collect()} == {i for i, x in got.items() if x >= 0.5}


def test_latent_vectors_are_singular_vectors():
    x = (np.random.default_rng(1).normal(size=(60, 8)) @ np.diag([9, 7, 5, 4, 0.1, 0.1, 0.1, 0.1])).astype(np.float32)
    want = np.linalg.svd(x, full_matrices=False)[2][:4]
    assert np.allclose(np.abs(np.sum(quality._singular_vectors(x, 4).T * want, axis=1)), 1, atol=1e-3)


def test_softmax_step():
    """One pass of training over tiny bags against loops over every bag, n-gram and dimension."""
    rng = np.random.default_rng(3)
    start = {"vectors": rng.normal(size=(6, 2)), "squares": np.zeros((6, 2)), "weights": rng.normal(size=(3, 2)), "wsquares": np.zeros((3, 2))}
    state = {k: v.copy() for k, v in start.items()}
    bags, y = [(np.array([0, 1, 2]), 4), (np.array([2, 3]), 2), (np.array([4]), 3)], [1, 0, 0]
    steps = max(toxicity.EPOCHS, -(-toxicity.LEAST_STEPS * toxicity.BATCH // 3))
    toxicity._train(bags, np.array(y), np.random.default_rng(0), state)
    v, w = start["vectors"], start["weights"]
    v2, w2 = np.zeros((6, 2)), np.zeros((3, 2))
    balance = [3 / 2 / 2, 3 / 2 / 1]
    for _ in range(steps):  # a batch holds all three bags
        gv, gw = np.zeros((6, 2)), np.zeros((3, 2))
        for (ids, size), label in zip(bags, y):
            hidden = [sum(v[i][d] for i in ids) / size for d in range(2)] + [1.0]
            logits = [sum(hidden[d] * w[d][c] for d in range(3)) for c in range(2)]
            p = [math.exp(x) / sum(map(math.exp, logits)) for x in logits]
            up = [(p[c] - (c == label)) * balance[label] / 3 for c in range(2)]
            for c in range(2):
                for d in range(3):
                    gw[d][c] += hidden[d] * up[c]
                for d in range(2):
                    for i in ids:
                        gv[i][d] += up[c] * w[d][c] / size
        v2, w2 = v2 + gv**2, w2 + gw**2
        v = v - toxicity.RATE * gv / np.sqrt(v2 + toxicity.START)
        w = w - toxicity.RATE * gw / np.sqrt(w2 + 1e-10)
    assert np.allclose(state["vectors"], v, atol=1e-6) and np.allclose(state["weights"], w, atol=1e-6)
    assert np.array_equal(state["vectors"][5], start["vectors"][5])


def test_toxicity_scores_are_those_of_the_worst_passage(spark, small):
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    held = common.crc_mod(F.col("doc_id"), 5) == 0
    model = toxicity.fit(docs, labels, ~held)
    long = "plain words of no harm " * 20000
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, long)], "doc_id long, text string")
    docs = docs.select("doc_id", "text").unionByName(odd)
    got = {r["doc_id"]: r["score"] for r in toxicity.classify(docs, labels, held).collect()}
    for r in docs.collect():
        ids, at, n = toxicity.subwords(r["text"] or "")
        logits = [model.bias + sum(float(model.table[i]) for i in ids[at == k]) / max(int((at == k).sum()), toxicity.LEAST_BAG) for k in range(n)]
        assert got[r["doc_id"]] == pytest.approx(1 / (1 + math.exp(-max(logits))), abs=1e-4)
    kept = toxicity.drop_toxic(docs.withColumn("score", F.create_map(F.lit("a"), F.lit(1))), labels, ~held)
    assert kept.columns == ["doc_id", "text", "score"] and {r["doc_id"] for r in kept.collect()} == {i for i, x in got.items() if x < 0.5}
    none = labels.limit(0)
    assert toxicity.drop_toxic(docs, none, F.lit(True)).count() == quality.keep_good(docs, none, F.lit(True)).count() == docs.count()
    assert toxicity.drop_toxic(docs.limit(0), labels, ~held).count() == quality.keep_good(docs.limit(0), labels, ~held).count() == 0


def test_toxicity(spark, small):
    rng = np.random.default_rng(8)
    clean = [words(rng, 120) for _ in range(120)]
    toxic = [" ".join([*words(rng, 60).split(), rng.choice(["grobnik", "grobnick"]), *words(rng, 60).split()]) for _ in range(60)]
    model = toxicity.train(clean[:80] + toxic[:40], [0] * 80 + [1] * 40)
    assert np.mean([model.score(t) < 0.5 for t in clean[80:]]) > 0.95 and np.mean([model.score(t) >= 0.5 for t in toxic[40:]]) > 0.9
    assert model.score(words(rng, 100) + " Grobnikk " + words(rng, 20)) >= 0.5
    assert toxicity.train([], []).score("x") == 0.5 and toxicity.train(["a"], [0]).score("") < 0.5
    classified(spark, small, toxicity, "toxic", 5, 0)


def test_subwords():
    ids, at, n = toxicity.subwords("Ab abc")
    again, _, _ = toxicity.subwords("abc ab ABC")
    assert n == 1 and set(ids) == set(again) and len(ids) == len(set(ids))
    ids, at, n = toxicity.subwords("word " * 480)
    assert n == 10 and set(at) == set(range(10)) and toxicity.subwords("")[2] == 1


def lm_brute(texts, train, depth):
    """The tree by its definition, with dictionaries."""
    streams = [[b"", *lm.tokens((t or "").encode())] for t in texts]
    grams = [Counter() for _ in range(depth + 2)]  # by number of words
    for s, own in zip(streams, train):
        if own:
            grams[1].update(s[1:])
            for n in range(2, depth + 2):
                grams[n].update(zip(*(s[i:] for i in range(n))))
    c = grams[1]
    total = sum(c.values())
    least = lm.LEAST
    root = lambda w: (c[w] + 0.1) / (total + 0.1 * (len(c) + 1))
    trees = []

    def state(context, w):
        p = root(w)
        for length, tree in enumerate(trees, 1):
            if length <= len(context) and context[-length:] in tree:
                own, rest, whole = tree[context[-length:]]
                p = own.get(w, 0) / whole + rest / whole * p
        return p

    frequent = {(w,) for w, n in c.items() if n >= least or not w}
    for n in range(2, depth + 2):
        entries = {k: m for k, m in grams[n].items() if m >= least and k[:-1] in frequent and k[1:] in frequent and (n == 2 or k[-2])}
        totals = {(w,): m for w, m in c.items()} if n == 2 else grams[n - 1]
        by = defaultdict(dict)
        for key, m in entries.items():
            by[key[:-1]][key[-1]] = m
        out = {}
        for s, own in by.items():
            t, kept = totals[s], sum(own.values())
            parent = {w: state(s[1:], w) for w in own}
            gain = sum(m * math.log(m / t / parent[w]) for w, m in own.items())
            if t > kept:
                gain += (t - kept) * math.log((t - kept) / t / max(1 - sum(parent.values()), 1e-12))
            if gain >= lm.CUTOFF * (len(own) + 1):
                out[s] = (own, (t - kept + lm.PARENT_WEIGHT), t + lm.PARENT_WEIGHT)
        trees.append(out)
        frequent = set(entries)
    out = []
    for s in streams:
        base, score = (sum(math.log10(p) for p in ps) for ps in ([root(w) for w in s[1:]], [state(tuple(s[:i]), s[i]) for i in range(1, len(s))]))
        out.append((len(s) - 1, sum(c[w] > 0 for w in s[1:]), total, base, score))
    return out, [len(t) for t in trees]


@pytest.mark.parametrize(("depth", "chunk_words"), [(1, lm.CHUNK), (2, 300), (3, 300), (4, lm.CHUNK)])
def test_suffix_tree(spark, depth, chunk_words):
    rng = np.random.default_rng(9)
    phrase = words(rng, 30)
    texts = [words(rng, 20).replace("w1", "the w1") + " " + (phrase if i % 2 else "") + (" a b c" if i % 3 else " a c b d") for i in range(60)] + [None, "", "  ", phrase, phrase.upper(), "of the of the", "zz zz zz yy", "a b " * 20000]
    train = [zlib.crc32(str(i).encode()) % 10 != 0 for i in range(len(texts))]
    got = {r["doc_id"]: r for r in lm.score_corpus(table(spark, texts), common.crc_mod(F.col("doc_id"), 10) == 0, depth, chunk_words).collect()}
    brute, retained = lm_brute(texts, train, depth)
    assert len(retained) == depth and all(retained)
    for i, want in enumerate(brute):
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) == pytest.approx(want), texts[i]
        assert r["held_out"] is (not train[i])
    assert got[63]["score"] > got[63]["base_score"] + 20


def test_what_chunks_send():
    rng = np.random.default_rng(3)
    for keys in ([5], [0, 2**64 - 1], np.sort(rng.integers(0, 2**63, 1000).astype(np.uint64) * 2)):
        keys = np.array(keys, np.uint64)
        assert (lm._unpack_keys(lm._pack_keys(keys)) == keys).all()
    for keys in ([], [7, 7, 7], [3, 2, 1, 2, 2**64 - 1, 2**64 - 2], rng.integers(0, 50, 300), rng.integers(0, 2**62, 5000).astype(np.uint64) | np.uint64(2**63)):
        keys = np.array(keys, np.uint64)
        order, ranked = lm._order(keys)
        assert (order == np.argsort(keys, kind="stable")).all() and (ranked == keys[order]).all()
    for numbers in ([], [0, 254, 255, 256, 2**40], rng.integers(0, 600, 1000)):
        numbers = np.array(numbers, np.int64)
        assert (lm._unpack_numbers(lm._pack_numbers(numbers)) == numbers).all()


def test_suffix_tree_of_few_texts(spark):
    one = lm.score_corpus(table(spark, ["a b " * 50]), F.lit(False)).first()
    assert one["score"] > one["base_score"] + 20 and one["score"] == pytest.approx(lm_brute(["a b " * 50], [True], lm.DEPTH)[0][0][4])
    twice = lm.score_corpus(table(spark, ["a b"]).unionByName(table(spark, ["a b"])), F.lit(False)).collect()
    assert len(twice) == 2 and {r["n_tokens"] for r in twice} == {3}
    assert {r["score"] for r in lm.score_corpus(table(spark, ["a b", None]), F.lit(True)).collect()} == {0.0}
    assert lm.score_corpus(table(spark, ["a"]).limit(0), F.lit(False)).count() == 0


def test_pipeline(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").persist()
    assert len(corpus_pipeline.STAGES) == 5
    now, ids = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = common.materialize(stage(spark, now, small), "stage")
        assert now.columns == docs.columns, name
        ids.append({r["doc_id"] for r in now.select("doc_id").collect()})
    assert all(b <= a for a, b in zip(ids, ids[1:])) and 0 < len(ids[-1]) < docs.count()
    # each stage against its operator's own verdicts on what came before
    labels = spark.read.parquet(f"{small}/labels.parquet")
    good = quality.classify(docs, labels, common.crc_mod(F.col("doc_id"), 3) == 1).where("predicted = 1")
    assert ids[0] == {r["doc_id"] for r in good.collect()}
    clean = toxicity.classify(docs.where(F.col("doc_id").isin([*ids[0]])), labels, common.crc_mod(F.col("doc_id"), 5) == 0).where("predicted = 0")
    assert ids[1] == {r["doc_id"] for r in clean.collect()}
    left = docs.where(F.col("doc_id").isin([*ids[1]]))
    assert ids[2] == {r["component_id"] for r in simhash.near_duplicates(left).collect()}
    left = docs.where(F.col("doc_id").isin([*ids[2]]))
    hit = {r["doc_id"] for r in decontamination.contamination(left, spark.read.parquet(f"{small}/benchmark.parquet")).collect()}
    assert ids[3] == ids[2] - hit
    packed = corpus_pipeline.run(spark, small).persist()
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == ids[3]
    whole = packed.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t")).where("n <> t").count()
    assert whole == 0
