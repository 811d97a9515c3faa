"""Small cases and brute-force versions of the operators on texts."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rookery.llm.common import table

DOCS = "doc_id long, text string, lang string, node long, label double, id long"


def docs_of(spark, rows):
    """Rows with clashing extra columns."""
    return spark.createDataFrame([(i, t, "en", 1, 2.0, 3) for i, t in rows], DOCS)


HARD = [(None, None), (1, None), (2, ""), (3, " \n\t"), (4, "x"), (4, "x"), (5, "Ünï ✓ \U0001f600 a\u0301"), (6, "word " * 30_000), (None, "some words here with null id")]


# -- 1 licences
def test_license_scan(spark, monkeypatch):
    import duckdb

    from rookery.llm import license_scan as L
    from rookery.llm.oracles import LICENSES

    known = L.LICENSE_NOTICES | L.LICENSE_TEXTS
    rows = HARD + [(10 + k, f"First line, with words.\n{text}\nand more words") for k, text in enumerate(known.values())]
    rows += [(90, "Released under the MIT Licence"), (91, "Licensed under CC BY NC 4 0"), (92, "released UNDER the\nmit -- license"), (93, known["MIT-text"].replace("fitness", "use").replace("CLAIM", "matter")), (94, known["MIT-text"][:400])]
    # rows of one id are one document
    rows += [(95, "Released under the MIT License."), (95, "x y z Released under the MIT License."), (95, "Released under the MIT License."), (96, known["ISC-text"][:350]), (96, known["ISC-text"][300:])]
    docs = docs_of(spark, rows)
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text").toPandas())
    want = {(r[0] if r[0] == r[0] else None, r[1]): r[2:] for r in con.sql(LICENSES).fetchall()}
    for most in (L.INLINE_MOST, 0):
        monkeypatch.setattr(L, "INLINE_MOST", most)
        got = {(r["doc_id"], r["license"]): r for r in L.scan_licenses(spark, docs).collect()}
        assert {k: (v["containment"], v["first_word"]) for k, v in got.items()} == want
    for k, name in enumerate(known):
        assert got[10 + k, name]["containment"] == 1.0 and got[10 + k, name]["first_word"] == 4
    assert (91, "CC-BY-NC-4.0") in got and (92, "MIT") in got and (90, "MIT") not in got and (95, "MIT") in got and (96, "ISC-text") in got
    assert 0.8 <= got[93, "MIT-text"]["containment"] < 1 and (94, "MIT-text") not in got
    monkeypatch.setattr(L, "BROADCAST_MOST", 0)
    places = {(r["doc_id"], r["license"]): (r["containment"], r["first_word"]) for r in L.scan_licenses(spark, docs.filter("doc_id > 85 or doc_id is null")).collect()}
    assert places == {k: v for k, v in want.items() if k[0] is None or k[0] > 85}
    assert L.scan_licenses(spark, docs.limit(0)).count() == 0
    assert L.scan_licenses(spark, docs, {}).count() == 0


def test_bands_collide_as_derived(spark):
    """Windows of two common shingles among four, and of one among five."""
    from rookery.llm.license_scan import BANDS, band, collision

    x = lambda k: F.xxhash64(F.col("id"), F.lit(k))
    same = lambda a, b: F.greatest(*[(band(k, [x(i) for i in a]) == band(k, [x(i) for i in b])).cast("int") for k in range(BANDS)])
    pairs = {(0, 1, 2): 1.0, (1, 2, 3): 0.5, (2, 3, 4): 0.2}
    got = spark.range(20_000).select(*[F.avg(same((0, 1, 2), b)) for b in pairs]).first()
    for share, s in zip(got, pairs.values()):
        assert abs(share - collision(s)) < 0.01
    assert collision(1.0) == 1.0


# -- 2 and 8 classifiers
@pytest.mark.parametrize(("name", "label", "least"), [("quality", "quality", 0.95), ("toxicity", "toxic", 0.9)])
def test_held_out_accuracy(spark, name, label, least):
    import importlib

    sf = "/root/testdata/sf0.1"
    module = importlib.import_module(f"rookery.llm.{name}")
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = getattr(module, f"train_{name}")(docs, labels)
    scored = getattr(module, f"score_{name}")(docs, model)
    rows = scored.filter("held_out").join(labels, "doc_id").select("score", "predicted", F.col(label).alias("y")).collect()
    assert np.mean([r["predicted"] == r["y"] for r in rows]) >= least
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= (0.3 if name == "quality" else 0.5)) for r in rows)


@pytest.mark.parametrize("name", ["quality", "toxicity"])
def test_classifier_edges(spark, name):
    import importlib

    module = importlib.import_module(f"rookery.llm.{name}")
    train, score = getattr(module, f"train_{name}"), getattr(module, f"score_{name}")
    label = "quality" if name == "quality" else "toxic"
    docs = docs_of(spark, HARD)
    none = spark.createDataFrame([], f"doc_id long, {label} int")
    model = train(docs, none)
    got = score(docs, model).collect()
    assert len(got) == len(HARD) and len({r["score"] for r in got}) == 1
    one = spark.createDataFrame([(1, 1), (2, 1), (4, 1), (6, 1), (None, 0), (5, None)], f"doc_id long, {label} int")
    got = score(docs, train(docs, one)).collect()
    assert all(r["score"] > 0.5 for r in got)
    assert score(docs.limit(0), model).count() == 0
    assert {r["doc_id"]: r["held_out"] for r in got if r["doc_id"] is not None} == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i, _ in HARD if i is not None}


def test_pairs_of_terms_count():
    """Two terms that are harmless alone and toxic together: no linear model tells them apart."""
    from rookery.llm.toxicity import FactorisationMachine, term_ids

    texts = [("insult", 0), ("group", 0), ("insult group", 1), ("plain", 0)] * 200
    rng = np.random.default_rng(0)
    rows = [term_ids(t + " " + " ".join(rng.choice(["aa", "bb", "cc", "dd"], 2))) for t, _ in texts]
    y = np.array([float(v) for _, v in texts])
    model = FactorisationMachine(epochs=60, decay=0.0, rate=0.05).fit(rows, y)
    p = model.probability(np.concatenate(rows), np.array([len(r) for r in rows]))
    assert np.mean((p >= 0.5) == (y > 0)) == 1.0


def test_pairs_are_learnt_where_their_words_are_neutral():
    """Default parameters: most toxic texts hold a slur; others only two words together, each as usual in clean texts as in toxic ones."""
    from rookery.llm.toxicity import FactorisationMachine, term_ids

    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("bcdfglmnprst"), 6)) for _ in range(400)]

    def text(*more):
        return " ".join([*rng.choice(words, 40), *more])

    def made(n):
        out = []
        for _ in range(n):
            kind = rng.random()
            if kind < 0.06:
                out.append((text("vermin"), 1, "slur"))
            elif kind < 0.10:
                out.append((text("idiots", "martians"), 1, "pair"))
            else:
                # the words alone make up as large a share of clean texts
                out.append((text(*(["idiots"] if kind < 0.50 else ["martians"] if kind < 0.86 else [])), 0, "clean"))
        return out

    def fitted(rows, **options):
        return FactorisationMachine(**options).fit([term_ids(t) for t, _, _ in rows], np.array([float(y) for _, y, _ in rows]))

    def caught(model, rows, kind):
        ids = [term_ids(t) for t, _, k in rows if k == kind]
        return float(np.mean(model.probability(np.concatenate(ids), np.array([len(r) for r in ids])) >= 0.5))

    train, ask = made(6_000), made(2_000)
    model = fitted(train)
    assert caught(model, ask, "slur") == 1.0 and caught(model, ask, "pair") >= 0.95 and caught(model, ask, "clean") <= 0.01
    assert caught(fitted(train, pair_terms=0), ask, "pair") <= 0.2


@pytest.mark.parametrize("name", ["quality", "toxicity"])
def test_scores_from_the_weights_alone(spark, name):
    """The query's scores against sums over dictionaries, term by term and pair by pair."""
    import importlib
    import itertools
    import math

    module = importlib.import_module(f"rookery.llm.{name}")
    sf = "/root/testdata/sf0.001"
    docs, labels = table(spark, sf, "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    model = getattr(module, f"train_{name}")(table(spark, "/root/testdata/sf0.01", "documents"), labels)
    scored = {r["doc_id"]: r["score"] for r in getattr(module, f"score_{name}")(docs, model).collect()}
    for r in docs.collect():
        if name == "quality":
            raw = model.slope * (math.fsum(model.table[i] for i in module.ngram_ids(r["text"] or "")) + model.bias) + model.shift
        else:
            places = {int(i): k for k, i in enumerate(model.kept)}
            mine = [places[i] for i in module.term_ids(r["text"] or "").tolist() if i in places]
            raw = model.bias + math.fsum(model.weights[i] for i in mine) + math.fsum(model.vectors[i] @ model.vectors[j] for i, j in itertools.combinations(mine, 2))
        assert abs(scored[r["doc_id"]] - 1 / (1 + math.exp(-min(30, max(-30, raw))))) < 1e-5


def test_dual_descent_reaches_the_optimum():
    from rookery.llm.quality import dual_descent

    rng = np.random.default_rng(1)
    rows = [np.unique(rng.integers(0, 20, 6)) for _ in range(80)]
    y = np.where([0 in r or 1 in r for r in rows], 1.0, -1.0)
    scale, c = rng.uniform(0.5, 1.5, 20), 0.5
    w, b = dual_descent(rows, scale, y, c, 400, 0)

    def loss(v):
        x = np.zeros((80, 20))
        for k, r in enumerate(rows):
            x[k, r] = scale[r]
        return 0.5 * (v @ v) + c * np.maximum(0, 1 - y * (x @ v[:20] + v[20])).sum()

    best = loss(np.append(w, b))
    for _ in range(300):
        assert loss(np.append(w, b) + rng.normal(0, 0.01, 21)) >= best - 1e-6


# -- 4 mixing
def test_mixing_matches_dense_projected_gradient():
    from rookery.llm.mixing import fold_rates

    rng = np.random.default_rng(2)
    p, n = rng.dirichlet([0.3] * 3, 200), rng.integers(1, 500, 200).astype(float)
    steps = rng.normal(0, 0.2, (6, 3))
    r = np.ones(200)
    for s in steps:
        r = np.maximum(0, r - p @ s)
    assert np.allclose(fold_rates(p, steps), r) and (fold_rates(p, steps, 1.0) >= 1).all()
    del n


def test_mixing_reaches_targets(spark):
    from rookery.llm.mixing import mix, project_rates, repeated
    from rookery.llm.queries import MIX_TARGETS, domain_labels

    sf = "/root/testdata/sf0.01"
    docs = table(spark, sf, "documents")
    mixed = mix(spark, docs, domain_labels(docs, table(spark, sf, "labels")), MIX_TARGETS)
    rows = mixed.collect()
    p, n, r = np.array([x["posterior"] for x in rows]), np.array([x["n_words"] for x in rows], float), np.array([x["rate"] for x in rows])
    got = p.T @ (n * r)
    want = np.array([MIX_TARGETS[d] for d in sorted(MIX_TARGETS)]) * got.sum()
    assert np.abs(got - want).max() / want.max() < 0.01 and r.min() >= 1 and all(x["copies"] >= 1 for x in rows)
    assert np.mean([sorted(MIX_TARGETS)[int(np.argmax(x["posterior"]))] == x["lang"] for x in rows if x["n_words"] > 20]) > 0.95
    assert repeated(mixed).count() == sum(x["copies"] for x in rows) and repeated(mixed).columns == docs.columns
    # a budget below the total needs rates under one, none negative
    thin = spark.createDataFrame([(100, [1.0, 0.0]), (100, [0.0, 1.0]), (50, [0.5, 0.5])], "_n_words long, _posterior array<double>")
    steps, now, want = project_rates(thin, ["a", "b"], {"a": 1.0, "b": 0.0}, 60.0, most_steps=200)
    assert np.abs(now - want).max() < 1 and len(steps)


@pytest.mark.parametrize("shares", [(0.2, 0.6, 0.2, 0.001), (0.2, 0.6, 0.1, 0.1, 0.001), (0.6, 0.15, 0.15, 0.1, 0.0005)])
def test_mixing_reaches_targets_beside_a_rare_domain(spark, shares):
    from rookery.llm.mixing import fold_rates, project_rates

    rng, d, rows = np.random.default_rng(4), len(shares), 20_000
    y = np.repeat(np.arange(d), np.round(rows * np.array(shares) / sum(shares)).astype(int))
    z = rng.normal(0, 1, (len(y), d))
    z[np.arange(len(y)), y] += 11
    p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
    n = rng.integers(20, 600, len(y))
    posteriors = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(n, p)], "_n_words long, _posterior array<double>")
    names, targets = ["en", "fr", "de", "es", "xx"][:d], {"en": 0.55, "fr": 0.16, "de": 0.16, "es": 0.13}
    wanted = np.array([targets.get(x, 0.0) for x in names])
    if d == 5:
        with pytest.warns(UserWarning, match="xx"):  # nothing is dropped, so the domain without a target stays
            steps, now, want = project_rates(posteriors, names, targets, None, least_rate=1.0)
    else:
        steps, now, want = project_rates(posteriors, names, targets, None, least_rate=1.0)
    r = fold_rates(p, steps, 1.0)
    assert r.min() >= 1 and np.allclose(p.T @ (n * r), now)
    assert np.abs(now / now.sum() - wanted).max() < 0.01 and abs(now.sum() / want.sum() - 1) < 0.01
    with pytest.raises(RuntimeError, match="not converged"):
        project_rates(posteriors, names, targets, None, least_rate=1.0, most_steps=0)


def test_mixing_edges(spark):
    from rookery.llm.mixing import mix

    docs = docs_of(spark, HARD)
    nothing = spark.createDataFrame([], "doc_id long, domain string")
    assert all(r["copies"] >= 1 for r in mix(spark, docs, nothing, {"en": 1.0}).collect())
    labels = spark.createDataFrame([(4, "a"), (6, "b"), (5, None), (None, "a")], "doc_id long, domain string")
    got = mix(spark, docs, labels, {"a": 0.5, "b": 0.4, "unknown": 0.1})
    assert got.count() == len(HARD) and got.filter("rate < 1").count() == 0
    assert mix(spark, docs.limit(0), labels, {"a": 1.0}).count() == 0


# -- 6 similarity join
def brute_links(rows):
    from rookery.llm.jaccard_join import shingles

    sets = [set(shingles(t).tolist()) for _, t in rows]
    links = [[j for j in range(len(rows)) if j != i and sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8] for i in range(len(rows))]
    classes = list(range(len(rows)))
    for _ in rows:
        for i, near in enumerate(links):
            for j in near:
                classes[i] = classes[j] = min(classes[i], classes[j])
    return links, classes


@pytest.mark.parametrize("options", [{}, {"group_most": 3, "block": 4, "sample": 3}, {"weight": 200, "target_recall": 1.0, "least_recall": 0.9999}])
def test_near_duplicates(spark, options):
    from rookery.llm.jaccard_join import keep_one_of_each, near_duplicates

    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    rows = []
    for g in range(12):
        base = [word() for _ in range(60)]
        for _ in range(1 + g):
            text = list(base)
            for at in rng.choice(60, rng.integers(0, 4), replace=False):
                text[at] = word()
            rows.append((len(rows) + 100, " ".join(text)))
    rows += [(7, "A b c."), (8, "a B, c"), (9, "a b"), (20, None), (21, ""), (22, "..."), (23, "same words in this text"), (23, "same words in this text"), (24, "Same words, in THIS text!")]
    docs = docs_of(spark, rows)
    links, classes = brute_links(rows)
    got = {}
    for r in near_duplicates(spark, docs, **options).collect():
        got.setdefault(r["doc_id"], []).append((r["class_id"], r["n_links"]))
    for k, (i, _) in enumerate(rows):
        members = [rows[j][0] for j in range(len(rows)) if classes[j] == classes[k]]
        assert (min(members), len(links[k])) in got[i], i
    kept = keep_one_of_each(spark, docs, **options)
    assert kept.columns == docs.columns
    ids = sorted(r["doc_id"] for r in kept.collect())
    assert ids == sorted({min(rows[j][0] for j in range(len(rows)) if classes[j] == c) for c in classes} | {20, 21, 22})


def test_near_duplicate_edges(spark):
    from rookery.llm.jaccard_join import near_duplicates

    assert near_duplicates(spark, docs_of(spark, HARD).limit(0)).count() == 0
    got = near_duplicates(spark, docs_of(spark, HARD + [(None, "some words here with null id")])).collect()
    assert len(got) == len(HARD) + 1 and all(r["class_id"] is None or r["doc_id"] is None or r["class_id"] <= r["doc_id"] for r in got)
    assert sum(r["n_links"] for r in got) == 4  # two pairs of equal rows


def test_components(spark):
    from rookery.llm.components import connected_components

    chain = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 130)] + [(5, 5), (200, None)]
    got = {r["node"]: r["root"] for r in connected_components(spark, spark.createDataFrame(chain, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[k] for k in range(100, 130)} == {100} and 200 not in got
    assert connected_components(spark, spark.createDataFrame([], "a long, b long")).count() == 0


def test_intersection_sizes():
    from rookery.llm.jaccard_join import _counts

    rng = np.random.default_rng(9)
    left, right = ([np.unique(rng.integers(0, 9_000, n)).astype(np.uint64) for n in rng.integers(1, 400, size)] for size in (23, 31))
    want = [[len(np.intersect1d(a, b)) for b in right] for a in left]
    for most in (10**9, 2_000, 50):
        assert _counts(left, right, most).tolist() == want


def test_caches_give_way():
    from rookery.llm.common import Memo

    a, b, c = Memo(len, 3), Memo(str.upper, 3, "pair"), Memo(str.lower, 3, "pair")
    assert (a["xx"], b["q"], c["W"], b["z"]) == (2, "Q", "w", "Z") and not a and len(b) == 2 and len(c) == 1
    assert [a[k] for k in ("1", "22", "333", "4444")] == [1, 2, 3, 4] and len(a) == 1 and not b and not c
    assert a["x" * 65] == 65 and len(a) == 1  # a text without blanks is not kept


def test_tables_on_the_way_need_a_shared_folder():
    from types import SimpleNamespace as N

    from rookery.llm.common import shared_dir

    def session(master, given=None):
        conf = {"spark.checkpoint.dir": given} if given else {}
        return N(conf=N(get=lambda k, d=None: conf.get(k, d), set=conf.__setitem__), sparkContext=N(master=master, getConf=lambda: N(get=conf.get)))

    assert shared_dir(session("spark://host:7077", "s3a://b/x/")) == "s3a://b/x" and "rookery-" in shared_dir(session("local[4]"))
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,3000]"):
        with pytest.raises(RuntimeError, match=r"spark\.checkpoint\.dir"):
            shared_dir(session(master))


def test_labels_hold_the_signature():
    from rookery.llm.jaccard_join import DEPTH, TREES, labels, prefix, signature, sketch

    rng = np.random.default_rng(2)
    minima = signature(rng.integers(0, 1 << 63, 500).astype(np.uint64))
    keys = labels(minima)
    assert (sketch(keys[None, :])[0] == (minima & np.uint32(0xFF))).all()
    other = minima.copy()
    for tree in range(TREES):
        other[tree * DEPTH + tree % DEPTH] += np.uint32(1)
    hi, lo = keys[::2], keys[1::2]
    for k in range(1, DEPTH + 1):
        a, b = prefix(hi, lo, k), prefix(labels(other)[::2], labels(other)[1::2], k)
        same = (a[0] == b[0]) & (a[1] == b[1])
        assert same.tolist() == [tree % DEPTH >= k for tree in range(TREES)]
        assert len(set(zip(*(x.tolist() for x in a)))) == TREES


@pytest.mark.parametrize("group_most", [2, 512])
def test_walk_finds_every_run(spark, group_most):
    """Runs of equal prefixes, in one partition or several, against a dictionary; long ones come as stars."""
    from rookery.llm.jaccard_join import DEPTH, TREES, _borders, _walk, cut_runs, labels, prefix

    rng = np.random.default_rng(8)
    keys = {n: labels(rng.integers(0, 3, TREES * DEPTH).astype(np.uint32)) for n in range(60)}
    for n in range(20):
        keys[n] = keys[0]
    rows = [(int(keys[n][2 * t]), int(keys[n][2 * t + 1]), n) for n in keys for t in range(TREES)]
    df = spark.createDataFrame(rows, "hi long, lo long, node long").repartitionByRange(23, "hi", "lo", "node").sortWithinPartitions("hi", "lo", "node").persist()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    borders = sorted(tuple(r) for r in df.mapInArrow(_borders, "p int, hi long, lo long, node long, last_hi long, last_lo long").collect())
    assert len(borders) > 3
    for k in (DEPTH, 4, 1):
        want = {}
        for h, low, n in rows:
            a, b = prefix(np.array([h]), np.array([low]), k)
            want.setdefault((int(a[0]), int(b[0])), set()).add(n)
        got, groups = set(), {}
        for r in df.mapInArrow(_walk(k, k == DEPTH, cut_runs(borders, k), group_most), "run long, child long, node long").collect():
            if r["run"] is None:
                got.add((r["child"], r["node"]))
            else:
                groups.setdefault(r["run"], []).append((r["child"], r["node"]))
        for members in groups.values():
            got |= {(a, b) for ca, a in members for cb, b in members if ca != cb}
        near = {n: {n} for n in keys}
        for a, b in got:  # joined in any number of steps
            both = near[a] | near[b]
            for n in both:
                near[n] = both
        if k < DEPTH:  # what a longer prefix joins was met before
            for h, low, n in rows:
                a, b = prefix(np.array([h]), np.array([low]), k + 1)
                first = want.setdefault(("deeper", int(a[0]), int(b[0])), n)
                both = near[first] | near[n]
                for m in both:
                    near[m] = both
        assert all(members <= near[n] for key, members in want.items() if key[0] != "deeper" for n in members)
    df.unpersist()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")


def test_recall_is_estimated_from_the_links_found():
    from rookery.llm.jaccard_join import HASHES, estimated_recall, modelled_recall

    rng, s, k = np.random.default_rng(3), 0.85, 6
    found = rng.random(200_000) < modelled_recall(s, k)
    agree = rng.binomial(HASHES, s, 200_000)[found]
    values, n = np.unique(agree, return_counts=True)
    assert abs(estimated_recall(values, n, k, 0.8) - found.mean()) < 0.002
    assert estimated_recall(np.zeros(0), np.zeros(0), k, 0.8) == 1.0


def test_join_groups(spark):
    from rookery.llm.common import join_groups

    rows = spark.createDataFrame([(k % 7 if k % 3 else 0, k) for k in range(300)], "g long, v long")
    about = rows.groupBy("g").agg(F.count("*").alias("n"), F.max("v").alias("m"))
    want = sorted(map(tuple, rows.join(about, "g").select("g", "v", "n", "m").collect()))
    for part in (1, 10, 1000):
        assert sorted(map(tuple, join_groups(rows, about, "g", "n", ["v"], 300, part=part).select("g", "v", "n", "m").collect())) == want


# -- 7 decontamination
def brute_hits(text, items, window=10):
    import re

    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    doc, hit, found = words(text), set(), set()
    for item, t in items:
        w = words(t)
        n = min(window, len(w))
        for i in range(len(w) - n + 1) if w else ():
            for at in range(len(doc) - n + 1):
                if doc[at : at + n] == w[i : i + n]:
                    hit.update(range(at, at + n))
                    found.add(str(item))
    return len(doc), len(hit), sorted(found)


@pytest.mark.parametrize("max_chars", [10**6, 40])
def test_decontamination(spark, max_chars):
    import hashlib

    from rookery.llm.decontaminate import digest, find_hits

    long = "Eins zwei drei, vier fünf sechs sieben acht neun zehn elf zwölf"
    items = [(1, long), (2, "short Item"), (3, "x"), (10, "item"), (4, ""), (5, None), (None, "zwei drei"), (6, "ÉTÉ été")]
    texts = HARD + [(30, f"before {long} after"), (31, long.replace("zwei", "2")), (32, "a short item. SHORT-ITEM"), (33, "shorts item; xx"), (34, "été ÉTÉ été"), (35, "ÉTÉ; ÉTÉ été")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = docs_of(spark, texts)
    got = [(r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in digest(find_hits(spark, docs, bench, max_chars=max_chars)).collect()]
    want = []
    for i, t in texts:
        n, h, f = brute_hits(t, [x for x in items if x[0] is not None])
        want.append((i, n, h, len(f), hashlib.sha256(",".join(f).encode()).hexdigest(), h > 0))
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert find_hits(spark, docs.limit(0), bench).count() == 0
    assert digest(find_hits(spark, docs, bench.limit(0))).filter("contaminated").count() == 0


# -- 10 token output
def test_token_output(spark, tmp_path):
    from tokenizers import Tokenizer

    from rookery.llm.queries import tokenizer_path
    from rookery.llm.token_codes import Segment, token_output

    rows = HARD + [(40, "I'll <|endoftext|> don't 12ab ½ ΣΑΣ 日本 \u2028 x\xa0y"), (-3, "first")]
    docs = docs_of(spark, rows)
    tok = Tokenizer.from_file(tokenizer_path())
    path = str(tmp_path / "t")
    got = token_output(spark, docs, tokenizer_path=tokenizer_path(), path=path, segment_tokens=7).collect()
    want = {}
    for i, t in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        want.setdefault(i, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    have = {}
    for r in got:
        have.setdefault(r["doc_id"], []).append((r["n_tokens"], r["ids_crc32"]))
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}
    order = sorted(got, key=lambda r: r["start"])
    assert [r["start"] for r in order] == list(np.cumsum([0] + [r["n_tokens"] for r in order])[:-1])
    ids = [r["doc_id"] for r in order]
    assert ids == sorted(ids, key=lambda i: -(10**9) if i is None else i)
    for r in spark.read.parquet(path).collect():
        seg = Segment(bytes(r["payload"]))
        assert [seg[i] for i in range(len(seg))][:200] == seg.decode().tolist()[:200] and len(seg) == r["n_tokens"]
        with pytest.raises(IndexError):
            seg[len(seg)]
    assert token_output(spark, docs.limit(0), tokenizer_path=tokenizer_path()).count() == 0


@pytest.mark.parametrize("bits", [8, 16])
def test_codes(bits):
    from rookery.llm.token_codes import Segment, pack

    ids = np.random.default_rng(0).choice([0, 1, 255, 256, 65_535, 65_536, 2**32 - 1, 70_000], 3_000).astype(np.uint32)
    seg = Segment(pack([None, 5], np.array([0, 1_000, 3_000]), ids, bits))
    assert seg.decode().tolist() == ids.tolist() == [seg[i] for i in range(3_000)]
    assert seg.doc_ids == [None, 5] and seg.document(1) == ids[1_000:].tolist()
    assert len(Segment(pack([], np.array([0]), np.zeros(0, np.uint32), bits)).decode()) == 0
    with pytest.raises(ValueError):
        pack([], np.array([0]), ids, 7)


def test_quality_reads_long_chunks_to_the_end():
    from rookery.llm.quality import ngram_ids

    start = "文字，文字。" * 20
    ids = [set(ngram_ids(start + end).tolist()) for end in ("", "A!!9?" * 40, "x-Y-7" * 40)]
    words = [set(ngram_ids(t).tolist()) for t in ("a plain text", "a fancy text", "A plain, text")]
    assert words[0] != words[1] and len(words[0] & words[2]) < len(words[0] | words[2])
    assert ids[0] < ids[1] | ids[0] and not ids[1] <= ids[0] and not ids[1] <= ids[2] and not ids[2] <= ids[1]
