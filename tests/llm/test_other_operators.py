"""Vectors, pages, URLs, the pipeline and the SQL of the operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rookery.llm.common import table, tidy


# -- 3 top-k
def brute_top(rows, k):
    usable = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = {}
    for q, v in usable:
        if q % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in usable if i != q and len(w) == len(v))
            out[q] = [(-s, i) for s, i in scores[:k]]
    return {q: hits for q, hits in out.items() if hits}


@pytest.mark.parametrize("options", [{}, {"block": 13, "query_block": 3, "pivots": 4, "pivot_sample": 20}])
def test_exact_top_k(spark, options):
    from rookery.llm.pivot_search import top_k

    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(0, 1 + i % 3, 8)]) for i in range(401)]
    rows += [(1000, [0.0] * 8), (1001, [1.0, 2.0]), (1050, [0.5, 0.5]), (1100, None), (1150, []), (1151, [1.0, None]), (1200, [float("nan")] * 8), (1250, [float("inf")] * 8), (None, [1.0] * 8)]
    rows += [(2000 + i, rows[7][1]) for i in range(60)]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, id string, v int")
    got = {}
    for r in top_k(spark, df, **options).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
    assert got == brute_top(rows, 5)
    assert top_k(spark, df.limit(0)).count() == 0


@pytest.mark.parametrize("n,copies", [(16_384, 2_500), (16_384, 9_000), (5_000, 5_000)])
def test_search_block_scores_each_tie_once(n, copies):
    from rookery.llm.pivot_search import _distances, _lift, choose_pivots, search_block

    rng = np.random.default_rng(5)
    v = np.floor(256 * rng.normal(0, 1, (n, 8)))
    v[rng.permutation(n)[:copies]] = 4 * v[0]  # one vector, at places and under ids in no order
    ids, q = rng.permutation(n), np.stack([v[0], 5 * v[1], 3 * v[0] + v[2]])
    top = float((v * v).sum(axis=1).max())
    pivots = choose_pivots(_lift(v[:500], top, False), 24)
    got = search_block(np.array([-1, ids[7], -1]), q, _distances(_lift(q, top, True), pivots), ids, v, _distances(_lift(v, top, False), pivots), top, 5)
    for (i, kept, scores), own in zip(got, (-1, ids[7], -1)):
        score = v @ q[i]
        want = [c for c in np.lexsort((ids, -score)) if ids[c] != own][:5]
        assert ids[kept].tolist() == ids[want].tolist() and scores.tolist() == score[want].tolist()


def test_blocks_grow_with_the_table():
    from rookery.llm.pivot_search import blocks_of

    assert [blocks_of(n, 64, 16_384, 0) for n in (0, 1, 16_385, 10**6, 4 * 10**6, 10**9)] == [1, 1, 2, 62, 64, 15_259]
    assert [blocks_of(n, 64, 2_048, 1) for n in (0, 2_049, 10**5, 2 * 10**7)] == [1, 2, 8, 1_221] and blocks_of(10**6, 4_096, 16_384, 0) == 62


# -- 5 pages
PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="page">
<header><h1>Site name</h1></header><nav><ul><li><a href=/>Home</a><li><a href=/x>More</a></ul></nav>
<div id="cookie-notice">We use cookies, as everybody does, for all the usual reasons.</div>
<div class="wrap"><article><h1>A &amp; B</h1><p>First   paragraph,\nwith <b>bold</b>, <i>more</i> and &lt;signs&gt;.<br>Next line.
<p>Of.</p><div class="advert">Buy this now, it is cheap.</div><ul><li>One<li>Two</ul>
<form>Your name <input><button>Send</button></form><section class="comments"><p>Nice post, thanks, I liked reading it very much.</p></section></article>
<aside>Related: other things to read, and so on.</aside></div><footer>&copy; 2024 Site</footer></body></html>"""


def test_pages():
    from rookery.llm.html_text import main_text

    assert main_text(PAGE) == "A & B\n\nFirst paragraph, with bold, more and <signs>. Next line.\n\nOf.\n\nOne\n\nTwo"
    assert main_text(PAGE.replace("<article>", "<div class=story>").replace("</article>", "</div>")) == main_text(PAGE)
    assert main_text(None) == main_text("") == main_text("<nav>x</nav>") == main_text("<!-- only") == ""
    assert main_text("plain text, no tags") == "plain text, no tags"
    assert main_text("<p>a < b &amp <p>c <a '") == "a < b &\n\nc"
    assert len(main_text("<article>" + "<p>word, " * 20_000)) == 20_000 * 5 + 19_999 * 2


def prose(n, k=0):
    return " ".join(f"word{(i * 7 + k) % 13} some," if i % 9 == 0 else f"thing{(i * 5 + k) % 11}" for i in range(n)) + "."


def test_scores_choose_the_paths(monkeypatch):
    """No article element and no telling class names: the ratios alone tell the article from comments and menus."""
    from rookery.llm import html_text

    article = "".join(f"<p>{prose(60 + 9 * i, i)}</p>" for i in range(6)) + "<p>Short.</p><ul><li>One thing<li>Two things</ul>"
    comments = "".join(f"<div class=d4><b>Jim{i}</b><p>{prose(12 + i, i)}</p></div>" for i in range(8))
    page = f"<body><div class=a1><a href=/>Home</a> <a href=/n>News</a></div><div class=b2><h1>The title of it</h1>{article}</div><div class=c3>{comments}</div><div class=e5>Copyright 2024, by Site.</div></body>"
    want = "\n\n".join(["The title of it", *(prose(60 + 9 * i, i) for i in range(6)), "Short.", "One thing", "Two things"])
    assert html_text.main_text(page) == want
    # the same paths inside an article: the ratios still decide
    inside = page.replace("<body>", "<body><article>").replace("</body>", "</article></body>")
    assert "Jim" not in html_text.main_text(inside) and "Home" not in html_text.main_text(inside) and prose(60) in html_text.main_text(inside)
    score = html_text.score_paths
    monkeypatch.setattr(html_text, "score_paths", lambda p: {k: 20 - v for k, v in score(p).items()})
    assert prose(60) not in html_text.main_text(page) and "Copyright" in html_text.main_text(page)


@pytest.mark.parametrize("start", ["<div class='share-of-income'>", "<p class=side>", "<div id=search-algorithms>"])
def test_class_words_are_no_veto(start):
    from rookery.llm.html_text import main_text

    end = "</p>" if start.startswith("<p") else "</div>"
    assert main_text(f"<article>{start}{prose(30)}{end}</article>") == prose(30)
    page = f"<nav><a href=/>x</a></nav><article><p>{prose(40)}</p>{start}{prose(30, 1)}{end}</article><footer>F o o.</footer>"
    assert main_text(page) == f"{prose(40)}\n\n{prose(30, 1)}"


def test_wrappers_with_telling_names_say_nothing():
    from rookery.llm.html_text import main_text

    text = "\n\n".join(prose(60 + i, i) for i in range(6))
    inner = "".join(f"<p>{t}</p>" for t in text.split("\n\n"))
    assert main_text(f"<form id=aspnet><div class=page-with-sidebar>{inner}<div class=sidebar><p>{prose(40)}</p></div></div></form>") == text
    assert main_text(f"<article>{inner}<article><p>{prose(30)}</p></article></article>") == text


@pytest.mark.parametrize("page", ["<div>" * 60_000 + "x", "<b>" * 50_000 + "</i>" * 50_000, "<div><b>" * 20_000 + "x" + "</p>" * 40_000, "<i><td>" + "<b>" * 30_000 + "</i>" * 30_000, "<b>" * 20_000 + "<div>x</div>" * 20_000, "<table><tr><td>x" * 20_000, "<a '" * 30_000])
def test_hostile_pages_take_linear_time(page):
    import time

    from rookery.llm.html_text import main_text

    start = time.process_time()
    main_text(page)
    assert time.process_time() - start < 5


def test_page_rows(spark):
    from rookery.llm.html_text import extract_text

    rows = [(1, "u", PAGE, "t"), (1, "u", PAGE, "t"), (None, None, None, "t"), (2, "v", "", "t")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = extract_text(df).collect()
    assert len(got) == 4 and all(r["n_chars"] == len(r["text"]) for r in got) and sum(r["n_chars"] > 0 for r in got) == 2
    assert extract_text(df.limit(0)).count() == 0


# -- 9 URLs
def brute_rule(url, rules):
    import re

    url = url or ""
    rest = url.split("://", 1)[1] if "://" in url else ""
    m = re.match(r"([^/?#]*)([^?#]*)", rest)
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1])
    fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and m[2].startswith(r[1])]
    best = max(fits, key=lambda r: (len(r[0] + r[1]), len(r[0])), default=None)
    return host, m[2], (best[0] + best[1], best[2]) if best else (None, None)


@pytest.mark.parametrize("many", [False, True])
def test_url_rules(spark, many):
    from rookery.llm.queries import URL_RULES
    from rookery.llm.url_filter import filter_urls

    urls = [None, "", "nothing", "http://a.net", "http://A.NET/", "http://example.net/en/x", "http://w.example.net/en/?q", "http://example.net/e", "https://example.com/de/#/x", "ftp://x.org/fr/1?a/b", "http://org/fr/", "http://horg/fr/", "x://ÄB.net/?/", "http://user@b.net:80/p", "a://b://c.net/", "http://net/"]
    urls += [f"http://s{k}.example.com/{'de' if k % 2 else 'en'}/{k}?a={k}&b" for k in range(60)]
    rules = URL_RULES + ([(f"h{k}.test", "/", "block") for k in range(100)] if many else [])
    df = spark.createDataFrame([(k, u, "h") for k, u in enumerate(urls)] + [(3, urls[3], "h")], "page_id long, url string, host string")
    got = filter_urls(df, rules, trees=2).collect()
    assert len(got) == len(urls) + 1
    for r in got:
        host, path, (rule, verdict) = brute_rule(urls[r["page_id"]], rules)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdict if rule else r["verdict"] in ("allow", "block")


def test_url_trees_learn(spark):
    from rookery.llm.url_filter import filter_urls

    good = [f"https://site{k % 7}.example.org/news/{k}" for k in range(200)]
    bad = [f"http://win-{k}-free-{k % 13}.example.org/a/b/c/d?x={k}&y={k}&z=1" for k in range(200)]
    labelled = spark.createDataFrame([(u, 0) for u in good] + [(u, 1) for u in bad], "url string, label int")
    ask = spark.createDataFrame([(1, "https://site9.example.org/news/77"), (2, "http://win-5-free-x.example.org/q/w/e/r?x=1&y=2&z=3")], "page_id long, url string")
    assert {r["page_id"]: r["verdict"] for r in filter_urls(ask, [], labelled).collect()} == {1: "allow", 2: "block"}
    none = spark.createDataFrame([], "url string, label int")
    assert {r["verdict"] for r in filter_urls(ask, [], none).collect()} == {"allow"}
    assert {r["verdict"] for r in filter_urls(ask, [], labelled.filter("label = 1")).collect()} == {"block"}
    assert filter_urls(ask.limit(0), [], labelled).count() == 0


def test_url_labels_are_no_rules(spark):
    """Hosts that the trees have not seen, from the seed; the top-level domain says nothing; no URL meets its own label."""
    from rookery.llm.queries import URL_RULES
    from rookery.llm.url_filter import FEATURES, UrlTrees, _parsed, filter_urls, parts, seed_urls, train_urls

    seed = seed_urls(spark)
    host, _ = parts(F.col("url"))
    apart = F.pmod(F.xxhash64(host, F.lit(99)), F.lit(5)) == 0
    model = train_urls(seed.filter(~apart))
    right = model.scored(_parsed(seed.filter(apart), "label")).select(F.avg(((F.col("score") >= 0.5).cast("int") == F.col("label")).cast("double"))).first()[0]
    assert right >= 0.95
    pages = table(spark, "/root/testdata/sf0.01", "pages")
    got = filter_urls(pages, URL_RULES).filter("rule is null").groupBy(F.substring_index("host", ".", -1)).agg(F.avg((F.col("verdict") == "allow").cast("double"))).collect()
    assert len(got) == 2 and all(share > 0.7 for _, share in got)
    # one host, one word: without its own fold there is nothing but the prior
    few = spark.createDataFrame([(f"http://only.here/{k}", 1) for k in range(4)] + [(f"http://w{k}.example.com/", 0) for k in range(12)], "url string, label int")
    trees = train_urls(few, trees=1)
    assert isinstance(trees, UrlTrees) and set(FEATURES) >= {"site_blocked", "word_blocked"}
    own = trees._with_shares(trees.sample, own_fold=True).filter("label = 1").select("top_blocked", "site_blocked", "word_blocked").distinct().collect()
    assert [tuple(r) for r in own] == [(0.25, 0.25, 0.25)]
    twice = spark.createDataFrame([("http://a.b/", 0)] * 5 + [("http://a.b/", 1), ("http://c.d/", 0)], "url string, label int")
    assert sorted(map(tuple, train_urls(twice, trees=1).sample.select("url", "label").collect())) == [("http://a.b/", 1.0), ("http://c.d/", 0.0)]


def test_url_features(spark):
    import math

    from rookery.llm.url_filter import _parsed, lexical

    urls = ["http://www.free-bets.example.com/a/b1?x=1&y=22#z", "", "plain", "https://ÄB.net", "ftp://h//x-y"]
    for r in lexical(_parsed(spark.createDataFrame([(u,) for u in urls], "url string"))).collect():
        u, n = r["url"], len(r["url"])
        assert r["url_length"] == n and r["digit_ratio"] == (sum(c in "0123456789" for c in u) / n if n else 0)
        assert abs(r["entropy"] - (-sum(u.count(c) / n * math.log2(u.count(c) / n) for c in set(u)))) < 1e-9
        assert r["depth"] == len([x for x in r["path"].split("/") if x]) and r["hyphens"] == u.count("-")
    assert [r["words"] for r in lexical(_parsed(spark.createDataFrame([(urls[0],)], "url string"))).collect()] == [["www", "free", "bets", "example"]]


URL_SQL = r"""
WITH u AS (SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2) AS path FROM u),
r AS (SELECT * FROM (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) t(h, s, v)),
m AS (SELECT page_id, arg_max(h || s, length(h || s)) AS rule, arg_max(v, length(h || s)) AS v FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, s) GROUP BY page_id)
SELECT p.page_id, host, path, rule, v FROM p LEFT JOIN m USING (page_id)
"""


def test_url_rules_by_sql(spark):
    import duckdb

    from rookery.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    got = QUERIES["op9_url_filter"](spark, sf).select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict"))).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(con.sql(URL_SQL).fetchall(), key=repr)


# -- SQL
@pytest.mark.parametrize("name", ["op1_license_scan", "op3_exact_top_k", "op7_benchmark_decontamination"])
def test_oracles(spark, name):
    import os

    import duckdb

    from rookery.llm.oracles import ORACLES
    from rookery.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    want = con.sql(ORACLES[name]).select(*columns).fetchall()
    assert want and sorted(map(tuple, df.select(*columns).collect())) == sorted(want)


def test_every_operator_has_a_query():
    from rookery.llm.queries import QUERIES

    assert [n for n in QUERIES if n.startswith("op")] == sorted((n for n in QUERIES if n.startswith("op")), key=lambda n: int(n[2:].split("_")[0]))
    assert {int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op")} == set(range(1, 11)) and "pipeline" in QUERIES


# -- pipeline
def test_pipeline_stages(spark):
    """Each stage, on what the one before kept, against a plain version of its decision."""
    import corpus_pipeline as C
    from rookery.llm.common import stored
    from rookery.llm.jaccard_join import shingles
    from tests.llm.test_text_operators import brute_hits

    sf = "/root/testdata/sf0.01"
    docs = table(spark, sf, "documents")
    columns, seen = docs.columns, {}
    for name, stage in C.STAGES[:-1]:
        docs = stored(spark, stage(spark, docs, sf), name)
        assert docs.columns == columns
        seen[name] = docs.collect()
    toxic = {r["doc_id"] for r in table(spark, sf, "labels").filter("toxic = 1").collect()}
    before = {r["doc_id"] for r in table(spark, sf, "documents").collect()}
    kept = {r["doc_id"] for r in seen["toxicity"]}
    assert len(kept & toxic) <= 0.35 * len(toxic) and len((before - toxic) - kept) <= 0.1 * len(before)
    sets = [(r["doc_id"], set(shingles(r["text"]).tolist())) for r in seen["near_duplicates"]]
    by = {}
    for k, (_, s) in enumerate(sets):
        for g in s:
            by.setdefault(g, []).append(k)
    for a, s in sets:
        near = {j for g in s for j in by[g] if sets[j][0] != a}
        assert not any(len(s & sets[j][1]) / len(s | sets[j][1]) >= 0.8 for j in near)
    items = [(r["item_id"], r["text"]) for r in table(spark, sf, "benchmark").collect()]
    clean = {r["doc_id"] for r in seen["decontamination"]}
    gone = [r for r in seen["near_duplicates"] if r["doc_id"] not in clean]
    assert gone and all(brute_hits(r["text"], items)[1] for r in gone)
    assert not any(brute_hits(r["text"], items)[1] for r in seen["decontamination"][:100])
    assert {r["doc_id"] for r in seen["mixing"]} == clean
    out = C.STAGES[-1][1](spark, docs, sf)
    assert out.count() == len(seen["mixing"]) and out.agg(F.sum("n_tokens")).first()[0] > 0


def test_pipeline_takes_nulls(spark):
    import corpus_pipeline as C
    from rookery.llm.common import stored

    sf = "/root/testdata/sf0.001"
    odd = spark.createDataFrame([(None, None, None, None, None), (5, "", "en", "s", 0), (None, "some words", None, "s", 3), (5, "", "en", "s", 0)], table(spark, sf, "documents").schema)
    for docs in (odd, odd.limit(0)):
        n = docs.count()
        for name, stage in C.STAGES:
            docs = stored(spark, stage(spark, docs, sf), name)
        assert docs.count() == n


def test_pipeline_keeps_columns_of_any_name(spark):
    import corpus_pipeline as C
    from rookery.llm.common import stored

    sf = "/root/testdata/sf0.001"
    names = ["n_words", "hit_first", "hit_items", "rate", "copies", "posterior", "_n_words", "_posterior", "_u", "_copy", "_0_hash", "_0_hit_first", "stays", "row", "_id", "root", "node", "score", "_c0"]
    docs = table(spark, sf, "documents").select("*", *[F.concat(F.lit(n), F.col("doc_id").cast("string")).alias(n) for n in names])
    columns = docs.columns
    for name, stage in C.STAGES[:-1]:
        docs = stored(spark, stage(spark, docs, sf), name)
        assert docs.columns == columns and docs.count() > 0
        assert docs.filter(" or ".join(f"`{n}` is distinct from concat('{n}', doc_id)" for n in names)).isEmpty()


def test_mixing_against_bounded_least_squares(spark):
    """The fitted rates against an independent solver: coordinate steps on every document's own rate."""
    from rookery.llm.mixing import fold_rates, project_rates

    rng = np.random.default_rng(6)
    p, n = rng.dirichlet([0.4] * 3, 60), rng.integers(5, 90, 60).astype(float)
    table_ = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(n, p)], "_n_words long, _posterior array<double>")
    names, targets = ["a", "b", "c"], {"a": 0.6, "b": 0.3, "c": 0.1}
    budget = 1.5 * n.sum()
    steps, now, want = project_rates(table_, names, targets, budget)
    have = p.T @ n
    r = np.ones(60)
    for _ in range(4_000):  # minimise sum_d ((n r p - want) / have)^2 with r >= 0, one rate after another
        for i in range(60):
            slope = ((p.T @ (n * r) - want) / have**2) @ (n[i] * p[i])
            r[i] = max(0.0, r[i] - slope / (((n[i] * p[i]) ** 2 / have**2).sum()))
        if np.abs(p.T @ (n * r) - want).max() < 1e-6 * want.max():
            break
    best = ((((p.T @ (n * r)) - want) / have) ** 2).sum()
    got = fold_rates(p, steps, 0.0)
    assert got.min() >= 0 and ((((p.T @ (n * got)) - want) / have) ** 2).sum() <= best + 1e-6 and np.allclose(p.T @ (n * got), now)
    # of the rates that reach the totals these are nearest to 1
    assert (n * (got - 1) ** 2).sum() <= (n * (r - 1) ** 2).sum() + 1e-6


def test_tidy_gives_freed_native_memory_back(spark):
    """Blocks that the driver's JVM freed below one in use, as compilers leave them."""
    jvm = spark.sparkContext._jvm
    platform, pid = jvm.org.apache.spark.unsafe.Platform, jvm.java.lang.ProcessHandle.current().pid()

    def resident():
        with open(f"/proc/{pid}/smaps_rollup") as lines:
            return next(int(x.split()[1]) for x in lines if x.startswith("Rss:")) / 1024

    tidy(spark)
    blocks = [platform.allocateMemory(100_000) for _ in range(2_000)]
    for b in blocks:
        platform.setMemory(b, 1, 100_000)
    full = resident()
    for b in blocks[:-1]:
        platform.freeMemory(b)
    tidy(spark)
    platform.freeMemory(blocks[-1])
    assert resident() < full - 120
