"""URL filters: host and path rules, then boosted trees on lexical features.

DataFrame and SQL functions only.  A rule is a host and a path start with a
verdict; it fits its host and all subdomains.  The longest fitting rule
decides (of equally long ones the one with the longer host).  URLs that no
rule fits get the verdict of gradient-boosted trees over lexical features:
lengths, depth, digit ratio, character entropy, parameter and sign counts,
and suffix statistics: the smoothed shares of blocked URLs among labelled
ones with the same last one and two host labels, and the largest such share
of the words that host labels end in.

The trees are fitted on at most ``max_rows`` distinct labelled URLs, those of
least hash (a URL labelled both ways counts as blocked).  The shares of a
labelled URL are taken over the other folds of hosts, so that no URL meets
its own label, and its host none of its other URLs.  Rules are no labels: a
tree that learnt from them would repeat their top-level domains.  Unless a
labelled table is given, ``seed_urls`` is it: URLs put together by rule from
fixed words, with top-level domains, subdomains, paths and parameters alike
in both classes.  Without labelled URLs every verdict is ``allow``; with
labels of one kind it is that kind.

Edge cases: a null URL, or one without ``://``, has an empty host and path,
which no rule fits, and is judged by its features (a null one as the empty
text); repeated rows get equal verdicts; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Rule = tuple[str, str, str]  # host, path start, verdict
MAX_ROWS = 20_000
#: Up to so many rules are one CASE expression; more are joined by host.
CHAIN_MOST = 64
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: So many words of host labels have a share of their own, the most frequent.
MOST_WORDS, FOLDS, SMOOTH = 512, 5, 5
FEATURES = ["url_length", "host_length", "path_length", "depth", "digit_ratio", "entropy", "parameters", "host_labels", "hyphens", "host_digits", "top_blocked", "site_blocked", "word_blocked"]
# Words that hosts of the seed URLs are made of.
BLOCKED_WORDS = "ads adult banner bet bets bonus bride casino cheap click crypto dating deal deals escort fast free gamble gold hot jackpot loan loans lotto lucky pharma pills poker porn prize promo replica rich sex slots spam spin vip viagra win winner xxx".split()
ALLOWED_WORDS = "academy archive art bakery bank blog books bridge cafe city clinic club council daily forum garden guide health history home house journal law library lake market media museum music news office park press radio research review river school science shop sport street studio tech times town travel valley wiki world".split()
SYLLABLES = "al an ar ba be bo ca co da de di do ed el en er es fa fe ga ge ha he ho in ing ion is ja ka ki la le li lo ly ma me mi mo na ne no on or pa pe ra re ri ro sa se sh si so st ta te th ti to tion tu ur va ve vi wa we wh".split()
SEED_TOPS = "com net org info".split()
SEED_SITES = "example sites hosting pages".split()
SEED_SUBDOMAINS = ["", "", "www.", "m.", "blog."]
SEED_TAILS = ["", "/", ".html", "#top", "?utm_source=feed", "?page=2&ref=x", "/comments?sort=new", "?id=90817&session=4f3a9c"]
SEED_STARTS = "/en/ /de/ /fr/ /es/ /news/ /a/b/ /2024/05/ /".split()


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    text = F.coalesce(url, F.lit(""))
    at = F.instr(text, "://")
    rest = F.when(at > 0, F.substring(text, at + 3, F.length(text))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", 2)


def _by_length(rules: list[Rule]) -> list[Rule]:
    return sorted(rules, key=lambda r: (-len(r[0] + r[1]), -len(r[0]), r))


def judged_by_rules(urls: DataFrame, rules: list[Rule]) -> DataFrame:
    """``urls`` (with ``host``, ``path``) plus ``rule`` and ``rule_verdict``, null where no rule fits."""
    if len(rules) <= CHAIN_MOST:
        rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
        for host, path, what in reversed(_by_length(rules)):
            fits = ((F.col("host") == host) | F.endswith("host", F.lit("." + host))) & F.startswith("path", F.lit(path))
            rule, verdict = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
        return urls.withColumn("rule", rule).withColumn("rule_verdict", verdict)
    table = urls.sparkSession.createDataFrame([(*r, k) for k, r in enumerate(_by_length(rules))], "suffix string, start string, what string, place int")
    labels = F.split("host", r"\.")
    # every suffix of the distinct hosts and paths meets the rules of that host
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    pairs = urls.select("host", "path").distinct().withColumn("suffix", F.explode(suffixes))
    found = pairs.join(table, "suffix").filter(F.expr("startswith(path, start)")).groupBy("host", "path").agg(F.min(F.struct("place", F.concat("suffix", "start").alias("rule"), "what")).alias("m"))
    return urls.join(found.select("host", "path", F.col("m.rule").alias("rule"), F.col("m.what").alias("rule_verdict")), ["host", "path"], "left").select(*urls.columns, "rule", "rule_verdict")


def _count(text: Column, sign: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(sign), F.lit("")))


def lexical(urls: DataFrame) -> DataFrame:
    """``urls`` (with ``url``, ``host``, ``path``) plus the lexical features and the host's suffixes."""
    text, host, path = F.coalesce("url", F.lit("")), F.col("host"), F.col("path")
    n = F.length(text)
    digits = n - F.length(F.regexp_replace(text, "[0-9]", ""))
    shares = F.transform(F.array_distinct(F.split(text, "")), lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n)
    entropy = F.aggregate(F.filter(shares, lambda p: p > 0), F.lit(0.0), lambda s, p: s - p * F.log2(p))
    query = F.regexp_extract(text, r"\?([^#]*)", 1)
    return urls.select(
        "*",
        F.substring_index("host", ".", -1).alias("top"),
        F.substring_index("host", ".", -2).alias("site"),
        host_words(host).alias("words"),
        n.cast("double").alias("url_length"),
        F.length(host).cast("double").alias("host_length"),
        F.length(path).cast("double").alias("path_length"),
        F.size(F.filter(F.split(path, "/"), lambda s: s != "")).cast("double").alias("depth"),
        F.when(n > 0, digits / n).otherwise(0.0).alias("digit_ratio"),
        F.when(n > 0, entropy).otherwise(0.0).alias("entropy"),
        F.when(query == "", 0.0).otherwise((_count(query, "&") + 1).cast("double")).alias("parameters"),
        F.when(host == "", 0.0).otherwise((_count(host, ".") + 1).cast("double")).alias("host_labels"),
        _count(text, "-").cast("double").alias("hyphens"),
        (F.length(host) - F.length(F.regexp_replace(host, "[0-9]", ""))).cast("double").alias("host_digits"),
    )


def seed_urls(spark: SparkSession, n: int = 4_000, seed: int = 7) -> DataFrame:
    """``url, label``: ``n`` URLs put together from the fixed words; half are blocked.

    A blocked host has two blocked words, or one and a syllable; an allowed one
    two or three syllables or one or two allowed words.  Words are joined by a
    hyphen or directly.  All else is drawn alike for both.
    """

    def drawn(what: int, words: list[str]) -> Column:
        return F.element_at(F.array(*[F.lit(w) for w in words]), (F.pmod(F.xxhash64("id", F.lit(seed * 100 + what)), F.lit(len(words))) + 1).cast("int"))

    def less(what: int, share: float) -> Column:
        return F.pmod(F.xxhash64("id", F.lit(seed * 100 + what)), F.lit(1000)) < int(1000 * share)

    blocked = F.col("id") % 2 == 1
    join = F.when(less(1, 0.5), "-").otherwise("")
    bad = F.when(less(2, 0.75), F.concat(drawn(3, BLOCKED_WORDS), join, drawn(4, BLOCKED_WORDS))).otherwise(F.concat(drawn(5, SYLLABLES), join, drawn(6, BLOCKED_WORDS)))
    made = F.concat(drawn(7, SYLLABLES), drawn(8, SYLLABLES), F.when(less(9, 0.5), drawn(10, SYLLABLES)).otherwise(""))
    good = F.when(less(11, 0.5), made).when(less(12, 0.5), F.concat(drawn(13, ALLOWED_WORDS), join, drawn(14, ALLOWED_WORDS))).otherwise(F.concat(drawn(15, ALLOWED_WORDS), join, drawn(16, SYLLABLES)))
    host = F.concat(drawn(17, SEED_SUBDOMAINS), F.when(blocked, bad).otherwise(good), F.when(less(18, 0.6), F.concat(F.lit("."), drawn(19, SEED_SITES))).otherwise(""), F.lit("."), drawn(20, SEED_TOPS))
    number = F.pmod(F.xxhash64("id", F.lit(seed * 100 + 21)), F.lit(300_000)).cast("string")
    url = F.concat(F.when(less(22, 0.5), "https://").otherwise("http://"), host, drawn(23, SEED_STARTS), number, drawn(24, SEED_TAILS))
    return spark.range(n).select(url.alias("url"), blocked.cast("int").alias("label"))


def host_words(host: Column) -> Column:
    """The words that the host's labels end in, each label read from its end: hyphen parts, the top-level domain left out."""
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    inner = F.slice(labels, 1, F.greatest(F.lit(0), F.size(labels) - 1))
    return F.array_distinct(F.flatten(F.transform(inner, lambda x: F.filter(F.split(x, "-"), lambda w: w != ""))))


def _ended(word: Column, words: list[str], share: dict[str, float]) -> Column:
    """The share of the longest known word that ``word`` is or ends in; null if there is none."""
    out = F.lit(None).cast("double")
    for w in sorted(words, key=len):
        out = F.when(F.endswith(word, F.lit(w)), share[w]).otherwise(out)
    return out


def _shares(rows: DataFrame, stats: DataFrame, key: str, name: str, prior: float, own_fold: bool) -> DataFrame:
    """Adds the smoothed blocked share of ``key``; with ``own_fold`` without the rows of the row's own fold.

    ``stats`` (``key, n, blocked`` and the same of each fold) has no more rows than the labelled sample.
    """
    joined = rows.join(F.broadcast(stats), key, "left")
    n, blocked = F.coalesce("n", F.lit(0)), F.coalesce("blocked", F.lit(0.0))
    if own_fold:
        at = F.col("fold") + 1
        n, blocked = n - F.coalesce(F.get("n_of", at - 1), F.lit(0)), blocked - F.coalesce(F.get("blocked_of", at - 1), F.lit(0.0))
    return joined.withColumn(name, (blocked + SMOOTH * prior) / (n + SMOOTH)).drop("n", "blocked", "n_of", "blocked_of")


def _stats(labelled: DataFrame, key: str) -> DataFrame:
    each = [F.when(F.col("fold") == k, 1) for k in range(FOLDS)]
    return labelled.groupBy(key).agg(F.count("*").alias("n"), F.sum("label").alias("blocked"), F.array(*[F.count(e) for e in each]).alias("n_of"), F.array(*[F.coalesce(F.sum(F.when(e.isNotNull(), F.col("label"))), F.lit(0.0)) for e in each]).alias("blocked_of"))


class UrlTrees:
    """The fitted trees with their suffix statistics; ``scored`` adds ``score`` to rows with ``url``, ``host``, ``path``."""

    def __init__(self, labelled: DataFrame, *, trees: int, depth: int):
        """``labelled``: ``url, host, path, label``, distinct and bounded."""
        from pyspark.ml.classification import GBTClassifier
        from pyspark.ml.feature import VectorAssembler

        from rookery.llm.common import stored

        spark = labelled.sparkSession
        self.sample = stored(spark, lexical(labelled).withColumn("fold", F.pmod(F.xxhash64("host"), F.lit(FOLDS)).cast("int")), "labelled_urls", 1)
        n, blocked = self.sample.agg(F.count("*"), F.sum("label")).first()
        self.constant = (1.0 if n and blocked else 0.0) if not n or blocked in (0.0, float(n)) else None
        self.prior = blocked / n if n else 0.0
        if self.constant is not None:
            return
        self.assembler = VectorAssembler(inputCols=FEATURES, outputCol="features")
        words = self.sample.withColumn("word", F.explode("words"))
        # at most MOST_WORDS rows
        self.words = [r.asDict() for r in _stats(words, "word").filter("n >= 3").orderBy(F.desc("n"), "word").limit(MOST_WORDS).collect()]
        train = stored(spark, self.assembler.transform(self._with_shares(self.sample, own_fold=True)).select("features", "label"), "url_features", 1)
        self.model = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.2, seed=17, maxBins=32).fit(train)

    def _word_share(self, own_fold: bool) -> Column:
        def share(r: dict, fold: int | None) -> float:
            n, b = r["n"] - (r["n_of"][fold] if fold is not None else 0), r["blocked"] - (r["blocked_of"][fold] if fold is not None else 0)
            return float((b + SMOOTH * self.prior) / (n + SMOOTH))

        def largest(fold: int | None) -> Column:
            shares = {r["word"]: share(r, fold) for r in self.words}
            return F.array_max(F.transform("words", lambda w: F.coalesce(_ended(w, list(shares), shares), F.lit(self.prior))))

        if not own_fold:
            return F.coalesce(largest(None), F.lit(self.prior))
        out = F.lit(self.prior)
        for k in range(FOLDS):
            out = F.when(F.col("fold") == k, largest(k)).otherwise(out)
        return F.coalesce(out, F.lit(self.prior))

    def _with_shares(self, rows: DataFrame, own_fold: bool) -> DataFrame:
        for key, name in (("top", "top_blocked"), ("site", "site_blocked")):
            rows = _shares(rows, _stats(self.sample, key), key, name, self.prior, own_fold)
        return rows.withColumn("word_blocked", self._word_share(own_fold))

    def scored(self, rows: DataFrame) -> DataFrame:
        from pyspark.ml.functions import vector_to_array

        if self.constant is not None:
            return rows.withColumn("score", F.lit(self.constant))
        return self.model.transform(self.assembler.transform(self._with_shares(lexical(rows), own_fold=False))).withColumn("score", vector_to_array("probability")[1])


def _parsed(df: DataFrame, *more: str) -> DataFrame:
    host, path = parts(F.col("url"))
    return df.select(*more, "url", host.alias("host"), path.alias("path"))


def train_urls(labelled: DataFrame, *, max_rows: int = MAX_ROWS, trees: int = 15, depth: int = 4) -> UrlTrees:
    """Fitted on at most ``max_rows`` distinct URLs of ``labelled`` (``url``, ``label``: 1 blocked, 0 allowed)."""
    known = labelled.filter("label is not null and url is not null").groupBy("url").agg(F.max(F.col("label").cast("double")).alias("label"))
    return UrlTrees(_parsed(known.orderBy(F.xxhash64("url"), "url").limit(max_rows), "label"), trees=trees, depth=depth)


def filter_urls(pages: DataFrame, rules: list[Rule], labelled: DataFrame | None = None, *, max_rows: int = MAX_ROWS, trees: int = 15, depth: int = 4, threshold: float = 0.5, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` for every page; ``labelled`` as in ``train_urls``."""
    urls = judged_by_rules(_parsed(pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")), "id"), rules)
    model = train_urls(seed_urls(pages.sparkSession) if labelled is None else labelled, max_rows=max_rows, trees=trees, depth=depth)
    verdict = F.coalesce("rule_verdict", F.when(F.col("score") >= threshold, "block").otherwise("allow"))
    return model.scored(urls).select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "score")
