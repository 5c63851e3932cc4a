"""URL filter: fixed allow and block rules, and gradient-boosted trees on lexical features for the rest.

Everything is DataFrame and SQL expressions.  The trees learn from the urls that a rule labels: every level of splits
is one grouped aggregate over binned features, the driver sees only those histograms, and the finished trees are one
constant array that an expression walks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankflow.session import work_dir

#: (host, path) rules with their verdict; a rule fits its host and all subdomains
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block")]

#: at most so many labelled urls fit the trees, taken by a hash of the url
FIT_ROWS = 20_000
#: suffixes and directories with at least so many labelled urls get statistics of their own
SUFFIX_LEAST = 20
TREES, DEPTH, BINS, RATE, LAMBDA = 8, 3, 16, 0.7, 1.0
#: labelled urls are dealt to folds, and the trees fit statistics of other folds than a row's own
FOLDS = 5
#: gradients are summed in such parts of one; a cut that no value passes
UNIT, NEVER = 1 << 24, 1e300
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789"


def _cut(url: Column) -> Column:
    """What follows the first ``://``, or null."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; empty where the url is null or has no ``://``."""
    rest = _cut(url)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
                       "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_columns(host: Column, path: Column, rules=tuple(RULES)) -> tuple[Column, Column]:
    """The longest rule that fits (length of host and path together; the later listed of equals) and its verdict."""
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def _share(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, pattern, "")) / F.greatest(F.length(text), F.lit(1))


def _entropy(text: Column) -> Column:
    """Bits per character over letters, digits and the rest (37 classes at most)."""
    def bits(low: Column) -> Column:
        n = F.greatest(F.length(low), F.lit(1)).cast("double")
        known = F.transform(F.array(*[F.lit(c) for c in ALPHABET]),
                            lambda c: F.length(low) - F.length(F.replace(low, c, F.lit(""))))
        counts = F.concat(known, F.array(F.length(F.translate(low, ALPHABET, ""))))
        return F.aggregate(counts, F.lit(0.0), lambda total, k: total - F.when(k > 0, k / n * F.log2(k / n)).otherwise(0.0))

    return F.transform(F.array(F.lower(text)), bits)[0]  # the lambda's argument is lower-cased once


def suffix(host: Column) -> Column:
    """The last two labels of a host."""
    return F.substring_index(host, ".", -2)


def segment(path: Column) -> Column:
    """The first directory of a path; empty if it has none."""
    return F.regexp_extract(path, r"^/([^/]*)/", 1)


def fold_of(url: Column) -> Column:
    """The fold of a url: copies of one url share theirs."""
    return F.pmod(F.xxhash64(F.coalesce(url, F.lit(""))), F.lit(FOLDS)).cast("int")


def _share_of(stats: DataFrame, kind: str, out: str) -> DataFrame:
    """``stats`` of one kind as (_key of that kind, struct ``out``)."""
    return stats.where(F.col("kind") == kind).select(F.col("key").alias(f"_{kind}"), F.struct("n", "ones", "folds").alias(out))


@dataclass
class UrlModel:
    """Complete trees (heap order: feature number, cut, leaf value), statistics of host suffixes and first
    directories by fold (a table), and the allow share of all labelled urls."""
    trees: list[tuple[list[int], list[float], list[float]]]
    stats: DataFrame
    prior: float

    def features(self, urls: DataFrame, fold: Column | None = None) -> DataFrame:
        """``urls`` (with _url, _host, _path) plus one double column per lexical feature.  With ``fold``, a row's
        statistics leave out the labelled urls of that fold, so no row is described by its own label."""
        def learnt(met: str) -> Column:
            n, ones = F.col(f"{met}.n"), F.col(f"{met}.ones")
            if fold is not None:
                own = F.get(F.col(f"{met}.folds"), fold)
                n, ones = n - own["n"], ones - own["ones"]
            return F.when(n >= SUFFIX_LEAST, (ones + 10 * self.prior) / (n + 10)).otherwise(F.lit(float(self.prior)))

        url, host, path = F.coalesce("_url", F.lit("")), F.col("_host"), F.col("_path")
        query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
        cols = {
            "f_length": F.length(url), "f_host_length": F.length(host), "f_path_length": F.length(path),
            "f_depth": F.length(F.regexp_replace(path, "[^/]", "")),
            "f_labels": F.length(F.regexp_replace(host, "[^.]", "")),
            "f_digits": _share(url, "[^0-9]"), "f_path_digits": _share(path, "[^0-9]"),
            "f_entropy": _entropy(url), "f_host_entropy": _entropy(host),
            "f_params": F.when(query != "", F.length(F.regexp_replace(query, "[^&]", "")) + 1).otherwise(0),
            "f_query_length": F.length(query), "f_fragment": F.instr(url, "#") > 0, "f_https": url.startswith("https"),
            "f_marks": _share(url, "[^%_=&-]"), "f_suffix": learnt("_by_suffix"), "f_segment": learnt("_by_segment"),
        }
        met = (urls.withColumns({"_suffix": suffix(host), "_segment": segment(path)})
               .join(_share_of(self.stats, "suffix", "_by_suffix"), "_suffix", "left")
               .join(_share_of(self.stats, "segment", "_by_segment"), "_segment", "left"))
        return met.select(*urls.columns, *[cols[name].cast("double").alias(name) for name in NAMES])

    def score(self) -> Column:
        """Log odds of allow of a row with the feature columns; 0 without trees."""
        # the lambda's argument is evaluated once; written into the walk, the features would be at every step
        return F.transform(F.array(F.array(*NAMES)), lambda vector: _walk(self.trees, vector))[0]


NAMES = ["f_length", "f_host_length", "f_path_length", "f_depth", "f_labels", "f_digits", "f_path_digits", "f_entropy",
         "f_host_entropy", "f_params", "f_query_length", "f_fragment", "f_https", "f_marks", "f_suffix", "f_segment"]


def _doubles(values: list[float]) -> str:
    return "array(" + ", ".join(f"{float(v)!r}D" for v in values) + ")"


def _leaf(tree: Column, vector: Column, depth: int) -> Column:
    """Heap number (root 1) of the node at ``depth`` that the ``vector`` falls into."""
    node = F.lit(1)
    return F.aggregate(F.array(*[F.lit(0)] * depth), node, lambda at, _: 2 * at + (
        F.get(vector, F.get(tree["feature"], at - 1)) > F.get(tree["cut"], at - 1)).cast("int")) if depth else node


def _walk(trees: list, vector: Column) -> Column:
    """Sum of the leaf values of all trees, which are one constant array: the plan's size doesn't depend on them."""
    if not trees:
        return F.lit(0.0)
    model = F.expr("array(" + ", ".join(
        f"named_struct('feature', array({', '.join(map(str, feature))}), 'cut', {_doubles(cut)}, 'value', {_doubles(value)})"
        for feature, cut, value in trees) + ")")
    return F.aggregate(model, F.lit(0.0), lambda total, t: total + F.get(t["value"], _leaf(t, vector, DEPTH) - 2 ** DEPTH))


def _grow(rows: DataFrame, trees: list, cuts: list[list[float]]) -> tuple[list[int], list[float], list[float]]:
    """One more tree on the gradients of the logistic loss, level by level: a grouped sum per level finds all its
    splits.  Gradients are summed as whole numbers, so the tree doesn't depend on the order of rows."""
    p = 1 / (1 + F.exp(-_walk(trees, F.col("vector"))))
    whole = lambda x: F.round(x * UNIT).cast("long")
    inner = 2 ** DEPTH - 1
    feature, cut, value = [0] * inner, [NEVER] * inner, [0.0] * (2 * inner + 2)
    for level in range(DEPTH):
        part = F.expr(f"named_struct('feature', array({', '.join(map(str, feature))}), 'cut', {_doubles(cut)})")
        graded = rows.select(_leaf(part, F.col("vector"), level).alias("node"), whole(F.col("label") - p).alias("g"),
                             whole(p * (1 - p)).alias("h"), F.posexplode("bins").alias("name", "bin"))
        by: dict[int, dict[int, list[tuple[int, int, int, int]]]] = {}
        for r in graded.groupBy("node", "name", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.count("*").alias("n")).collect():
            by.setdefault(r["node"], {}).setdefault(r["name"], []).append((r["bin"], r["g"], r["h"], r["n"]))
        for node, names in by.items():
            g, h, n = (sum(x[i] for x in names[0]) for i in (1, 2, 3))
            value[node] = value[2 * node] = _newton(g, h)  # rows of a node that never splits go low
            best = 1e-6
            for name in sorted(names):
                low_g = low_h = low_n = 0
                for b, bin_g, bin_h, bin_n in sorted(names[name]):
                    low_g, low_h, low_n = low_g + bin_g, low_h + bin_h, low_n + bin_n
                    gain = _gain(low_g, low_h) + _gain(g - low_g, h - low_h) - _gain(g, h)
                    if low_n < n and gain > best:
                        best, feature[node - 1], cut[node - 1] = gain, name, cuts[name][b]
                        value[2 * node], value[2 * node + 1] = _newton(low_g, low_h), _newton(g - low_g, h - low_h)
    return feature, cut, [RATE * v for v in value[inner + 1:]]


def _newton(g: int, h: int) -> float:
    return g / (h + LAMBDA * UNIT)


def _gain(g: int, h: int) -> float:
    return g * g / (h + LAMBDA * UNIT) / UNIT


def fit(labelled: DataFrame) -> UrlModel:
    """The model of rows (_url, _host, _path, label 0/1).

    Trees fit at most FIT_ROWS different urls, chosen by a hash of the url, however often one repeats.  Statistics
    count all labelled rows and are a table, whose rows grow with the corpus; the rows that fit the trees see those
    of the other folds.  No labelled rows give no trees."""
    spark = labelled.sparkSession
    labelled = labelled.select("_url", "_host", "_path", "label", fold_of(F.col("_url")).alias("_fold"))
    at = work_dir(spark, "url-statistics")
    keys = F.explode(F.array(F.struct(F.lit("suffix").alias("kind"), suffix(F.col("_host")).alias("key")),
                             F.struct(F.lit("segment").alias("kind"), segment(F.col("_path")).alias("key"))))
    mine = [F.col("_fold") == k for k in range(FOLDS)]
    (labelled.select(keys.alias("x"), "label", "_fold").groupBy("x.kind", "x.key")
     .agg(F.count("*").alias("n"), F.sum("label").alias("ones"), F.array(*[F.struct(
         F.count_if(m).alias("n"), F.coalesce(F.sum(F.when(m, F.col("label"))), F.lit(0)).alias("ones")) for m in mine]).alias("folds"))
     .where(F.col("n") >= SUFFIX_LEAST).write.mode("overwrite").parquet(at))
    n, ones, urls = labelled.agg(F.count("*"), F.sum("label"), F.approx_count_distinct("_url")).first()
    model = UrlModel([], spark.read.parquet(at), ones / n if n else 0.5)
    if not n:
        return model
    # twice the wanted urls by a first hash, so that only few rows are told apart; then the least by a second one
    some = labelled.where(F.pmod(F.xxhash64(F.lit(1), "_url"), F.lit(1 << 40)) <= int((1 << 40) * min(1.0, 2 * FIT_ROWS / max(urls, 1))))
    sample = some.distinct().orderBy(F.xxhash64("_url"), "_url", "label").limit(FIT_ROWS)
    raw = work_dir(spark, "url-features")
    model.features(sample, F.col("_fold")).select("label", F.array(*NAMES).alias("vector")).repartition(8).write.mode("overwrite").parquet(raw)
    rows = spark.read.parquet(raw)
    # cuts at equal shares of the rows, and of the different values, so that small groups are told apart too
    values = rows.select(F.posexplode("vector").alias("name", "x"))
    steps = F.array(*[F.lit(i / BINS) for i in range(1, BINS)])
    found: list[set[float]] = [set() for _ in NAMES]
    for some in (values, values.distinct()):
        for r in some.groupBy("name").agg(F.percentile("x", steps).alias("at")).collect():
            found[r["name"]] |= {round(float(x), 9) for x in r["at"]}
    cuts = [sorted(at) for at in found]
    bins = F.array(*[F.expr(f"size(filter({_doubles(at)}, c -> vector[{i}] > c))") for i, at in enumerate(cuts)])
    binned = work_dir(spark, "url-fit")
    rows.select("label", "vector", bins.alias("bins")).write.mode("overwrite").parquet(binned)
    rows = spark.read.parquet(binned).coalesce(1).persist()  # at most FIT_ROWS short rows: one task, no shuffle
    for _ in range(TREES):
        model.trees.append(_grow(rows, model.trees, cuts))
    rows.unpersist()
    return model


def _ruled(pages: DataFrame, page_id: Column, url: str, rules) -> DataFrame:
    host, path = host_path(F.col(url))
    urls = pages.select(page_id.alias("page_id"), F.col(url).alias("_url"), host.alias("_host"), path.alias("_path"))
    rule, verdict = rule_columns(F.col("_host"), F.col("_path"), rules)
    return urls.select("*", rule.alias("rule"), verdict.alias("_verdict"))


def _labelled(ruled: DataFrame) -> DataFrame:
    return ruled.where("rule is not null").select("_url", "_host", "_path", (F.col("_verdict") == "allow").cast("int").alias("label"))


def judge(pages: DataFrame, page_id: str = "page_id", url: str = "url", rules=tuple(RULES)) -> DataFrame:
    """page_id, host, path, rule, verdict and score of every row of ``pages``.

    The longest fitting rule decides (the later listed of equally long ones); urls without one are allowed if the
    trees, trained on the urls with one, give allow at least even odds.  A null url, or one without ``://``, has empty
    host and path and is judged by the trees; with no labelled url everything else is allowed.  Urls of any length are
    read whole; an empty table gives an empty result.  Row by row once the trees are fitted."""
    ruled = _ruled(pages, F.col(page_id), url, rules)
    model = fit(_labelled(ruled))
    return model.features(ruled).select(
        "page_id", F.col("_host").alias("host"), F.col("_path").alias("path"), "rule",
        F.coalesce("_verdict", F.when(model.score() >= 0, "allow").otherwise("block")).alias("verdict"), model.score().alias("score"))


def held_out(pages: DataFrame, url: str = "url", rules=tuple(RULES)) -> DataFrame:
    """(label, called, n): how the trees call the ruled urls of fold 0 when they learn from those of the others."""
    known = _labelled(_ruled(pages, F.lit(None), url, rules))
    mine = fold_of(F.col("_url")) == 0
    model = fit(known.where(~mine))
    return (model.features(known.where(mine)).groupBy("label", (model.score() >= 0).cast("int").alias("called"))
            .agg(F.count("*").alias("n")))
