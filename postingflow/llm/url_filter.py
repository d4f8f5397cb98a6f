"""URL filters: allow and block rules first, gradient-boosted trees on lexical features else."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postingflow.llm.common import LOWER, UPPER, fresh
from postingflow.session import settle


@dataclass(frozen=True)
class Rule:
    """Fits ``host`` and its subdomains where the url's path starts with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ``://`` with A-Z lower-cased, and path; both empty without one."""
    whole = F.coalesce(url, F.lit(""))
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return F.translate(F.regexp_extract(whole, pattern, 1), UPPER, LOWER), F.regexp_extract(whole, pattern, 2)


def fitting_rule(host: Column, path: Column, rules) -> Column:
    """The longest fitting rule as a struct (rule, verdict), null if none fits."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(found)
    return found


def entropy(text: Column) -> Column:
    """Shannon entropy of a short text's characters, in bits; 0 for an empty one."""
    letters = F.filter(F.split(text, ""), lambda c: c != "")
    length = F.greatest(F.length(text), F.lit(1)).cast("double")

    def part(c):
        share = F.size(F.filter(letters, lambda x: x == c)) / length
        return -share * F.log2(share)

    return F.round(F.aggregate(F.transform(F.array_distinct(letters), part), F.lit(0.0), lambda a, x: a + x), 9)


def digits(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, "0123456789", ""))


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """Features read off the url alone."""
    whole = F.coalesce(url, F.lit(""))
    count = lambda c: (F.length(whole) - F.length(F.replace(whole, F.lit(c)))).cast("double")
    labels = F.split(host, r"\.")
    return {
        "length": F.length(whole).cast("double"),
        "host_length": F.length(host).cast("double"),
        "host_labels": F.size(labels).cast("double"),
        "longest_label": F.array_max(F.transform(labels, F.length)).cast("double"),
        "host_hyphens": (F.length(host) - F.length(F.replace(host, F.lit("-")))).cast("double"),
        "host_entropy": entropy(host),
        "depth": F.size(F.filter(F.split(path, "/"), lambda s: s != "")).cast("double"),
        "path_length": F.length(path).cast("double"),
        "path_entropy": entropy(path),
        "last_length": F.length(F.substring_index(path, "/", -1)).cast("double"),
        "digit_ratio": digits(whole) / F.greatest(F.length(whole), F.lit(1)),
        "host_digits": digits(host).cast("double"),
        "parameters": F.when(whole.contains("?"), count("&") + 1).otherwise(0.0),
        "marks": count("-") + count("_") + count("%") + count("="),
        "secure": whole.startswith("https://").cast("double"),
        "fragment": whole.contains("#").cast("double"),
    }


SUFFIX = ("suffix_blocked", "suffix_weight")
SMOOTH = 10.0  # labelled urls that a suffix's share of blocked ones starts from, at the mean


@dataclass
class UrlModel:
    """The trees, and for each host suffix (last two labels) how labelled urls of it fared."""

    trees: GBTClassificationModel
    suffixes: DataFrame
    mean: float


def suffix_of(host: Column) -> Column:
    return F.substring_index(host, ".", -2)


def features(df: DataFrame, url: str, suffixes: DataFrame, mean: float, own: tuple[Column, Column] | None = None) -> tuple[DataFrame, list[str]]:
    """Add the feature columns under fresh names, suffix statistics joined in.

    ``own`` are the blocked and all labelled rows that a row itself put into the statistics:
    they are taken out again, or trees would learn a label from itself. The statistics table
    is a plain scan, so Spark broadcasts it if its size allows and splits hot suffixes if not.
    """
    host, path = host_and_path(F.col(url))
    columns = lexical(F.col(url), host, path)
    names = {c: fresh(df, f"f_{c}") for c in (*columns, *SUFFIX)}
    key, hits, n = fresh(df, "suffix"), fresh(df, "suffix_hits"), fresh(df, "suffix_n")
    stats = suffixes.select(F.col("suffix").alias(key), F.col("hits").alias(hits), F.col("n").alias(n))
    blocked, all_ = own or (F.lit(0.0), F.lit(0))
    others = F.coalesce(F.col(n), F.lit(0)) - all_
    more = {
        names[SUFFIX[0]]: (F.coalesce(F.col(hits), F.lit(0.0)) - blocked + SMOOTH * mean) / (others + SMOOTH),
        names[SUFFIX[1]]: F.log1p(others.cast("double")),
    }
    out = df.withColumns({names[c]: v for c, v in columns.items()} | {key: suffix_of(host)}).join(stats, key, "left")
    return out.withColumns(more).drop(key, hits, n), list(names.values())


def train(labelled: DataFrame, url: str, label: str, bound: int = 20_000, trees: int = 12, depth: int = 4, seed: int = 7) -> UrlModel | None:
    """Fit boosted trees on urls with a 0/1 label; None unless both labels occur.

    Fitted on at most ``bound`` distinct labelled urls, those with the smallest hash; the
    suffix statistics count all labelled rows. Rows without a url or label take no part.
    """
    clean = labelled.select(F.col(url).alias("url"), F.col(label).cast("double").alias("label")).dropna()
    per_url = settle(clean.groupBy("url").agg(F.sum("label").alias("hits"), F.count("*").alias("n")), "labelled")
    whole = per_url.agg(F.sum("hits") / F.sum("n")).first()[0]
    if whole is None or whole in (0.0, 1.0):
        return None
    suffix = suffix_of(host_and_path(F.col("url"))[0]).alias("suffix")
    suffixes = settle(per_url.groupBy(suffix).agg(F.sum("hits").alias("hits"), F.sum("n").alias("n")), "suffixes")
    sample = per_url.orderBy(F.xxhash64("url"), "url").limit(bound)
    rows, names = features(sample, "url", suffixes, whole, (F.col("hits"), F.col("n")))
    rows = rows.withColumn("y", (F.col("hits") * 2 >= F.col("n")).cast("double"))
    points = settle(VectorAssembler(inputCols=names, outputCol="x").transform(rows).orderBy(F.xxhash64("url"), "url").select("x", "y"), "points")
    if points.select("y").distinct().count() < 2:
        return None
    booster = GBTClassifier(featuresCol="x", labelCol="y", maxIter=trees, maxDepth=depth, stepSize=0.3, seed=seed)
    return UrlModel(booster.fit(points.coalesce(1)), suffixes, whole)


def judge(df: DataFrame, url: str, model: UrlModel | None, host_rules, default: str = "allow") -> DataFrame:
    """Add host, path, rule and verdict: the longest fitting rule's, else the trees'.

    Input columns of these names are replaced. Null or malformed urls have an empty host
    and path, fit no rule and are judged by the trees as an empty url; without a model the
    verdict is ``default``. Rows are judged one by one, so repeats and empty tables need no
    rule.
    """
    df = df.drop(*[c for c in df.columns if c.lower() in ("host", "path", "rule", "verdict")])
    host, path = host_and_path(F.col(url))
    hit, vector, trees = fresh(df, "hit"), fresh(df, "x"), fresh(df, "tree_verdict")
    columns = df.columns
    ruled = df.withColumns({"host": host, "path": path}).withColumn(hit, fitting_rule(F.col("host"), F.col("path"), host_rules))
    if model is None:
        judged = ruled.withColumn(trees, F.lit(default))
    else:
        rows, names = features(ruled, url, model.suffixes, model.mean)
        assembled = VectorAssembler(inputCols=names, outputCol=vector).transform(rows)
        scored = (
            model.trees.setFeaturesCol(vector).setPredictionCol(trees).setRawPredictionCol("").setProbabilityCol("").transform(assembled)
        )
        judged = scored.withColumn(trees, F.when(F.col(trees) >= 0.5, "block").otherwise("allow"))
    return judged.select(
        *columns, "host", "path", F.col(hit)["rule"].alias("rule"),
        F.coalesce(F.col(hit)["verdict"], F.col(trees)).alias("verdict"),
    )
