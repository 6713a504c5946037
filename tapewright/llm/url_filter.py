"""URL filters: gradient-boosted trees on lexical features, under explicit host and path rules.

Everything is DataFrame work: features are column expressions, suffix statistics are grouped aggregates of the
labelled urls, the trees are Spark's own GBTClassifier, and a fitted model is applied as one column expression.

Defined results: null urls and urls without `://` have an empty host and path and meet no rule; without labelled rows of
both kinds the method allows all; rows are kept one for one, repeated ones too.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_rows, col, stash, without

FEATURES = ("url_length", "host_length", "host_labels", "host_digits", "host_dashes", "host_entropy", "path_depth", "path_length", "path_digits", "path_entropy", "longest_part", "n_params", "query_length", "has_fragment", "has_extension", "secure", "suffix_risk", "domain_risk", "suffix_rows", "domain_rows")
#: Labelled urls of either kind, half and half, that every suffix and domain is taken to have beside its own.
PRIOR = 10.0
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """A rule fits its host and all subdomains, where the url's path starts with the rule's."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def parse(docs: DataFrame, url_col: str = "url") -> DataFrame:
    """Adds host, path and rest (what follows the path).

    Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; path: then up to `?`, `#` or the end.
    """
    url = col(url_col)
    at = F.instr(url, "://")
    tail = F.when(at > 0, F.substr(url, at + F.lit(3)))
    host = F.regexp_extract(tail, r"(?s)^[^/?#]*", 0)
    path = F.regexp_extract(tail, r"(?s)^[^/?#]*([^?#]*)", 1)
    return without(docs, ["host", "path", "rest"]).withColumns({"host": F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit("")), "path": F.coalesce(path, F.lit("")), "rest": F.coalesce(F.regexp_extract(tail, r"(?s)^[^?#]*(.*)$", 1), F.lit(""))})


def matching_rule(rules: list[Rule]) -> Column:
    """struct(rule, verdict) of the longest rule that fits host and path; null where none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def _entropy(text: Column) -> Column:
    """Bits a character: log2 n - sum(c log2 c) / n over the distinct characters."""
    chars = F.split(text, "")
    n = F.greatest(F.char_length(text), F.lit(1)).cast("double")

    def bits(c: Column) -> Column:
        k = (F.char_length(text) - F.char_length(F.replace(text, c, F.lit("")))).cast("double")
        return F.when(k > 0, k * F.log2(k)).otherwise(0.0)

    return F.log2(n) - F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda acc, c: acc + F.when(c == "", F.lit(0.0)).otherwise(bits(c))) / n


def _count(text: Column, pattern: str) -> Column:
    return (F.char_length(text) - F.char_length(F.regexp_replace(text, pattern, ""))).cast("double")


def lexical(parsed: DataFrame, url_col: str) -> DataFrame:
    """Adds the lexical features of a parsed frame, and the keys of the suffix statistics."""
    host, path, rest = F.col("host"), F.col("path"), F.col("rest")
    length = lambda c: F.char_length(c).cast("double")
    labels = F.split(host, r"\.")
    share = lambda n, of: n / F.greatest(of, F.lit(1.0))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    return parsed.withColumns(
        {
            "url_length": F.coalesce(length(col(url_col)), F.lit(0.0)),
            "host_length": length(host),
            "host_labels": F.size(labels).cast("double"),
            "host_digits": share(_count(host, "[0-9]"), length(host)),
            "host_dashes": _count(host, "[-_]"),
            "host_entropy": _entropy(host),
            "path_depth": _count(path, "/"),
            "path_length": length(path),
            "path_digits": share(_count(path, "[0-9]"), length(path)),
            "path_entropy": _entropy(path),
            "longest_part": F.aggregate(F.split(path, "/"), F.lit(0.0), lambda acc, p: F.greatest(acc, F.char_length(p).cast("double"))),
            "n_params": _count(rest, "[=]"),
            "query_length": length(rest),
            "has_fragment": flag(F.contains(rest, F.lit("#"))),
            "has_extension": flag(F.rlike(path, F.lit(r"\.[A-Za-z0-9]{1,5}$"))),
            "secure": flag(F.lower(col(url_col)).startswith("https://")),
            "__suffix": F.element_at(labels, -1),
            "__domain": F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), "."),
        }
    )


@dataclass
class UrlModel:
    trees: GBTClassificationModel | None
    suffixes: DataFrame | None
    domains: DataFrame | None

    def predict(self, docs: DataFrame, url_col: str = "url") -> DataFrame:
        """Adds host, path and blocked (boolean, the method's)."""
        parsed = parse(docs, url_col)
        if self.trees is None:
            return without(parsed.drop("rest"), ["blocked"]).withColumn("blocked", F.lit(False))
        held = without(parsed, [*FEATURES, "blocked", "__suffix", "__domain", "__x", "__rest", "__verdict", "__score"])
        # input columns with names of the operator's own give way; the others are packed so that no name clashes
        packed = parsed.select(F.struct(*[col(c) for c in held.columns if c != "rest"]).alias("__row"), col(url_col).alias("__url"), "host", "path", "rest")
        x = _join_risk(lexical(packed, "__url"), self.suffixes, self.domains)
        scored = self.trees.transform(VectorAssembler(inputCols=list(FEATURES), outputCol="__x").transform(x))
        return scored.select("__row.*", (F.col("__verdict") > 0.5).alias("blocked"))


def _counts(labelled: DataFrame, key: str, name: str, *more: str) -> DataFrame:
    return labelled.groupBy(key, *more).agg(F.sum("__y").alias(f"{name}_blocked"), F.count(F.lit(1)).cast("double").alias(f"{name}_seen"))


def _risk(name: str, blocked: Column, seen: Column) -> dict[str, Column]:
    """Blocked share of the labelled urls, drawn to one half by PRIOR urls that nobody saw, and how many there were."""
    return {f"{name}_risk": (blocked + PRIOR / 2) / (seen + PRIOR), f"{name}_rows": F.log1p(seen)}


def _join_risk(x: DataFrame, suffixes: DataFrame, domains: DataFrame) -> DataFrame:
    """Adds the statistics of a host's last label and last two, over all labelled urls; sizes decide how they are joined."""
    for key, name, found in (("__suffix", "suffix", suffixes), ("__domain", "domain", domains)):
        x = x.join(found, key, "left")
        x = x.withColumns(_risk(name, F.coalesce(f"{name}_blocked", F.lit(0.0)), F.coalesce(f"{name}_seen", F.lit(0.0))))
    return x


def fit(docs: DataFrame, url_col: str, blocked: Column, most_rows: int = 4000, trees: int = 12, depth: int = 4, folds: int = 4) -> UrlModel:
    """Fit on at most `most_rows` distinct labelled urls of each kind (a documented bound), the same ones on every run.

    Suffix and domain statistics count every distinct labelled url; a url that is learnt from gets those of the hosts in
    the other folds, so that the trees learn what the statistics say of hosts that they do not hold.
    `blocked` is a nullable boolean over the columns of `docs` plus host and path; null rows are unlabelled.
    """
    parsed = parse(docs, url_col).withColumn("__y", blocked.cast("double")).where("__y is not null and host <> ''").select(col(url_col).alias("__url"), "host", "path", "rest", "__y")
    urls = parsed.dropDuplicates(["__url", "__y"])
    parts = [bounded_rows(urls.where(F.col("__y") == y), most_rows, F.col("__url"), F.col("host")) for y in (0.0, 1.0)]
    fold = F.pmod(F.xxhash64("host"), F.lit(folds)).alias("__fold")
    sample = stash(lexical(parts[0].unionByName(parts[1]), "__url").select("*", fold).coalesce(4))
    if sample.select("__y").distinct().count() < 2:
        return UrlModel(None, None, None)
    every = stash(lexical(urls, "__url").select("__suffix", "__domain", "__y", fold))
    whole, x = [], sample
    for key, name in (("__suffix", "suffix"), ("__domain", "domain")):
        by_fold = stash(_counts(every, key, name, "__fold"))
        total = stash(by_fold.groupBy(key).agg(*[F.sum(f"{name}_{c}").alias(f"{name}_{c}") for c in ("blocked", "seen")]))
        mine = by_fold.select(key, "__fold", F.col(f"{name}_blocked").alias("__b"), F.col(f"{name}_seen").alias("__n"))
        x = x.join(total, key).join(mine, [key, "__fold"])
        x = x.withColumns(_risk(name, F.col(f"{name}_blocked") - F.col("__b"), F.col(f"{name}_seen") - F.col("__n"))).drop("__b", "__n")
        whole.append(total)
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="__x").transform(x).select("__x", "__y")
    boosted = GBTClassifier(featuresCol="__x", labelCol="__y", predictionCol="__verdict", maxIter=trees, maxDepth=depth, stepSize=0.2, seed=17, maxBins=32)
    boosted.set(boosted.rawPredictionCol, "__score")
    boosted.set(boosted.probabilityCol, "__share")
    return UrlModel(boosted.fit(rows), *whole)


def judge(docs: DataFrame, rules: list[Rule], model: UrlModel, url_col: str = "url") -> DataFrame:
    """Adds host, path, rule (the longest that fits, else null), verdict (the rule's, else the method's) and blocked."""
    out = model.predict(docs, url_col)
    return without(out, ["rule", "verdict"]).withColumn("__m", matching_rule(rules)).withColumns({"rule": F.col("__m.rule"), "verdict": F.coalesce(F.col("__m.verdict"), F.when(F.col("blocked"), "block").otherwise("allow"))}).drop("__m")
