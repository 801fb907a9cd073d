"""URL filter: fixed rules, then logistic regression on hashed character n-grams of host and path."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from .common import stage_compact

# The rules as (verdict, host, path).
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)

TRAIN_ROWS = 4096     # bound of the labelled URL table, half of it for each verdict
N_FEATURES = 1 << 12
GRAMS = (3, 4)

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host(url: Column) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty if there is none."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)://([^/?#]*)", 1)
    return F.translate(found, UPPER, UPPER.lower())


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)://[^/?#]*([^?#]*)", 1)


def fitting_rule(host_: Column, path_: Column, rules: tuple = RULES) -> Column:
    """The longest rule that fits, as (rule, verdict); null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, name, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host_ == name) | host_.endswith(f".{name}")) & path_.startswith(start)
        out = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def grams(text: Column, mark: str, sizes: tuple[int, ...] = GRAMS) -> Column:
    """Character n-grams of ``^text$``, each marked with the part it is from."""
    def of(chars: Column, n: int) -> Column:
        places = F.filter(F.sequence(F.lit(0), F.size(chars) - 1), lambda i: i <= F.size(chars) - n)
        return F.transform(places, lambda i: F.concat(F.lit(mark), *[F.get(chars, i + k) for k in range(n)]))
    chars = F.split(F.concat(F.lit("^"), text, F.lit("$")), "")
    bound = F.transform(F.array(chars), lambda c: F.concat(*[of(c, n) for n in sizes]))
    return F.get(bound, F.lit(0))


def features(urls: DataFrame, n: int = N_FEATURES) -> DataFrame:
    """Add ``__features``: which hashed n-grams of ``host`` and ``path`` occur."""
    hashing = HashingTF(numFeatures=n, binary=True, inputCol="__grams", outputCol="__features")
    both = F.concat(grams(F.col("host"), "h"), grams(F.col("path"), "p"))
    return hashing.transform(urls.withColumn("__grams", both)).drop("__grams")


@dataclass(frozen=True)
class Verdict:
    """A fitted model, or the share of blocked rows where the labelled rows have one class only."""
    model: LogisticRegressionModel | None
    share: float
    n_features: int = N_FEATURES

    def chance(self, urls: DataFrame) -> DataFrame:
        """Add ``p_block``."""
        if self.model is None:
            return urls.withColumn("p_block", F.lit(self.share))
        return self.model.transform(features(urls, self.n_features)) \
            .withColumn("p_block", vector_to_array("__probability")[1]).drop("__features", "__raw", "__probability",
                                                                            "__guess")


def train(labelled: DataFrame, n_features: int = N_FEATURES) -> Verdict:
    """Fit on a small table with ``host``, ``path`` and ``blocked`` (0 or 1)."""
    small = features(labelled, n_features).select("__features", F.col("blocked").cast("double").alias("__label"))
    seen = small.agg(F.count("*").alias("n"), F.sum("__label").alias("ones")).first()
    if not seen["n"] or seen["ones"] in (0, seen["n"]):
        return Verdict(None, (seen["ones"] or 0.0) / max(1, seen["n"]), n_features)
    fit = LogisticRegression(featuresCol="__features", labelCol="__label", maxIter=40, regParam=0.003,
                             rawPredictionCol="__raw", probabilityCol="__probability", predictionCol="__guess")
    return Verdict(fit.fit(small), seen["ones"] / seen["n"], n_features)


def labelled_urls(urls: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """A small labelled table: the distinct URLs that a rule decides, at most ``rows / 2`` of each verdict.

    The choice is by hash, so it does not depend on how the table is cut. The bound is also applied
    in each map task, so that no task gathers more.
    """
    known = urls.filter(F.col("rule").isNotNull()).select("host", "path", "rule_verdict").distinct()
    parts = [known.filter(F.col("rule_verdict") == verdict).orderBy(F.xxhash64("host", "path"), "host", "path")
             .limit(rows // 2) for verdict in ("allow", "block")]
    table = parts[0].unionAll(parts[1])
    return stage_compact(table.select("host", "path", (F.col("rule_verdict") == "block").cast("int").alias("blocked")),
                         "labelled-urls")


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple = RULES,
               labelled: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """Host, path, rule, verdict and ``p_block`` of every URL; one row per input row.

    A rule fits its host and all subdomains if the path starts with the rule's; the longest wins. Other
    URLs are blocked where the model's ``p_block`` reaches ``threshold``. ``labelled`` is the labelled
    URL table (``host``, ``path``, ``blocked``); without one the URLs that rules decide are the labels.
    A null URL or one without ``://`` has empty host and path; repeated rows give repeated results;
    with an empty table, or labels of one class, ``p_block`` is their share of blocked rows. Only the
    two columns are read; the labelled rows alone are gathered.
    """
    parts = pages.select(pages[id_col].alias("__id"), host(pages[url_col]).alias("host"),
                         path(pages[url_col]).alias("path"))
    ruled = parts.withColumn("__rule", fitting_rule(F.col("host"), F.col("path"), rules)) \
        .select("__id", "host", "path", F.col("__rule.rule").alias("rule"),
                F.col("__rule.verdict").alias("rule_verdict"))
    verdict = train(labelled_urls(ruled) if labelled is None else labelled)
    judged = verdict.chance(ruled)
    guess = F.when(F.col("p_block") >= threshold, "block").otherwise("allow")
    return judged.select(F.col("__id").alias(id_col), "host", "path", "rule",
                         F.coalesce("rule_verdict", guess).alias("verdict"), "p_block")
