"""URL filter: host and path rules first, then gradient-boosted trees on lexical features."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formline.llm.common import ascii_lower, look_up, materialise


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))


def url_host(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """(rule, verdict) of the longest rule that fits the host or a parent domain and the path's start; else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def lexical_features(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """Length, depth, digit ratio, character entropy, parameter counts and the like, as column expressions."""
    n = F.greatest(F.length(url), F.lit(1))
    letters = F.array_distinct(F.filter(F.split(F.lower(url), ""), lambda c: c != ""))
    share = F.transform(letters, lambda c: (F.length(url) - F.length(F.replace(F.lower(url), c, F.lit("")))) / n)
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    return {
        "length": n.cast("double"),
        "host_length": F.length(host).cast("double"),
        "labels": (F.length(host) - F.length(F.replace(host, F.lit("."), F.lit("")))).cast("double"),
        "depth": (F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))).cast("double"),
        "digit_ratio": F.regexp_count(url, F.lit("[0-9]")) / n,
        "hyphens": F.regexp_count(host, F.lit("-")).cast("double"),
        "entropy": F.aggregate(share, F.lit(0.0), lambda s, p: s - F.when(p > 0, p * F.log2(p)).otherwise(0.0)),
        "parameters": F.regexp_count(query, F.lit("[^&=]+=")).cast("double"),
        "has_fragment": F.contains(url, F.lit("#")).cast("double"),
        "secure": F.startswith(url, F.lit("https")).cast("double"),
    }


def judge_urls(
    pages: DataFrame, rules: tuple[Rule, ...] = RULES, train_rows: int = 20_000, trees: int = 12, depth: int = 4, prior: float = 20.0, seed: int = 7
) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, and the model's score for blocking.

    A fitting rule decides. The trees decide the rest; they learn from the URLs that rules label, of which at most
    ``train_rows`` in the order of a hash of the URL are used. Suffix statistics (how many labelled URLs a host's last
    two labels have, and their share of blocks, drawn by ``prior`` pseudo-counts to the share over all) cover all
    pages, by grouped counts that are joined back; a label's own row is taken out of its share. A URL without ``://``
    or a null one has an empty host and path and no rule. With fewer than two kinds of label the verdict without a rule
    is allow. Repeated rows are judged alike; an empty table gives an empty result; other columns are not read.
    """
    url = F.coalesce(F.col("url"), F.lit(""))
    rows = pages.select("page_id", url.alias("url"), url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    rows = rows.withColumn("hit", rule_of(F.col("host"), F.col("path"), rules))
    suffix = F.regexp_extract("host", r"([^.]*\.?[^.]*)$", 1)
    rows = rows.select("page_id", "url", "host", "path", suffix.alias("suffix"), F.col("hit.rule").alias("rule"), F.col("hit.verdict").alias("ruled"))
    rows = rows.withColumn("label", F.when(F.col("ruled").isNotNull(), (F.col("ruled") == "block").cast("double")))
    rows = materialise(rows, "urls")

    per = materialise(rows.groupBy("suffix").agg(F.count(F.lit(1)).alias("urls"), F.count("label").alias("seen"), F.coalesce(F.sum("label"), F.lit(0.0)).alias("blocks")), "suffixes")
    seen, blocks = per.agg(F.coalesce(F.sum("seen"), F.lit(0)), F.coalesce(F.sum("blocks"), F.lit(0.0))).first()
    if not 0 < blocks < seen:
        return rows.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.lit("allow")).alias("verdict"), F.lit(0.0).alias("score"))
    rows = look_up(rows, per, "suffix", "urls")
    own = F.coalesce("label", F.lit(0.0))
    rest = F.col("seen") - F.col("label").isNotNull().cast("double")
    features = lexical_features(F.col("url"), F.col("host"), F.col("path"))
    features["suffix_seen"] = F.log1p(rest)
    features["suffix_blocks"] = (F.col("blocks") - own + prior * blocks / seen) / (rest + prior)
    rows = rows.select("page_id", "host", "path", "rule", "ruled", "label", "url", *(c.alias(f"f_{k}") for k, c in features.items()))
    made = VectorAssembler(inputCols=[f"f_{k}" for k in features], outputCol="features", handleInvalid="keep")
    sample = rows.where("label is not null").orderBy(F.xxhash64("url"), "url", "page_id").limit(train_rows)
    sample = materialise(made.transform(sample).select("features", "label"), "labelled")
    fitted = GBTClassifier(maxIter=trees, maxDepth=depth, seed=seed, cacheNodeIds=False).fit(sample)
    scored = fitted.transform(made.transform(rows))
    score = F.element_at(_as_array("probability"), 2)
    by_model = F.when(F.col("prediction") == 1.0, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", by_model).alias("verdict"), score.alias("score"))


def _as_array(name: str) -> Column:
    from pyspark.ml.functions import vector_to_array

    return vector_to_array(name)
