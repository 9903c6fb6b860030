"""Language identification by Bayesian fusion of text, declared language, address and host evidence."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from formline.llm.arrow_words import pieces
from formline.llm.common import look_up, materialise, ship
from formline.llm.html_text import main_text
from formline.llm.url_filter import url_host, url_path

ship(__name__)

#: Buckets of the text model's three-byte strings.
GRAMS = 1 << 13
#: A text's evidence counts as that of this many of its three-byte strings at most, for they aren't independent.
TEXT_WEIGHT = 40
#: Pseudo-counts that pull a host's language shares to its domain's, and a domain's to those of all rows.
HOST_PULL, DOMAIN_PULL = 5.0, 50.0


def _letters() -> np.ndarray:
    """Byte to byte: A-Z small, other ASCII that is no letter to a blank, the rest as it is."""
    t = np.arange(256, dtype=np.uint8)
    t[:128] = 32
    for c in range(97, 123):
        t[c] = t[c - 32] = c
    return t


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the three-byte strings of each text, blanks in a row left out, and their number in each text."""
    joined = _letters()[np.frombuffer(b"".join(t + b"  " for t in texts), np.uint8)].astype(np.uint32)
    of = np.repeat(np.arange(len(texts)), [len(t) + 2 for t in texts])
    if len(joined) < 3:
        return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    code = (joined[:-2] << 16) | (joined[1:-1] << 8) | joined[2:]
    keep = (joined[1:-1] != 32) & (of[:-2] == of[2:])
    bucket = (code[keep] * np.uint32(0x9E3779B1)) >> np.uint32(32 - 13)
    return bucket.astype(np.int64), np.bincount(of[:-2][keep], minlength=len(texts))


def text_model(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and their log shares of each bucket (languages, GRAMS), from counts over all labelled documents."""

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for part in pieces(b, 1):
                bucket, n = grams([(t or "").encode() for t in part.column(1).to_pylist()])
                langs, of = np.unique(np.array(part.column(0).to_pylist(), object).astype(str), return_inverse=True)
                flat = np.bincount(np.repeat(of, n) * GRAMS + bucket, minlength=len(langs) * GRAMS).reshape(-1, GRAMS)
                for lang, row in zip(langs, flat, strict=True):
                    sums[lang] = sums.get(lang, 0) + row
        for lang, row in sums.items():
            at = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at, pa.int32()), pa.array(row[at], pa.int64())], ["lang", "gram", "n"])

    rows = docs.where("lang is not null").select(F.col("lang").cast("string"), F.col("text").cast("string"))
    counts = rows.mapInArrow(count, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = materialise(counts, "grams")
    got = counts.toPandas()  # at most GRAMS rows for each language that the labels name
    langs = sorted(got.lang.unique())
    table = np.full((len(langs), GRAMS), 0.5, np.float32)
    table[np.searchsorted(langs, got.lang.to_numpy(str)) if len(langs) else [], got.gram] += got.n
    return langs, np.log(table / table.sum(1, keepdims=True)) if len(langs) else table


def text_evidence(rows: DataFrame, langs: list[str], table: np.ndarray) -> DataFrame:
    """Adds ``ll``, a log-likelihood for each language, and ``text_lang``, the likeliest (null without letters).

    ``rows`` has columns kind, text and others; the text of rows of kind page is markup, of which the main text counts.
    """
    model = rows.sparkSession.sparkContext.broadcast((langs, table))
    kept = [c for c in rows.columns if c != "text"]
    tags = re.compile(r"<[^>]*>")

    def run(batches):
        langs, table = model.value
        for b in batches:
            at = b.schema.get_field_index("text")
            for part in pieces(b, at):
                kinds = part.column(part.schema.get_field_index("kind")).to_pylist()
                texts = [t or "" for t in part.column(at).to_pylist()]
                texts = [(main_text(t) or tags.sub(" ", t)) if k == "page" else t for k, t in zip(kinds, texts, strict=True)]
                bucket, n = grams([t.encode() for t in texts])
                sums = np.zeros((len(texts), len(langs)))
                some = np.flatnonzero(n)
                if len(some) and len(langs):
                    sums[some] = np.add.reduceat(table[:, bucket], (np.cumsum(n) - n)[some], axis=1).T
                sums *= np.minimum(1.0, TEXT_WEIGHT / np.maximum(n, 1))[:, None]
                best = [langs[i] if c and len(langs) else None for i, c in zip(sums.argmax(1) if len(langs) else n, n, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(part.schema.get_field_index(c)) for c in kept), pa.array(list(sums), pa.list_(pa.float64())), pa.array(best, pa.string())], [*kept, "ll", "text_lang"]
                )

    schema = rows.select(*kept).schema.add("ll", T.ArrayType(T.DoubleType())).add("text_lang", T.StringType())
    return rows.mapInArrow(run, schema)


def _shares(rows: DataFrame, key: str, langs: Column, name: str) -> DataFrame:
    """For each value of ``key`` the number of its rows of each text language, as an array; the plan doesn't grow with the languages."""
    per = rows.where(F.col(key).isNotNull() & F.col("text_lang").isNotNull()).groupBy(key, "text_lang").agg(F.count(F.lit(1)).alias("n"))
    per = per.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("text_lang", "n"))).alias("_m"), F.sum("n").alias("rows"))
    return per.select(key, F.transform(langs, lambda x: F.coalesce(F.try_element_at("_m", x).cast("double"), F.lit(0.0))).alias(name), "rows")


def posterior(rows: DataFrame, langs: list[str], whole: np.ndarray) -> DataFrame:
    """Adds ``logs``, the log of each language's posterior up to a constant, from columns ll, text_lang and the counts n_host, n_domain, n_declared and n_code.

    ``whole`` counts all rows by text language. Every step is one expression over arrays of languages.
    """
    base = (whole + 1.0) / (whole + 1.0).sum()
    names, base, whole = (F.array(*(F.lit(x) for x in v)) for v in (langs, base.tolist(), whole.tolist()))
    rows = rows.withColumn("_own", F.transform(names, lambda x: F.coalesce((F.col("text_lang") == x).cast("double"), F.lit(0.0))))
    none = F.array_repeat(F.lit(0.0), len(langs))
    # rows of the key in each language, without this row's vote
    rows = rows.withColumns({f"_{k}": F.when(F.col(f"n_{k}").isNotNull(), F.zip_with(f"n_{k}", "_own", lambda n, own: n - own)).otherwise(none) for k in ("host", "domain", "declared", "code")})
    rows = rows.withColumns({f"_all_{k}": F.aggregate(f"_{k}", F.lit(0.0), lambda s, x: s + x) for k in ("host", "domain")})
    rows = rows.withColumn("_domain", F.zip_with("_domain", base, lambda n, p: (n + DOMAIN_PULL * p) / (F.col("_all_domain") + DOMAIN_PULL)))
    prior = F.zip_with("_host", "_domain", lambda n, p: (n + HOST_PULL * p) / (F.col("_all_host") + HOST_PULL))
    rows = rows.withColumn("logs", F.zip_with("ll", prior, lambda x, p: x + F.log(p)))
    for key in ("declared", "code"):
        chance = F.zip_with(f"_{key}", whole, lambda n, w: (n + 1.0) / (w + 2.0))
        rows = rows.withColumn("logs", F.when(F.col(key).isNull(), F.col("logs")).otherwise(F.zip_with("logs", chance, lambda x, p: x + F.log(p))))
    return rows


def identify(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """One row per document and per page: doc_id, page_id, lang, probability, text_lang, declared, code, host.

    The text model is learnt from the labelled documents by grouped counts, for every language that a label names; a
    language takes 8,192 numbers in each executor. The posterior of a language is its text
    likelihood, times the chance of the language declared in the markup, times that of the code in the address (a first
    path part of two letters, else the last host label), times its share on the host. The chances are counts over all
    rows of the language that the text suggests, smoothed by one each. A host's shares are pulled to its domain's and
    a domain's to those of all rows; a row's own vote is taken out. A document has no markup and no address; its source
    stands for a host of its own.

    Evidence that a row lacks has no say; a row with none gets the shares of all rows. Ties go to the first language by
    name. Nulls in any column, empty texts and repeated rows are treated so; without labelled documents lang is null;
    an empty table adds no rows; other columns are not read.
    """
    null = F.lit(None).cast("string")
    langs, table = text_model(docs)
    a = docs.select(F.lit("document").alias("kind"), F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("long").alias("page_id"), F.col("text").cast("string"),
                    null.alias("declared"), null.alias("code"), F.concat(F.lit("source:"), F.col("source").cast("string")).alias("host"), null.alias("domain"))
    host, path = url_host(F.col("url")), url_path(F.col("url"))
    declared = F.lower(F.regexp_extract(F.col("html"), r"""(?i)<html\b[^>]*?\blang\s*=\s*["']?([a-z]{2,3})""", 1))
    code = F.lower(F.coalesce(_some(F.regexp_extract(path, r"^/([A-Za-z]{2})(?:/|$)", 1)), _some(F.regexp_extract(host, r"\.([a-z]{2})$", 1))))
    b = pages.select(F.lit("page").alias("kind"), F.lit(None).cast("long").alias("doc_id"), F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("text"),
                     _some(declared).alias("declared"), code.alias("code"), _some(host).alias("host"), _some(F.regexp_extract(host, r"([^.]*\.?[^.]*)$", 1)).alias("domain"))
    rows = materialise(text_evidence(a.unionByName(b), langs, table), "evidence")
    if not langs:
        return rows.select("doc_id", "page_id", null.alias("lang"), F.lit(0.0).alias("probability"), "text_lang", "declared", "code", "host")
    seen = {r[0]: float(r[1]) for r in rows.groupBy("text_lang").count().collect()}  # a row per language
    names = F.array(*map(F.lit, langs))
    for key in ("host", "domain", "declared", "code"):
        rows = look_up(rows, materialise(_shares(rows, key, names, f"n_{key}"), key), key, "rows").drop("rows")
    rows = posterior(rows, langs, np.array([seen.get(x, 0.0) for x in langs]))
    rows = rows.withColumn("top", F.array_max("logs"))
    best = F.element_at(names, F.array_position("logs", F.col("top")).cast("int"))
    chance = 1 / F.aggregate("logs", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("top")))
    return rows.select("doc_id", "page_id", best.alias("lang"), chance.alias("probability"), "text_lang", "declared", "code", "host")


def _some(c: Column) -> Column:
    return F.when(c != "", c)
