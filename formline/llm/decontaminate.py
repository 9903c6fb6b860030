"""Benchmark decontamination by a prefix-filtered set join, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from formline.llm.common import SMALL_ROWS, materialise, release

#: Tasks over which one shingle's places are dealt where the benchmark isn't broadcast.
SALTS = 16
#: Bytes of ASCII that stand in no word: all but digits and letters. Each becomes a blank.
_GAPS = "".join(chr(c) for c in range(128) if not chr(c).isalnum())
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_list(text: Column) -> Column:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after lower-casing A-Z; null has none."""
    plain = F.translate(F.coalesce(text, F.lit("")), _UPPER + _GAPS, _LOWER + " " * len(_GAPS))
    return F.array_remove(F.split(plain, " "), "")


def _shingles(words: Column, k: int) -> Column:
    """A 64-bit hash for each run of k words, in order; the last k - 1 places are dropped."""
    at = F.transform(words, lambda w, i: F.xxhash64(w, *(F.get(words, i + j) for j in range(1, k))))
    return F.slice(at, 1, F.greatest(F.size(words) - (k - 1), F.lit(0)))


def benchmark_windows(benchmark: DataFrame, window: int, shingle: int) -> DataFrame:
    """Distinct windows: (words, length, items), with the shingles of each as (hash, offset)."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), word_list(F.col("text")).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - (window - 1), F.lit(1)))
    windows = items.select("item", F.explode(F.transform(starts, lambda i: F.slice("words", i, window))).alias("words"))
    return windows.groupBy("words").agg(F.collect_set("item").alias("items")).withColumn("length", F.size("words"))


def _salt() -> Column:
    return F.pmod(F.col("at"), F.lit(SALTS))


def salted(hashes: DataFrame) -> DataFrame:
    """A row for each salt of each of the benchmark's hashes."""
    return hashes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, shingle: int = 5, row_key: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A benchmark item's windows are its runs of ``window`` words, or all its words if it has fewer. A document's word is
    hit if it lies inside any occurrence of a window. The search is a set join with a prefix filter: a window is the
    set of its word shingles, containment must be whole, so its one rarest shingle (fewest documents' places hold it,
    counted over all documents) must occur and is the only one joined. The place of that shingle in the window gives
    the start; the start and the end must lie inside the document, and the words there are compared with the window's.

    Document words are split once. The benchmark's shingles are broadcast if they are ``SMALL_ROWS`` at most; then only
    document shingles that any window has leave the scan, each with the words around it, and one further row a
    document. Beyond, words are written once, (row, place, hash) alone is shuffled to find those shingles, and a
    document's words meet all of its places in one row, so what moves grows with the words and not their square; a
    shingle's places are dealt over ``SALTS`` tasks, so that a very frequent one doesn't end in one task. Null and empty
    texts have no words and are not hit; null item ids are left out of n_items and items_sha256; repeated rows are judged
    each; items without words have no window; with an empty benchmark nothing is hit. Other columns are not read.
    ``row_key`` names a column of distinct values, which the result then has too.
    """
    spark = docs.sparkSession
    windows = materialise(benchmark_windows(benchmark, window, shingle), "windows")
    sizes = [r[0] for r in windows.select(F.least("length", F.lit(shingle)).alias("k")).distinct().collect()]  # 1 to shingle
    parts = [
        windows.where(F.least("length", F.lit(shingle)) == k).select(F.posexplode(_shingles(F.col("words"), k)).alias("offset", "hash"), "words", "length", "items")
        for k in sizes
    ]
    bench = parts[0] if parts else windows.select(F.lit(0).alias("offset"), F.lit(0).cast("long").alias("hash"), "words", "length", "items").limit(0)
    for p in parts[1:]:
        bench = bench.unionByName(p)
    bench = materialise(bench, "bench")
    few = bench.count() <= SMALL_ROWS

    row = F.col(row_key) if row_key else F.monotonically_increasing_id()
    words = docs.select("doc_id", row.alias("row"), word_list(F.col("text")).alias("words"))
    places = [F.transform(_shingles(F.col("words"), k), lambda h, i: F.struct((i + 1).alias("at"), h.alias("hash"))) for k in sizes]
    n_words = F.size("words").cast("long").alias("n_words")
    near = F.slice("words", F.greatest(F.col("at") - (window - shingle), F.lit(1)), 2 * window)
    if few:
        mark = F.xxhash64(F.lit("a document's own row"))
        known = bench.select("hash").distinct().unionByName(spark.range(1).select(mark.alias("hash")))
        own = F.array(F.struct(F.lit(0).alias("at"), mark.alias("hash")))
        spread = words.select("doc_id", "row", "words", F.explode(F.concat(own, *places)).alias("p")).select("doc_id", "row", "words", "p.at", "p.hash")
        met = spread.join(F.broadcast(known), "hash").select("doc_id", "row", "at", "hash", n_words, F.when(F.col("at") > 0, near).alias("near"))
        met = materialise(met, "shingles")
        judged = met.where("at = 0").select("row", "doc_id", "n_words")
        found = met.where("at > 0")
    else:
        words = materialise(words, "words")
        places = places or [F.array().cast("array<struct<at:int,hash:bigint>>")]
        spread = words.select("row", F.explode(F.concat(*places)).alias("p")).select("row", "p.at", "p.hash")
        known = salted(bench.select("hash").distinct())
        met = spread.withColumn("salt", _salt()).join(known, ["hash", "salt"], "left_semi").groupBy("row").agg(F.collect_list(F.struct("at", "hash")).alias("met"))
        spread = words.select("row", "words").join(met, "row").select("row", "words", F.explode("met").alias("p")).select("row", "words", "p.at", "p.hash")
        found = materialise(spread.select("row", "at", "hash", n_words, near.alias("near")), "shingles")
        judged = words.select("row", "doc_id", n_words)

    rarity = found.groupBy("hash").agg(F.count(F.lit(1)).alias("places"))
    ranked = bench.join(rarity, "hash", "left").fillna(0, ["places"])
    first = Window.partitionBy("words").orderBy("places", "hash", "offset")
    prefix = ranked.withColumn("r", F.row_number().over(first)).where("r = 1 and places > 0").drop("r", "places")
    prefix = materialise(prefix, "prefix")

    hits = found.join(F.broadcast(prefix), "hash") if few else found.withColumn("salt", _salt()).join(salted(prefix), ["hash", "salt"])
    start = F.col("at") - F.col("offset")
    first_near = F.greatest(F.col("at") - (window - shingle), F.lit(1))
    hits = hits.withColumn("start", start).where((F.col("start") >= 1) & (F.col("start") + F.col("length") - 1 <= F.col("n_words")))
    hits = hits.where(F.slice("near", F.col("start") - first_near + 1, F.col("length")) == F.col("words"))
    hits = hits.select("row", "start", (F.col("start") + F.col("length")).alias("stop"), "items")

    run = Window.partitionBy("row").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    covered = hits.groupBy("row", "start").agg(F.max("stop").alias("stop"))
    covered = covered.withColumn("reach", F.max("stop").over(run))
    gain = F.greatest(F.col("stop") - F.greatest("start", F.coalesce("reach", F.lit(0))), F.lit(0))
    covered = covered.groupBy("row").agg(F.sum(gain).cast("long").alias("n_hit"))
    items = hits.select("row", F.explode("items").alias("item")).groupBy("row").agg(F.sort_array(F.collect_set("item")).alias("items"))
    out = judged.join(covered, "row", "left").join(items, "row", "left")
    named = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(named).cast("long").alias("n_items"),
        F.sha2(F.array_join(named, ","), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        *([F.col("row").alias(row_key)] if row_key else []),
    )
