"""Near-duplicate groups by circulant MinHash, banding and exact Jaccard verification."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from formline.llm.arrow_words import hash_words, pieces, split_words
from formline.llm.common import components, join_groups, join_sized, labels, materialise, release, ship, sweep

ship(__name__)

#: Odd factors and shifts of two well-known bijective bit mixers.
_WIDE = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_NARROW = (np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35))
_STEP = 0x9E3779B97F4A7C15
#: Members of a pivot that meet one copy of its text.
PART_MEMBERS = 200
#: Rows of buckets that are few enough for their members to be compared with each other at once, as at the last level.
FEW_ROWS = 20_000


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _WIDE[0]
    h = (h ^ (h >> np.uint64(27))) * _WIDE[1]
    return h ^ (h >> np.uint64(31))


def shingles(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the texts' k-word shingles, repeats included, and their number in each text.

    A text of fewer words has one shingle, all its words; one without words has none.
    """
    words, count = split_words(texts)
    h = hash_words(words)
    n = len(h)
    left = np.repeat(np.cumsum(count), count) - np.arange(n)  # words from here to the text's end
    first = np.repeat(np.cumsum(count) - count, count) == np.arange(n)
    total = np.zeros(n, np.uint64)
    used = np.zeros(n, np.uint64)
    for j in range(min(k, n)):
        on = left[: n - j] > j
        total[: n - j][on] += h[j:][on] * np.uint64((_STEP * (2 * j + 1)) & (2**64 - 1))
        used[: n - j] += on
    whole = used == k
    keep = whole | first
    made = mix(total + used * np.uint64(0xD6E8FEB86659FD93))[keep]
    return made, np.where(count > 0, np.maximum(count - k + 1, 1), 0)


def signature(hashes: np.ndarray, count: np.ndarray, coordinates: int) -> np.ndarray:
    """Circulant MinHash: (texts, coordinates) of 32 bits, for texts that have shingles.

    The first permutation places each shingle, the second is shifted round by one place per coordinate; both are
    bijections of 32-bit numbers, so no table of places is held.
    """
    place = mix(hashes ^ np.uint64(_STEP)).astype(np.uint32)
    starts = np.cumsum(count) - count
    out = np.empty((len(count), coordinates), np.uint32)
    t, u = np.empty_like(place), np.empty_like(place)
    for c in range(coordinates):
        np.subtract(place, np.uint32(c + 1), out=t)
        np.right_shift(t, 16, out=u)
        np.bitwise_xor(t, u, out=t)
        np.multiply(t, _NARROW[0], out=t)
        np.right_shift(t, 13, out=u)
        np.bitwise_xor(t, u, out=t)
        np.multiply(t, _NARROW[1], out=t)
        np.right_shift(t, 16, out=u)
        np.bitwise_xor(t, u, out=t)
        out[:, c] = np.minimum.reduceat(t, starts)
    return out


def band_hashes(sig: np.ndarray, bands: int) -> np.ndarray:
    parts = sig.reshape(len(sig), bands, -1).astype(np.uint64)
    h = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(_STEP), parts.shape[:2]).copy()
    for r in range(parts.shape[2]):
        h = mix(h ^ (parts[:, :, r] + np.uint64((r + 1) * int(_WIDE[0]) & (2**64 - 1))))
    return h.view(np.int64)


def sketches(docs: DataFrame, k: int, bands: int, rows: int, row_key: str | None = None) -> DataFrame:
    """(doc_id, rk, n, key, bands), and row if there is a ``row_key``: rk hashes the row, n counts distinct shingles, key digests the set."""

    def run(batches):
        import xxhash

        for b in batches:
            for part in pieces(b, 2):
                h, count = shingles(part.column(2), k)
                at = np.cumsum(count) - count
                sets = [np.unique(h[a : a + c]) for a, c in zip(at, count, strict=True)]
                keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                some = np.flatnonzero(count)
                made = [None] * len(count)
                if len(some):
                    for i, x in zip(some, band_hashes(signature(h, count[some], bands * rows), bands), strict=True):
                        made[i] = x
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(made, pa.list_(pa.int64())), *part.columns[3:]],
                    ["doc_id", "rk", "n", "key", "bands", *part.schema.names[3:]],
                )

    rows_in = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("rk"), F.col("text").cast("string").alias("text"), *([F.col(row_key).alias("row")] if row_key else []))
    row_type = f", row {docs.schema[row_key].dataType.simpleString()}" if row_key else ""
    return rows_in.mapInArrow(run, "doc_id long, rk long, n long, key binary, bands array<long>" + row_type)


def compare(pairs: DataFrame, k: int, percent: int, far: bool) -> DataFrame:
    """(mid, pivot, n, n_pivot, linked, near, delta) from (mid, pivot, text, pivot_text): whole sets are compared.

    delta is the symmetric difference of the two sets, so any two members of a pivot can be compared by theirs. As
    Jaccard distances obey the triangle inequality, a member can be linked with one that is linked with the pivot only
    if it is ``near``: at most twice the linking distance away. Deltas of others are left out unless ``far``.
    """

    def run(batches):
        for b in batches:
            for part in pieces(b, (2, 3), 1_000_000):
                sides = []
                for c in (2, 3):
                    h, count = shingles(part.column(c), k)
                    at = np.cumsum(count) - count
                    sides.append([np.unique(h[a : a + n]) for a, n in zip(at, count, strict=True)])
                delta = [np.setxor1d(x, y, assume_unique=True).view(np.int64) for x, y in zip(*sides, strict=True)]
                n, m, d = (np.array([len(x) for x in s], np.int64) for s in (*sides, delta))
                linked = 100 * (n + m - d) >= percent * (n + m + d)
                near = 100 * (n + m - d) >= (2 * percent - 100) * (n + m + d)
                delta = [x if ok or far else None for x, ok in zip(delta, near, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(n), pa.array(m), pa.array(linked), pa.array(near), pa.array(delta, pa.list_(pa.int64()))],
                    ["mid", "pivot", "n", "n_pivot", "linked", "near", "delta"],
                )

    return pairs.select("mid", "pivot", "text", "pivot_text").mapInArrow(run, "mid long, pivot long, n long, n_pivot long, linked boolean, near boolean, delta array<long>")


def delta_links(star: DataFrame, percent: int, groups: DataFrame | None) -> DataFrame:
    """Links (a, b) between members of a pivot, one of which at least isn't linked with the pivot.

    Two members differ by the symmetric difference of their deltas, and with r = (100 - percent) / (100 + percent)
    they are linked if that has at most r times the sum of their sizes. So their deltas must overlap in half of
    either, give or take what sizes allow, and, for a member not linked with the pivot, in all but r times the
    largest possible sum: a set join with a prefix filter, on each delta's rarest elements, with a bound by the places
    of the common element, then verified on whole deltas.

    Without ``groups`` linked members meet near ones that aren't linked. With it, a table (mid, component) of what is
    known so far, members that aren't linked meet each other too, if they are of different components.
    """
    last = groups is not None
    r = (100 - percent) / (100 + percent)
    star = star.where("near" if not last else "true")
    per = star.groupBy("pivot").agg(F.max("n").alias("widest"), F.count(F.lit(1)).alias("members"), F.min("linked").alias("closed"))
    per = materialise(per.where("not closed").drop("closed"), "pivots")
    star = join_sized(star, per, "pivot", "members").withColumn("nd", F.size("delta").cast("long"))
    if last:
        star = star.join(groups, "mid", "left").withColumn("component", F.coalesce("component", "mid"))
    else:
        star = star.withColumn("component", F.lit(0).cast("long"))
    star = materialise(star.withColumn("id", F.monotonically_increasing_id()), "star")
    toks = star.select("id", "pivot", F.explode("delta").alias("tok"))
    freq = materialise(toks.groupBy("pivot", "tok").agg(F.count(F.lit(1)).alias("f")), "frequencies")
    rare = Window.partitionBy("id").orderBy("f", "tok")
    toks = join_sized(toks, freq, ["pivot", "tok"], "f").withColumn("place", F.row_number().over(rare)).select("id", "tok", "place")
    # least overlap: more than half of the delta, but for what the member is larger (or another could be) than the pivot
    half = F.when(F.col("linked"), (F.col("nd") - r * (F.col("n") - F.col("n_pivot"))) / 2).otherwise(
        (F.col("nd") - r * (F.col("n") + F.col("widest")) + r * (F.col("n_pivot") + F.col("n"))) / 2
    )
    most = F.when(F.col("linked"), F.lit(0.0)).otherwise(F.col("nd") - r * (F.col("n") + F.col("widest")))

    def length(least):
        return F.col("nd") - F.greatest(F.ceil(least - 1e-6), F.lit(1)) + 1

    # an unlinked member meets linked ones, of which any overlap may do, with the weaker bound
    first = F.when(F.col("linked"), length(half)).otherwise(length(most))
    side = star.select("id", "pivot", "mid", "linked", "near", "n", "nd", "component", first.alias("upto"), length(F.greatest(half, most)).alias("upto_open"))
    heads = materialise(toks.join(side, "id").where(F.col("place") <= F.greatest("upto", "upto_open")), "prefixes")

    def meet(x: DataFrame, y: DataFrame, rule: str) -> DataFrame:
        need = (F.col("x.nd") + F.col("y.nd") - r * (F.col("x.n") + F.col("y.n"))) / 2
        room = 1 + F.least(F.col("x.nd") - F.col("x.place"), F.col("y.nd") - F.col("y.place"))
        on = (F.col("x.pivot") == F.col("y.pivot")) & (F.col("x.tok") == F.col("y.tok")) & (room >= need - 1e-6) & F.expr(rule)
        return x.alias("x").join(y.alias("y"), on).select(F.col("x.id").alias("ix"), F.col("y.id").alias("iy"))

    pairs = meet(heads.where("linked and place <= upto"), heads.where("not linked and near and place <= upto"), "true")
    if last:
        both = heads.where("not linked and place <= upto_open")
        pairs = pairs.unionByName(meet(both, both, "x.mid < y.mid and x.component <> y.component"))
    whole = star.select("id", "mid", "n", "delta")
    pairs = pairs.distinct().join(whole.select(F.col("id").alias("ix"), F.col("mid").alias("a"), "n", "delta"), "ix")
    pairs = pairs.join(whole.select(F.col("id").alias("iy"), F.col("mid").alias("b"), F.col("n").alias("n_b"), F.col("delta").alias("delta_b")), "iy")
    apart = F.size("delta") + F.size("delta_b") - 2 * F.size(F.array_intersect("delta", "delta_b"))
    total = F.col("n") + F.col("n_b")
    found = materialise(pairs.where(100 * (total - apart) >= percent * (total + apart)).select("a", "b"), "links")
    for t in (star, heads, per, freq):
        release(t)
    return found


def token_sets(texts: DataFrame, k: int) -> DataFrame:
    """(mid, set) from (mid, text): the hashes of a text's distinct shingles."""

    def run(batches):
        for b in batches:
            for part in pieces(b, 1):
                h, count = shingles(part.column(1), k)
                at = np.cumsum(count) - count
                sets = [np.unique(h[a : a + c]).view(np.int64) for a, c in zip(at, count, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], ["mid", "set"])

    return texts.select("mid", "text").mapInArrow(run, "mid long, set array<long>")


def crossing_tokens(members: DataFrame, sets: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """(mid, tok): members in buckets such that any two of different components that are linked share one.

    ``members`` has their mid, ``sets`` whole sets (mid, set), ``groups`` components (mid, component) as far as they are
    known. Two linked sets of n and m tokens share ``percent`` of either at least. Tokens that one component alone has
    can't be among those; the rest is ordered by rarity among the members, and the rarest shared one lies where enough
    tokens follow it in both sets. A set with too few tokens of several components is linked with none of the others
    and has no row. So unlike texts with a passage in common meet neither there nor, mostly, at all.
    """
    own = members.distinct().join(groups, "mid", "left").withColumn("component", F.coalesce("component", "mid"))
    toks = sets.select("mid", "set").join(own, "mid").select("mid", "component", F.expr(f"(size(set) * {percent} + 99) div 100").alias("least"), F.explode("set").alias("tok"))
    toks = materialise(toks, "tokens")
    shared = toks.groupBy("tok").agg(F.count(F.lit(1)).alias("c"), (F.min("component") < F.max("component")).alias("crossing"))
    # a token of one component alone joins nothing, so the join makes no row for it
    toks_met = toks.join(shared.where("crossing").select("tok", "c").hint("merge"), "tok")
    mine = Window.partitionBy("mid")
    placed = toks_met.withColumn("known", F.count(F.lit(1)).over(mine)).where("known >= least").withColumn("place", F.row_number().over(mine.orderBy("c", "tok")))
    heads = materialise(placed.where("place <= known - least + 1").select("mid", "tok", "component"), "crossing")
    release(toks)
    several = heads.groupBy("tok").agg((F.min("component") < F.max("component")).alias("crossing")).where("crossing").select("tok")
    out = materialise(heads.join(several, "tok", "left_semi").select("mid", "tok"), "rare")
    release(heads)
    return out


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = 24, rows: int = 4, levels: int = 3, row_key: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Two documents are linked if their sets of k-word shingles have a Jaccard similarity of ``percent`` or more, as
    counted on the whole sets; component_id is the smallest id reachable by links. Candidates share a band of the
    signature: at similarity 0.8, 24 bands of 4 miss 3 pairs in a million.

    Documents with the same set are one member. A bucket's members are compared with one pivot, the member that shares
    most buckets with others, so work follows the members, not their pairs. Members linked with the pivot are one
    group; their links with others are found by ``delta_links``, and those not linked with a pivot go on to the next
    level with buckets of their own (``crossing_tokens``) and pivots of their own, at the last of which they are
    compared with each other too. No link between members of a bucket is lost.

    Null and empty texts, and texts of white space, have no shingles, are linked with nothing and are kept. A null id
    never becomes a component's name unless all its ids are null; rows that repeat an id and text share one verdict; an
    empty table gives an empty result; other columns are not read. ``row_key`` names a column of distinct values,
    which the result then has too; of a component only one row is then kept, by smallest id, nulls last, and smallest key.
    """
    sig = materialise(sketches(docs, k, bands, rows, row_key), "sketches")
    first = [F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")] if row_key else []
    classes = sig.where("key is not null").groupBy("key").agg(F.min("rk").alias("rk"), F.min("doc_id").alias("low"), *first, F.count(F.lit(1)).alias("rows"))
    classes = materialise(classes.withColumn("mid", F.monotonically_increasing_id()), "classes")
    one = sig.join(classes.select("key", "rk", "mid"), ["key", "rk"]).dropDuplicates(["mid"])
    spread = materialise(one.select("mid", F.explode("bands").alias("band")), "bands")

    edges: list[DataFrame] = []
    texts = rest = groups = None
    for level in range(levels):
        last = level == levels - 1 or (rest is not None and rest <= FEW_ROWS)
        counts = spread.groupBy("band").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
        counts = materialise(counts, "counts")
        met = materialise(join_sized(spread, counts, "band", "c"), "buckets")
        weight = met.groupBy("mid").agg(F.sum("c").alias("w"))
        tie = F.pmod(F.xxhash64("mid"), F.lit(1 << 20)) / (1 << 21)
        heads = met.join(weight, "mid").groupBy("band").agg(F.max_by("mid", F.col("w") + tie).alias("pivot"), F.first("c").alias("c"))
        heads = materialise(heads, "heads")
        met, buckets = materialise(join_sized(met.select("band", "mid"), heads, "band", "c").drop("c").where("mid <> pivot"), "met"), met
        release(counts)
        release(heads)
        pairs = materialise(met.groupBy("mid", "pivot").agg(F.count(F.lit(1)).alias("shared")), "pairs")
        release(spread)
        release(buckets)
        if texts is None:
            needed = pairs.select("mid").unionByName(pairs.select(F.col("pivot").alias("mid"))).distinct().join(classes.select("mid", "rk"), "mid")
            whole = docs.select(F.xxhash64("doc_id", "text").alias("rk"), F.col("text").cast("string").alias("text"))
            texts = materialise(whole.join(needed.hint("merge"), "rk").dropDuplicates(["mid"]).select("mid", "text"), "texts")
            sweep(docs.sparkSession)
        # a pivot's members are dealt into parts, each of which gets a copy of its text
        stars = pairs.groupBy("pivot").agg(F.count(F.lit(1)).alias("members"))
        stars = materialise(stars.withColumn("parts", F.ceil(F.col("members") / PART_MEMBERS).cast("int")), "stars")
        dealt = join_sized(pairs, stars, "pivot", "members").withColumn("part", F.pmod(F.xxhash64("mid"), F.col("parts")).cast("int"))
        own = dealt.groupBy("mid").agg(F.collect_list(F.struct("pivot", "part")).alias("pivots")).join(texts, "mid")  # as many as bands at most
        own = own.select("mid", "text", F.explode("pivots").alias("p")).select("mid", "text", "p.pivot", "p.part")
        heads = texts.join(stars, F.col("mid") == F.col("pivot")).select("pivot", F.col("text").alias("pivot_text"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        whole = own.join(heads, ["pivot", "part"])
        star = materialise(compare(whole, k, percent, last), "compared")
        release(pairs)
        sweep(docs.sparkSession)
        edges.append(materialise(star.where("linked").select(F.col("mid").alias("a"), F.col("pivot").alias("b")), "linked"))
        if star.where("not linked").limit(1).count() == 0:
            break
        edges.append(delta_links(star, percent, (groups or labels(_union(edges))) if last else None))
        if last:
            break
        apart = star.where("not linked").select("mid").distinct()
        sets = token_sets(texts.join(apart, "mid"), k)
        groups = labels(_union(edges))
        spread = crossing_tokens(apart, sets, groups, percent).withColumnRenamed("tok", "band")
        rest = spread.count()
        if rest == 0:
            break
        release(star)
        release(met)
        sweep(docs.sparkSession)
    named = components(_union(edges)).withColumnRenamed("node", "mid")
    classes = classes.join(named, "mid", "left").withColumn("component", F.coalesce("component", "mid"))
    lows = classes.groupBy("component").agg(F.min("low").alias("component_id"), *([F.min("first").alias("best")] if row_key else []))
    best = [F.col("best.row").alias("best")] if row_key else []
    classes = materialise(classes.join(lows, "component").select("key", "component_id", *best, "rows"), "named")
    own = ["row"] if row_key else []
    kept = (F.col("row") == F.col("best")) if row_key else F.col("doc_id").eqNullSafe(F.col("component_id"))
    found = join_groups(sig.where("key is not null").select("doc_id", "n", "key", *own), classes, "key", "rows").select("doc_id", "n", "component_id", kept.alias("kept"), *own)
    alone = sig.where("key is null").select("doc_id", "n", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"), *own)
    out = found.unionByName(alone)
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", "kept", *([F.col("row").alias(row_key)] if row_key else []))
