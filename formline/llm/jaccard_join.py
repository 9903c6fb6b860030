"""N-gram Jaccard join by prefixes under several global token orders, and the groups that its links make."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formline.llm.arrow_words import pieces
from formline.llm.common import components, join_groups, join_sized, labels, materialise, release, ship, sweep
from formline.llm.minhash import FEW_ROWS, crossing_tokens, delta_links, mix, shingles

ship(__name__)

#: What tells the global orders of tokens apart; a token's place in one is its mixed hash.
ORDERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
#: Per cent of a set that the first order's prefix is longer than it must be, so that its commonest tokens may be left out.
EXTRA = 20
#: Members of a pivot that meet one copy of its set.
PART_MEMBERS = 200


def least_shared(n, percent: int):
    """Fewest tokens that a set of n shares with one it is linked with."""
    return -(-n * percent // 100)


def spare(n, percent: int):
    """Tokens of a set of n that its first prefix has beyond those that it must have."""
    few, more = least_shared(n, percent) - 1, n * EXTRA // 100
    return np.minimum(few, more) if isinstance(n, np.ndarray) else min(few, more)


def _row_mark(docs: DataFrame) -> Column:
    """16 bytes that rows with the same id and text share."""
    return F.unhex(F.md5(F.concat_ws("#", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit("")))))


def prefixes(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(doc_id, rk, n, key, head, keep): key digests a text's set of n shingles, head is its prefix under the first order.

    ``head`` has ``spare`` tokens more than it must, so that two linked sets share that many more tokens in their heads,
    and of a head's tokens only the ``keep`` rarest need be met: the rarest shared one is among them on both sides.
    """

    def run(batches):
        import xxhash

        for b in batches:
            for part in pieces(b, 2):
                h, count = shingles(part.column(2), k)
                at = np.cumsum(count) - count
                sets = [np.unique(h[a : a + c]) for a, c in zip(at, count, strict=True)]
                n = np.array([len(s) for s in sets], np.int64)
                must = n - least_shared(n, percent) + 1
                heads = [np.sort(mix(s ^ np.uint64(ORDERS[0])))[: m + e].view(np.int64) for s, m, e in zip(sets, must, spare(n, percent), strict=True)]
                keep = must + spare(n, percent) - spare(least_shared(n, percent), percent)
                keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(n), pa.array(keys, pa.binary()), pa.array(heads, pa.list_(pa.int64())), pa.array(keep)],
                    ["doc_id", "rk", "n", "key", "head", "keep"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _row_mark(docs).alias("rk"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, rk binary, n long, key binary, head array<long>, keep long")


def whole_sets(texts: DataFrame, k: int, near: int) -> DataFrame:
    """(mid, set, second, third) from (mid, text): all hashes, and the prefixes for ``near`` per cent under the other two orders."""

    def run(batches):
        for b in batches:
            for part in pieces(b, 1):
                h, count = shingles(part.column(1), k)
                at = np.cumsum(count) - count
                sets = [np.unique(h[a : a + c]) for a, c in zip(at, count, strict=True)]
                cut = [len(s) - least_shared(len(s), near) + 1 for s in sets]
                others = [[np.sort(mix(s ^ np.uint64(o)))[:c].view(np.int64) for s, c in zip(sets, cut, strict=True)] for o in ORDERS[1:]]
                kind = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.view(np.int64) for s in sets], kind), *(pa.array(o, kind) for o in others)], ["mid", "set", "second", "third"])

    return texts.select("mid", "text").mapInArrow(run, "mid long, set array<long>, second array<long>, third array<long>")


def rare_tokens(members: DataFrame) -> DataFrame:
    """(mid, tok) to meet by, from members (mid, head, keep): the rarest tokens of each head that other heads have too.

    Tokens of one head alone are the rarest and meet nothing, so they use up ``keep`` first.
    """
    spread = members.select("mid", F.explode("head").alias("tok"), (F.col("keep") - F.size("head")).alias("over"))
    counts = materialise(spread.groupBy("tok").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "counts")
    common = join_sized(spread, counts, "tok", "c")
    mine = Window.partitionBy("mid")
    # over + common tokens = keep - tokens of this head alone
    common = common.withColumn("known", F.count(F.lit(1)).over(mine)).withColumn("place", F.row_number().over(mine.orderBy("c", "tok")))
    out = materialise(common.where("place <= over + known").select("mid", "tok"), "rare")
    release(counts)
    return out


def against_pivots(pairs: DataFrame, sets: DataFrame, percent: int, far: bool) -> DataFrame:
    """(mid, pivot, n, n_pivot, linked, near, delta) of (mid, pivot): filtered by the other orders, then compared whole.

    A pair at least at twice the linking distance shares a token of its second and of its third prefix; others are
    neither linked nor near. delta is the symmetric difference, left out of pairs that aren't near unless ``far``.
    A pivot's members are dealt into parts, each of which gets a copy of its set.
    """
    stars = materialise(pairs.groupBy("pivot").agg(F.count(F.lit(1)).alias("members")).withColumn("parts", F.ceil(F.col("members") / PART_MEMBERS).cast("int")), "stars")
    dealt = join_sized(pairs, stars, "pivot", "members").select("mid", "pivot", F.pmod(F.xxhash64("mid"), F.col("parts")).cast("int").alias("part"))
    heads = sets.join(stars, F.col("mid") == F.col("pivot")).select("pivot", *(F.col(c).alias(f"{c}_pivot") for c in ("set", "second", "third")), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    heavy = dealt.groupBy("mid").agg(F.count(F.lit(1)).alias("met"))
    own = join_sized(dealt, heavy, "mid", "met").drop("met").join(sets, "mid")
    both = own.join(heads, ["pivot", "part"])
    n, m = F.size("set").cast("long"), F.size("set_pivot").cast("long")
    low = 2 * percent - 100
    share = F.arrays_overlap("second", "second_pivot") & F.arrays_overlap("third", "third_pivot") & (100 * F.least(n, m) >= low * F.greatest(n, m))
    both = both.select("mid", "pivot", n.alias("n"), m.alias("n_pivot"), "set", "set_pivot", share.alias("share"))
    both = both.withColumn("same", F.when(F.col("share"), F.size(F.array_intersect("set", "set_pivot")).cast("long")).otherwise(F.lit(0).cast("long")))

    def at_least(p: int) -> Column:
        return F.col("share") & (100 * F.col("same") >= p * (F.col("n") + F.col("n_pivot") - F.col("same")))

    both = both.withColumn("linked", at_least(percent)).withColumn("near", at_least(low))
    delta = F.concat(F.array_except("set", "set_pivot"), F.array_except("set_pivot", "set"))
    out = materialise(both.select("mid", "pivot", "n", "n_pivot", "linked", "near", (delta if far else F.when(F.col("near"), delta)).alias("delta")), "compared")
    release(stars)
    return out


def _with_components(star: DataFrame, groups: DataFrame) -> DataFrame:
    """``star`` with its members' and pivots' components as far as they are known; a member without links is one of its own."""
    own = join_sized(star, star.groupBy("mid").agg(F.count(F.lit(1)).alias("_met")).join(groups, "mid", "left"), "mid", "_met")
    heads = star.groupBy("pivot").agg(F.count(F.lit(1)).alias("_met")).join(groups.withColumnRenamed("mid", "pivot").withColumnRenamed("component", "pivot_component"), "pivot", "left")
    both = join_sized(own.drop("_met"), heads, "pivot", "_met").drop("_met")
    return both.withColumn("component", F.coalesce("component", "mid")).withColumn("pivot_component", F.coalesce("pivot_component", "pivot"))


def jaccard_groups(docs: DataFrame, k: int = 5, percent: int = 80, levels: int = 3) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, of an exact join at ``percent`` (above 50) on sets of k-word shingles.

    Two documents are linked if their sets have a Jaccard similarity of ``percent`` or more; component_id is the
    smallest id reachable by links. Candidates must share a token in their prefixes under each of three global orders:
    the first, by rarity among the leading tokens of a hash order, makes buckets, the other two, hash orders of their
    own, filter a bucket's pairs, and whole sets confirm what is left. No link is lost to a filter.

    Documents with the same set are one member. A bucket's members are compared with one pivot; those linked with it
    are one group, whose links with members of other components are found from differences to the pivot
    (``delta_links``); those not linked with a pivot go on to the next level in buckets of their own, by the rarest
    tokens of their whole sets that members of several components share (``crossing_tokens``); at the last level they
    are compared with each other. So work follows members, not pairs.

    Null and empty texts, and texts of white space, have no shingles and are linked with nothing: their component is
    their own id. A null id never becomes a component's name unless all its ids are null; rows that repeat an id and
    text share one verdict; an empty table gives an empty result; other columns are not read.
    """
    sig = materialise(prefixes(docs, k, percent), "prefixes")
    classes = sig.where("key is not null").groupBy("key").agg(F.min("rk").alias("rk"), F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("rows"))
    classes = materialise(classes.withColumn("mid", F.monotonically_increasing_id()), "classes")
    one = sig.join(classes.select("key", "rk", "mid"), ["key", "rk"]).select("mid", "head", "keep").dropDuplicates(["mid"])
    spread = rare_tokens(one)

    edges: list[DataFrame] = []
    sets = rest = groups = None
    for level in range(levels):
        last = level == levels - 1 or (rest is not None and rest <= FEW_ROWS)
        counts = materialise(spread.groupBy("tok").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "counts")
        met = materialise(join_sized(spread, counts, "tok", "c"), "buckets")
        weight = met.groupBy("mid").agg(F.sum("c").alias("w"))
        tie = F.pmod(F.xxhash64("mid"), F.lit(1 << 20)) / (1 << 21)
        heads = met.join(weight, "mid").groupBy("tok").agg(F.max_by("mid", F.col("w") + tie).alias("pivot"), F.first("c").alias("c"))
        heads = materialise(heads, "heads")
        met, buckets = materialise(join_sized(met.select("tok", "mid"), heads, "tok", "c").drop("c").where("mid <> pivot"), "met"), met
        pairs = materialise(met.select("mid", "pivot").distinct(), "pairs")
        for t in (spread, buckets, counts, heads):
            release(t)
        if sets is None:
            needed = pairs.select("mid").unionByName(pairs.select(F.col("pivot").alias("mid"))).distinct().join(classes.select("mid", "rk"), "mid")
            whole = docs.select(_row_mark(docs).alias("rk"), F.col("text").cast("string").alias("text"))
            texts = whole.join(needed.hint("merge"), "rk").dropDuplicates(["mid"])
            sets = materialise(whole_sets(texts, k, 2 * percent - 100), "sets")
            sweep(docs.sparkSession)
        star = against_pivots(pairs, sets, percent, last)
        release(pairs)
        edges.append(materialise(star.where("linked").select(F.col("mid").alias("a"), F.col("pivot").alias("b")), "linked"))
        if star.where("not linked").limit(1).count() == 0:
            break
        groups = groups or labels(_all(edges))
        compared, star = star, materialise(_with_components(star, groups), "placed")
        release(compared)
        # all of a pivot's linked members are of its component: only near ones of others can add a link to them
        elsewhere = star.where("component <> pivot_component" + ("" if last else " AND near")).select("pivot").distinct()
        open_stars = materialise(star.join(elsewhere, "pivot", "left_semi").drop("component", "pivot_component"), "open")
        edges.append(delta_links(open_stars, percent, groups if last else None))
        release(open_stars)
        if last:
            break
        # what isn't linked with a pivot goes on, by tokens that it shares with other components of such members
        groups = labels(_all(edges))
        spread = crossing_tokens(star.where("not linked").select("mid"), sets, groups, percent)
        rest = spread.count()
        if rest == 0:
            break
        release(star)
        release(met)
        sweep(docs.sparkSession)
    named = components(_all(edges)).withColumnRenamed("node", "mid")
    classes = classes.join(named, "mid", "left").withColumn("component", F.coalesce("component", "mid"))
    lows = classes.groupBy("component").agg(F.min("low").alias("component_id"))
    classes = materialise(classes.join(lows, "component").select("key", "component_id", "rows"), "named")
    found = join_groups(sig.where("key is not null").select("doc_id", "n", "key"), classes, "key", "rows").select("doc_id", "n", "component_id")
    alone = sig.where("key is null").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return found.unionByName(alone).withColumnRenamed("n", "n_shingles")


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
