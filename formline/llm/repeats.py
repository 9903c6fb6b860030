"""Removal of long repeated strings: anchored runs, suffix order and longest-previous-factor arrays."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from formline.llm.arrow_words import pieces
from formline.llm.common import join_groups, materialise, release, ship

ship(__name__)

#: Bytes of the strings whose hashes are compared to find a window's anchor.
GRAM = 48
#: Bytes of text that a worker treats at once.
CHUNK = 1_000_000
#: Bytes of distinct runs that one suffix order takes; an anchor with more is split by its windows' hashes.
BUCKET_BYTES = 1_000_000
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)


def anchored_runs(data: bytes, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First start, last start and anchor hash of each run of windows of ``length`` bytes.

    ``data`` joins texts that end at ``ends``; windows lie inside one text. A window's anchor is the string of ``GRAM``
    bytes in it with the smallest hash, the leftmost of equals, so equal windows have equal anchors at equal places,
    and neighbouring windows mostly share theirs. A run is a stretch of starts with one anchor.
    """
    b = np.frombuffer(data, np.uint8).astype(np.uint64)
    n = len(b)
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if n < length:
        return none
    power = np.full(n, _BASE, np.uint64)
    power[0] = 1
    power = np.multiply.accumulate(power)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((b + np.uint64(1)) * power, out=total[1:])
    back = np.full(n - GRAM + 1, _INVERSE, np.uint64)
    back[0] = 1
    h = (total[GRAM:] - total[: n - GRAM + 1]) * np.multiply.accumulate(back)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    span = length - GRAM + 1
    value = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    pad = -len(value) % span
    grid = np.r_[value, np.full(pad, 2**64 - 1, np.uint64)].reshape(-1, span)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = n - length + 1
    place = (np.minimum(behind[:starts], ahead[span - 1 : span - 1 + starts]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    text = np.searchsorted(ends, np.arange(starts), side="right")
    inside = np.arange(starts) + length <= ends[text]
    fresh = np.r_[True, (place[1:] != place[:-1]) | (text[1:] != text[:-1])] | np.r_[True, ~inside[:-1]]
    first = np.flatnonzero(fresh & inside)
    stop = np.flatnonzero(inside & np.r_[fresh[1:] | ~inside[1:], True])
    return first, stop, h[place[first]].view(np.int64)


def suffix_order(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The starts in suffix order, and how many bytes each shares with the start before it, ``length`` at most.

    Suffixes are compared on ``length`` bytes, equals stand by position. Built by doubling: a suffix's rank is the
    number of suffixes below its class, a round refines the classes of 5, 10, 20, ... bytes by the rank that many bytes
    on, and suffixes that are alone in their class take no further part. Each round's ranks are kept, for from them
    the shared lengths follow by binary descent.
    """
    n = len(data)
    bits = max(1, n.bit_length())
    wide = np.r_[data, np.zeros(5, np.uint8)].astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for j in range(min(5, length)):
        key = (key << np.uint64(8)) | wide[j : n + j]
    rank = np.zeros(n, np.int64)
    active, have, levels = np.arange(n), min(5, length), []
    low = np.zeros(n, np.int64)
    while True:
        active, at, low = _refine(key, active, low, bits)
        rank[active] = at
        levels.append((have, rank.astype(np.int32)))
        if have >= length:
            break
        alone = np.bincount(at, minlength=n)[at] == 1
        active, low = active[~alone], at[~alone]
        step = min(have, length - have)
        on = active + step
        second = np.where(on < n, rank[np.minimum(on, n - 1)] + 1, 0)
        key = second.astype(np.uint64)
        have += step
    of = rank[starts]
    order = starts[np.argsort(of, kind="stable")]
    shared = np.zeros(len(order), np.int64)
    if len(order) > 1:
        x, y = order[:-1].copy(), order[1:].copy()
        for have, ranks in reversed(levels):
            same = np.flatnonzero((ranks[np.minimum(x, n - 1)] == ranks[np.minimum(y, n - 1)]) & (x < n) & (y < n))
            shared[1 + same] += have
            x[same] += have
            y[same] += have
        for _ in range(levels[0][0] - 1):
            same = np.flatnonzero((x < n) & (y < n) & (wide[np.minimum(x, n)] == wide[np.minimum(y, n)]))
            same = same[shared[1 + same] == y[same] - order[1:][same]]
            shared[1 + same] += 1
            x[same] += 1
            y[same] += 1
    return order, np.minimum(shared, length)


def _refine(key: np.ndarray, active: np.ndarray, low: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``active`` sorted by (low, key, place), the rank of each, and low in that order."""
    wide = max(1, int(key.max()).bit_length()) if len(key) else 1
    lows = max(1, int(low.max()).bit_length()) if len(low) else 1
    if bits + wide + lows <= 64:
        packed = np.sort((low.astype(np.uint64) << np.uint64(bits + wide)) | (key << np.uint64(bits)) | active.astype(np.uint64))
        active = (packed & np.uint64((1 << bits) - 1)).astype(np.int64)
        packed >>= np.uint64(bits)
        low = (packed >> np.uint64(wide)).astype(np.int64)
        fresh = np.r_[True, packed[1:] != packed[:-1]] if len(packed) else np.zeros(0, bool)
    else:
        order = np.lexsort((active, key, low))
        active, key, low = active[order], key[order], low[order]
        fresh = np.r_[True, (key[1:] != key[:-1]) | (low[1:] != low[:-1])] if len(key) else np.zeros(0, bool)
    place = np.arange(len(active))
    begin = np.r_[True, low[1:] != low[:-1]] if len(low) else np.zeros(0, bool)
    inside = place - np.maximum.accumulate(np.where(begin, place, 0))
    return active, low + np.maximum.accumulate(np.where(fresh, place, 0)) - place + inside, low


def nearest_smaller(order: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place in suffix order the nearest place before it whose position is smaller (-1: none), and the bytes shared with it.

    Pointer jumping: a candidate with a greater position is left for that candidate's own one, all at once.
    """
    found = np.arange(-1, len(order) - 1)
    least = shared.copy()
    open_ = np.flatnonzero((found >= 0) & (order[found] > order)) if len(order) else np.zeros(0, np.int64)
    while len(open_):
        via = found[open_]
        least[open_], found[open_] = np.minimum(least[open_], least[via]), found[via]
        open_ = open_[(found[open_] >= 0) & (order[found[open_]] > order[open_])]
    least[found < 0] = 0
    return found, least


def longest_previous(order: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """Longest previous factors, in suffix order: the bytes that the text at a start shares with that at a smaller position.

    Of all smaller positions the nearest before and the nearest after in suffix order share most.
    """
    _, before = nearest_smaller(order, shared)
    _, after = nearest_smaller(order[::-1], np.r_[0, shared[:0:-1]] if len(shared) else shared)
    return np.maximum(before, after[::-1])


def stretches(on: np.ndarray) -> list[tuple[int, int]]:
    edge = np.diff(np.r_[0, on.astype(np.int8), 0])
    return list(zip(np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) - 1).tolist(), strict=True))


SPANS = "array<struct<a:int,b:int>>"


def match_bucket(rows, length: int, keep_first: bool):
    """Matched starts of the runs of one bucket, as (anchor, digest, spans); each run's text occurs in it once.

    Windows that differ in anchor differ in content, so runs of several anchors may share one suffix order.
    """
    rows = rows.sort_values(["id", "th", "s"], kind="stable").reset_index(drop=True)
    data = np.frombuffer(b"".join(rows.run), np.uint8)
    size = rows.run.str.len().to_numpy()
    base = np.cumsum(size) - size
    valid = size - length + 1
    starts = np.repeat(base - (np.cumsum(valid) - valid), valid) + np.arange(valid.sum())
    order, shared = suffix_order(data, starts, length)
    hit = np.zeros(len(data), bool)
    hit[order[longest_previous(order, shared) >= length]] = True
    if not keep_first:
        hit[order[longest_previous(-order, shared) >= length]] = True  # the same from the text's end: longest next factors
    return [[{"a": a, "b": b} for a, b in stretches(hit[o : o + v])] for o, v in zip(base, valid, strict=True)], rows


def remove_repeats(docs: DataFrame, length: int = 400, keep_first: bool = True, step_bytes: int = CHUNK) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_text, kept_sha256.

    A byte goes if it lies in a string of ``length`` bytes (at least ``GRAM``) that starts elsewhere too, in the same or
    another document; overlaps count, and strings are judged on the input. With ``keep_first`` the first of equal
    strings (by id, then place) stays. Texts are UTF-8 bytes, so kept bytes need not be whole characters.

    1. Each document is cut into runs of windows with one anchor; a run's row has a digest, not its text.
    2. Runs of an anchor that occurs once are done. Runs with equal digests are one run with a count.
    3. Distinct runs of one anchor are fetched, dealt into buckets by anchor and matched in suffix order by longest
       previous factors. An anchor with too many distinct runs for a task is split by window hashes instead.
    4. The matches go back to all runs, are joined per document and cut out.

    Null texts are empty; texts shorter than ``length`` keep all. Rows that repeat an id and text count as repeats of
    each other, and with ``keep_first`` as one; null ids are one id; an empty table gives an empty result; other columns
    are not read.
    """
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("id"), F.xxhash64(F.col("doc_id").isNull(), "text").alias("th"), F.col("text").cast("string").alias("text"))

    def cut(batches):
        import xxhash

        for b in batches:
            for part in pieces(b, 2, step_bytes):
                ids, ths = part.column(0).to_pylist(), part.column(1).to_pylist()
                texts = [(t or "").encode("utf-8") for t in part.column(2).to_pylist()]
                units = [(i, at, t[at : at + step_bytes + length - 1]) for i, t in enumerate(texts) for at in range(0, max(0, len(t) - length + 1), step_bytes)]
                at = 0
                while at < len(units):
                    n, upto = 0, at
                    while upto < len(units) and (upto == at or n + len(units[upto][2]) <= step_bytes):
                        n += len(units[upto][2])
                        upto += 1
                    data = b"".join(u[2] for u in units[at:upto])
                    ends = np.cumsum([len(u[2]) for u in units[at:upto]])
                    first, last, anchor = anchored_runs(data, ends, length)
                    unit = np.searchsorted(ends, first, side="right")
                    shift = np.array([u[1] for u in units[at:upto]]) - np.r_[0, ends[:-1]]
                    owner = np.array([u[0] for u in units[at:upto]])[unit]
                    digest = [xxhash.xxh3_128_digest(data[s : e + length]) for s, e in zip(first.tolist(), last.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([ids[i] for i in owner], pa.int64()), pa.array([ths[i] for i in owner], pa.int64()), pa.array(first + shift[unit], pa.int32()),
                         pa.array(last + shift[unit], pa.int32()), pa.array(anchor), pa.array(digest, pa.binary())],
                        ["id", "th", "s", "e", "anchor", "dig"],
                    )
                    at = upto

    runs = materialise(rows.select("id", "th", "text").mapInArrow(cut, "id long, th long, s int, e int, anchor long, dig binary"), "runs")
    often = materialise(runs.groupBy("anchor").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "often")
    met = materialise(join_groups(runs, often, "anchor", "c").drop("c"), "met")
    release(runs)
    release(often)
    groups = met.groupBy("anchor", "dig").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "th", "s", "e")).alias("one"))
    groups = materialise(groups.select("anchor", "dig", "n", "one.*"), "groups")
    kinds = groups.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.sum(F.col("e") - F.col("s") + length).alias("bytes")).where("kinds > 1")
    some = join_groups(groups, materialise(kinds, "kinds"), "anchor", "kinds")
    # the text of one occurrence of each distinct run
    wanted = some.groupBy("id", "th").agg(F.collect_list(F.struct("anchor", "dig", "s", "e", "bytes")).alias("runs"))  # at most the runs of one text

    def fetch(batches):
        for b in batches:
            for part in pieces(b, 2, step_bytes):
                out = {k: [] for k in ("id", "th", "anchor", "dig", "s", "bytes", "run")}
                for i, th, t, rs in zip(*(part.column(c).to_pylist() for c in range(4)), strict=True):
                    t = t.encode("utf-8")
                    for r in rs:
                        for k, v in (("id", i), ("th", th), ("anchor", r["anchor"]), ("dig", r["dig"]), ("s", r["s"]), ("bytes", r["bytes"]), ("run", t[r["s"] : r["e"] + length])):
                            out[k].append(v)
                yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("id", pa.int64()), ("th", pa.int64()), ("anchor", pa.int64()), ("dig", pa.binary()), ("s", pa.int32()), ("bytes", pa.int64()), ("run", pa.binary())]))

    texts = rows.select("id", "th", "text").join(wanted, ["id", "th"])
    distinct = texts.mapInArrow(fetch, "id long, th long, anchor long, dig binary, s int, bytes long, run binary")
    distinct = materialise(distinct.dropDuplicates(["anchor", "dig"]), "distinct")
    total = distinct.agg(F.sum(F.length("run"))).first()[0] or 0
    n_buckets = int(total // BUCKET_BYTES) + 1

    def bucket(pdf):
        spans, pdf = match_bucket(pdf, length, keep_first)
        return pdf[["anchor", "dig"]].assign(spans=spans)

    near = distinct.where(F.col("bytes") <= 4 * BUCKET_BYTES).withColumn("bucket", F.pmod(F.xxhash64("anchor"), F.lit(n_buckets)))
    found = near.groupBy("bucket").applyInPandas(bucket, f"anchor long, dig binary, spans {SPANS}")
    far = distinct.where(F.col("bytes") > 4 * BUCKET_BYTES)
    found = found.unionByName(_match_far(far, length, keep_first)) if far.limit(1).count() else found
    found = materialise(found, "found")

    named = groups.join(found, ["anchor", "dig"], "left").select("anchor", "dig", "n", F.struct("id", "th", "s").alias("one"), "spans")
    hits = join_groups(met, named, ["anchor", "dig"], "n")
    whole = F.array(F.struct(F.lit(0).alias("a"), (F.col("e") - F.col("s")).alias("b")))
    own = F.struct("id", "th", "s").eqNullSafe(F.col("one")) if keep_first else F.lit(False)
    spans = F.when((F.col("n") > 1) & ~own, whole).otherwise(F.col("spans"))
    hits = hits.select("id", "th", "s", F.explode(spans).alias("x")).select("id", "th", (F.col("s") + F.col("x.a")).alias("a"), (F.col("s") + F.col("x.b") + length).alias("b"))
    # touching stretches are joined before they are gathered per text
    order = Window.partitionBy("id", "th").orderBy("a", "b")
    hits = hits.groupBy("id", "th", "a").agg(F.max("b").alias("b"))
    reach = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    hits = hits.withColumn("new", F.when(reach >= F.col("a"), 0).otherwise(1)).withColumn("no", F.sum("new").over(order))
    hits = hits.groupBy("id", "th", "no").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    gone = materialise(hits.groupBy("id", "th").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("gone")), "gone")
    for t in (met, distinct):
        release(t)

    def finish(batches):
        for b in batches:
            for part in pieces(b, 1, step_bytes):
                out = {k: [] for k in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_text", "kept_sha256")}
                for i, t, spans in zip(*(part.column(c).to_pylist() for c in range(3)), strict=True):
                    t = (t or "").encode("utf-8")
                    rest, at, removed = [], 0, 0
                    for x in spans or ():
                        rest.append(t[at : x["a"]])
                        removed += x["b"] - x["a"]
                        at = x["b"]
                    kept = b"".join([*rest, t[at:]])
                    for k, v in (("doc_id", i), ("n_bytes", len(t)), ("n_removed", removed), ("n_spans", len(spans or ())), ("kept_text", kept), ("kept_sha256", hashlib.sha256(kept).hexdigest())):
                        out[k].append(v)
                yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_text", pa.binary()), ("kept_sha256", pa.string())]))

    full = rows.join(gone, ["id", "th"], "left").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "gone")
    return full.mapInArrow(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_text binary, kept_sha256 string")


def _match_far(distinct: DataFrame, length: int, keep_first: bool) -> DataFrame:
    """Matches of anchors with very many distinct runs: each window's digest is a row, counted after partial sums."""

    def spread(batches):
        import xxhash

        for b in batches:
            for r in range(b.num_rows):
                i, th, anchor, dig, s, run = (b.column(c)[r].as_py() for c in range(6))
                n = len(run) - length + 1
                win = [xxhash.xxh3_128_digest(run[j : j + length]) for j in range(n)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i] * n, pa.int64()), pa.array([th] * n, pa.int64()), pa.array([anchor] * n, pa.int64()), pa.array([dig] * n, pa.binary()), pa.array([s] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(win, pa.binary())],
                    ["id", "th", "anchor", "dig", "s", "off", "win"],
                )

    wins = distinct.select("id", "th", "anchor", "dig", "s", "run").mapInArrow(spread, "id long, th long, anchor long, dig binary, s int, off int, win binary")
    wins = materialise(wins, "windows")
    per = wins.groupBy("anchor", "win").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "th", "s", "off")).alias("first")).where("n > 1")
    hit = join_groups(wins, per, ["anchor", "win"], "n")
    if keep_first:
        hit = hit.where(~F.struct("id", "th", "s", "off").eqNullSafe(F.col("first")))
    return hit.groupBy("anchor", "dig").agg(F.sort_array(F.collect_list(F.struct(F.col("off").alias("a"), F.col("off").alias("b")))).alias("spans"))
