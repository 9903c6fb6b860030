"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formline.llm.common import join_groups, materialise, running_totals

#: Rows that one task orders at once; groups are cut into as many hash or time ranges as that takes.
RANGE_ROWS = 2_000
#: Cells of equal width into which a range of finish times is cut.
CELLS = 4_096


def word_count(text: Column) -> Column:
    """Number of runs of anything but ASCII white space; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, repeats: int) -> DataFrame:
    """(source, source_size, source_rows, target) from (source, size).

    Sources in code-point order, null last, take the weights in turn and split ``share`` of all sizes; a target stops
    at ``repeats`` times its source's size and the excess is shared by weight among the rest. In closed form: sources
    fill up in order of capacity by weight, and the first level that no remaining source reaches is everybody's.
    All windows here run over one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
    turn = F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights)))
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn.cast("int") + 1).cast("double"))
    per = per.withColumn("cap", (F.col("source_size") * repeats).cast("double"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, onward = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    per = per.withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(share)))
    level = (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    per = per.withColumn("level", level)
    per = per.withColumn("level", F.max(F.when(F.col("cap") / F.col("weight") >= F.col("level"), F.col("level"))).over(everything))
    target = F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))
    return per.select("source", "source_size", "source_rows", target.alias("target"))


def fair_queue(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, repeats: int = 2, seed: int = 0) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, cum, taken.

    The documents of a source stand in a shuffled order (by a hash of seed and id); its queue is that order, repeated.
    An entry's virtual finish time is the source's words up to and with it, divided by the source's target. All
    entries are then ranged by finish time and the mix stops before the entry that would exceed the total of the
    targets. ``taken`` counts the words of a document's entries in the mix, 0 to ``repeats`` times its size.

    Running sums never put a source or the whole queue into one task: hash ranges of a source, and ranges of finish
    time, are summed first, in two levels, and only the rows of one range are ordered together. Null texts have size 0 and take
    nothing; a null id hashes as the empty string; repeated rows are entries of their own and, as they tie, may stand
    either way; an empty table gives an empty result. Other columns of ``docs`` are not read.
    """
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = materialise(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), digest.alias("draw")), "mix")
    targets = materialise(source_targets(rows, weights, share, repeats), "targets").withColumnRenamed("source", "t_source")
    ranges = F.ceil(F.col("source_rows") / RANGE_ROWS)
    draw = F.conv(F.substring("draw", 1, 8), 16, 10).cast("long")
    # a null source has a key of its own, so that hot sources can be told by plain equality
    named = F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), F.col("source").cast("string")))
    keys = targets.select(F.when(F.col("t_source").isNull(), "").otherwise(F.concat(F.lit("="), F.col("t_source").cast("string"))).alias("_key"), "source_size", "source_rows", "target")
    rows = join_groups(rows.withColumn("_key", named), keys, "_key", "source_rows")
    rows = rows.select("doc_id", "source", "size", "draw", "source_size", "target", F.shiftright(draw * ranges, 32).alias("range"))
    sums = running_totals(rows.groupBy("source", "range").agg(F.sum("size").alias("range_size")), ["source"], "range", "range_size")
    sums = sums.select(F.col("source").alias("s"), F.col("range").alias("r"), "ahead")
    inside = Window.partitionBy("source", "range").orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    queue = rows.withColumn("cum", F.sum("size").over(inside)).join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r")))
    queue = materialise(queue.select("doc_id", "source", "size", "source_size", "target", "draw", (F.col("cum") + F.col("ahead")).alias("cum")), "queue")
    times = [(F.col("source_size") * k + F.col("cum")) / F.col("target") for k in range(repeats)]
    last = _cutoff(queue, times)
    if last is None:
        return queue.select("doc_id", "source", "size", "source_size", "target", "cum", F.lit(0).cast("long").alias("taken"))
    stop = F.struct(*(F.lit(x).cast(t) for x, t in zip(last, ("double", "string", "long", "long"), strict=True)))
    held = [F.when(F.col("size").__gt__(0) & (_rank(t) <= stop), F.col("size")).otherwise(0) for t in times]
    return queue.select("doc_id", "source", "size", "source_size", "target", "cum", sum(held[1:], held[0]).cast("long").alias("taken"))


def _rank(time: Column) -> Column:
    """The total order of the queue: finish time, then the document's draw, id and size."""
    return F.struct(time.alias("time"), F.col("draw").alias("draw"), F.coalesce("doc_id", F.lit(-1)).cast("long").alias("id"), F.col("size").alias("n"))


def _cutoff(queue: DataFrame, times: list[Column]):
    """The rank of the last entry of the mix; null if the mix is empty.

    A range of finish times is cut into ``CELLS`` equal cells, whose sums show the one in which the total budget is
    used up; that cell is cut again, and so on until it holds few entries, which are then ordered one by one. Each
    round narrows the range ``CELLS`` times, so that its number follows the logarithm of the entries, and entries of
    exactly one time are at most one for each source and repeat.
    """
    entries = queue.where("size > 0 and target > 0").select("size", F.explode(F.array(*map(_rank, times))).alias("rank"))
    budget = queue.select("source", "target").distinct().agg(F.sum("target")).first()[0]
    n, low, high = entries.agg(F.count(F.lit(1)), F.min("rank.time"), F.max("rank.time")).first()
    if not n:
        return None
    spent = 0
    while n > RANGE_ROWS and high > low:
        inside = entries.where(F.col("rank.time").between(low, high))
        cell = F.least(F.floor((F.col("rank.time") - low) / (high - low) * CELLS), F.lit(CELLS - 1)).cast("int")
        cells = inside.groupBy(cell.alias("cell")).agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"), F.min("rank.time").alias("low"), F.max("rank.time").alias("high"))
        upto = F.sum("words").over(Window.orderBy("cell"))  # over CELLS rows at most
        found = cells.withColumn("upto", upto).where(F.col("upto") + spent > budget).orderBy("cell").first()
        if found is None:
            return entries.agg(F.max("rank")).first()[0]
        n, low, high, spent = found["n"], found["low"], found["high"], spent + found["upto"] - found["words"]
    at = entries.where(F.col("rank.time").between(low, high))
    upto = F.sum("size").over(Window.partitionBy(F.lit(0)).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    last = at.withColumn("upto", upto).where(F.col("upto") + spent <= budget).agg(F.max("rank")).first()[0]
    return last if last is not None else entries.where(F.col("rank.time") < low).agg(F.max("rank")).first()[0]
