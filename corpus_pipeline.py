"""A corpus pipeline: five stages over ``documents``, each on all that its predecessor kept.

Every stage takes documents as they are written: ids and texts may be null or repeated, whole rows may repeat, further
columns are carried along, and an empty table gives an empty result. Verdicts hold for rows, not ids: a stage tells
rows apart by the file they stand in and their place there, or, where ``docs`` come from no file, writes them first.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formline.llm import decontaminate, exact_dedup, minhash, mixing, toxicity
from formline.llm.common import materialise, release

#: Name of the column that tells rows apart inside a stage; no result has it.
ROW = "_fl_row"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from ``labels``, doesn't reject; null and empty texts stay."""
    net = toxicity.fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score_toxicity(docs, net, docs.columns).where("_fl_score < 0.5 or trim(coalesce(text, '')) = ''").select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, null and empty ones equal too, the row with the smallest id, nulls last, and of rows with that id one."""
    docs = _keyed(docs)
    kept = exact_dedup.exact_groups(docs, row_key=ROW).where("kept").groupBy("text_sha256").agg(F.min(ROW).alias(ROW))
    return _only(docs, kept)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, five words and a similarity of 0.8, one row, chosen as above; texts without words stay."""
    docs = _keyed(docs)
    return _only(docs, minhash.near_duplicates(docs, row_key=ROW).where("kept"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item; repeated rows are judged each, texts without words stay."""
    docs = _keyed(docs)
    judged = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), row_key=ROW)
    return _only(docs, judged.where("not contaminated"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: how many words each document gives it, and its source's target; texts without words give none, a null source is a source."""
    return mixing.fair_queue(docs).select("doc_id", "source", "size", "source_size", "target", "taken")


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with 16 bytes that tell each row from all others and stay the same whenever it is read."""
    place = F.concat_ws("#", "_metadata.file_path", "_metadata.row_index")
    try:
        return docs.withColumn(ROW, F.unhex(F.md5(place)))
    except AnalysisException:  # not read from files
        return materialise(docs, "rows").withColumn(ROW, F.unhex(F.md5(place)))


def _only(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows of ``docs`` that ``kept`` has, without the row's mark."""
    return docs.join(kept.select(ROW), ROW, "left_semi").drop(ROW)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("minhash dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

#: The first stage is a learnt classifier, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each stage's result is written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs, name.replace(" ", "-"))
            release(before)  # what an earlier stage wrote
    return docs
