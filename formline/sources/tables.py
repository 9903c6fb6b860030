"""Reading and writing tables: tolerant scans, partitioned writes, ledgers, fingerprints, reports."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from formline.operators.joins import skip_seen, upsert_latest


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at)


def read_table(spark: SparkSession, path: str, schema: T.StructType, columns: Sequence[str] | None = None) -> DataFrame:
    """Chosen columns of a Parquet table; columns that older files lack are null, a missing table is empty."""
    wanted = T.StructType([f for f in schema.fields if columns is None or f.name in columns])
    if not _exists(spark, path):
        return spark.createDataFrame([], wanted)
    return spark.read.schema(wanted).option("recursiveFileLookup", True).parquet(path)


def register_views(spark: SparkSession, root: str, names: Sequence[str]) -> list[str]:
    """A view over each table that has data, its files joined by column name; returns their names."""
    made = []
    for name in names:
        if _exists(spark, f"{root}/{name}"):
            spark.read.option("mergeSchema", True).parquet(f"{root}/{name}").createOrReplaceTempView(name)
            made.append(name)
    return made


def view_or_empty(spark: SparkSession, name: str, schema: T.StructType) -> DataFrame:
    return spark.table(name) if spark.catalog.tableExists(name) else spark.createDataFrame([], schema)


def write_partitioned(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """Overwrites only the partitions that ``df`` has; rows of one partition are gathered first, so files stay few."""
    df.repartition(*by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def write_latest(spark: SparkSession, df: DataFrame, path: str, key: str, ts: str) -> None:
    """Keeps the latest row per key of the table at ``path`` and ``df``; read it with ``read_latest``.

    Each call writes a version of its own beside the others, and only a whole version can be read, so a lost job leaves
    the table as it was. Versions before the last but one are deleted; readers of the last two aren't disturbed.
    """
    kept = _versions(spark, path)
    old = spark.read.parquet(f"{path}/v{kept[-1]}") if kept else df.limit(0)
    upsert_latest(old, df, key, ts).write.mode("overwrite").parquet(f"{path}/v{kept[-1] + 1 if kept else 0}")
    for v in kept[:-1]:
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v{v}")
        at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the versions that are whole, in order."""
    if not _exists(spark, path):
        return []
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    names = [s.getPath().getName() for s in at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).listStatus(at)]
    return sorted(int(n[1:]) for n in names if re.fullmatch(r"v\d+", n) and _exists(spark, f"{path}/{n}/_SUCCESS"))


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    """The newest whole version of a table that ``write_latest`` keeps."""
    return spark.read.parquet(f"{path}/v{_versions(spark, path)[-1]}")


def ingest_new(spark: SparkSession, candidates: DataFrame, ledger_path: str, key: str) -> DataFrame:
    """Candidates that the ledger lacks; ``record`` them once they are stored."""
    return skip_seen(candidates, spark.read.parquet(ledger_path), key) if _exists(spark, ledger_path) else candidates


def record(spark: SparkSession, stored: DataFrame, ledger_path: str, key: str, kind: str) -> None:
    stored.select(key, F.lit(kind).alias("kind"), F.current_timestamp().alias("fetched_at")).write.mode("append").parquet(ledger_path)


def flatten_meetings(meetings: DataFrame) -> dict[str, DataFrame]:
    """Races, runners and payouts of nested meetings (race_date, venue, races<race_no, distance_m, runners, dividends>)."""
    races = meetings.select("race_date", "venue", F.explode("races").alias("r"))
    key = ["race_date", "venue", F.col("r.race_no").alias("race_no")]
    return {
        "races": races.select(*key, F.col("r.distance_m").alias("distance_m")),
        "runners": races.select(*key, F.explode("r.runners").alias("x")).select("race_date", "venue", "race_no", "x.*"),
        "dividends": races.select(*key, F.explode("r.dividends").alias("x")).select("race_date", "venue", "race_no", "x.*"),
    }


def write_meetings(meetings: DataFrame, root: str) -> dict[str, int]:
    """Writes the flat tables of nested meetings, each partitioned by date and venue, over what these had; gives row counts."""
    made = {}
    for name, df in flatten_meetings(meetings).items():
        write_partitioned(df, f"{root}/{name}", ["race_date", "venue"])
        made[name] = df.count()
    return made


def write_features(df: DataFrame, path: str, name: str) -> DataFrame:
    """Writes a feature table, registers it as a view and gives what was written."""
    df.write.mode("overwrite").parquet(path)
    out = df.sparkSession.read.parquet(path)
    out.createOrReplaceTempView(name)
    return out


def fingerprint(df: DataFrame) -> DataFrame:
    """One row: number of rows and a sum of row hashes, which doesn't depend on their order."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("digest"))


def read_csv_auto(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A CSV file whose separator is the most frequent candidate of its header line; all columns are text without a schema."""
    head = spark.read.text(path).head(1)
    line = head[0][0] if head else ""
    sep = max(",;\t|", key=line.count)
    reader = spark.read.option("header", True).option("sep", sep)
    return (reader.schema(schema) if schema else reader).csv(path)


def write_report(df: DataFrame, path: str) -> None:
    """A small result as one CSV file and one Parquet file."""
    one = df.coalesce(1)
    one.write.mode("overwrite").option("header", True).csv(f"{path}.csv")
    one.write.mode("overwrite").parquet(f"{path}.parquet")


def write_json(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Rows of a stored result; none where there is no such path."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)


def coverage_summary(tables: dict[str, DataFrame], day: str) -> DataFrame:
    """Rows, distinct days, first and last day of each table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n_rows"), F.countDistinct(day).alias("n_days"), F.min(day).alias("first_day"), F.max(day).alias("last_day"))
        out = one if out is None else out.unionByName(one)
    return out


def gap_days(df: DataFrame, day: str, listed: DataFrame | None = None) -> DataFrame:
    """Days between the first and the last that the table lacks, and listed days that it lacks."""
    span = df.agg(F.min(day).alias("a"), F.max(day).alias("b")).where("a is not null")
    days = span.select(F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias("_d")).select(F.col("_d").cast("date").alias(day))
    if listed is not None:
        days = days.union(listed.select(F.col(day).cast("date"))).distinct()
    return days.join(df.select(F.col(day).cast("date").alias(day)).distinct(), day, "left_anti")
