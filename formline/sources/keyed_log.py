"""Tables that keep the latest row per key as a log: bucketed deltas, a manifest per version, compaction of long buckets."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class WriteConflict(RuntimeError):
    """Other writers took every version that this one tried to take."""


class KeyedLog:
    """The latest row per key of all that was written to ``path``.

    Keys are hashed into ``buckets``. A write stores its rows as one delta, with files for the buckets it touches alone,
    and a manifest that names, per bucket, the deltas that make it up; all other files stay as they are. A bucket of
    more than ``most`` deltas is compacted by the write that makes it so. A version is its manifest: readers see whole
    versions only, and a lost job leaves nothing but files that no manifest names.

    A writer takes the next version by creating its manifest, which fails if there is one, as the file system's create
    without overwriting does; it then takes up what the other wrote and tries the version after. Of rows with one key
    the largest ``ts`` counts, nulls last, and of equal ones the last written. Rows with a null key are refused.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, ts: str, buckets: int = 64, most: int = 4):
        self.spark, self.path, self.key, self.ts, self.buckets, self.most = spark, path.rstrip("/"), key, ts, buckets, most

    def versions(self) -> list[int]:
        """Versions that are whole, in order."""
        names = [n[:-5] for n in self._names("manifest") if n.endswith(".json")]
        return [v for v in sorted(int(n) for n in names if n.isdigit()) if self._text(v)]

    def manifest(self, version: int | None = None) -> dict:
        """What a version, the newest by default, is made of; version -1 is the empty table."""
        kept = self.versions()
        if version is None:
            version = kept[-1] if kept else -1
        if version == -1:
            return {"version": -1, "buckets": self.buckets, "schema": None, "files": {}}
        if version not in kept:
            raise ValueError(f"there is no version {version}")
        return json.loads(self._text(version))

    def read(self, version: int | None = None, schema: T.StructType | None = None) -> DataFrame:
        """The latest row per key at a version; ``schema`` serves a table that nothing was written to."""
        now = self.manifest(version)
        if now["schema"] is None:
            return self.spark.createDataFrame([], schema or T.StructType([]))
        names = T.StructType.fromJson(now["schema"])
        return self._latest(self._delta_rows(names, [d for ds in now["files"].values() for d in ds])).select(*names.names)

    def write(self, df: DataFrame, tries: int = 20) -> int:
        """Adds rows and gives the version that has them; an empty frame takes a version too."""
        if df.where(F.col(self.key).isNull()).limit(1).count():
            raise ValueError(f"a row has no {self.key}")
        now = self.manifest()
        self.buckets = now["buckets"]
        tag = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        bucket = F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(self.buckets)).cast("int")
        rows = self._latest(df.withColumn("_seq", F.lit(time.time_ns())))
        rows.withColumn("_bucket", bucket).repartition(self.buckets, "_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/data/{tag}")
        mine = {n.split("=")[1]: f"{tag}/{n}" for n in self._names(f"data/{tag}") if n.startswith("_bucket=")}
        packed: dict[str, tuple[list[str], str]] = {}
        for _ in range(tries):
            schema = self._merged(now["schema"], df.schema)
            files = {b: list(ds) for b, ds in now["files"].items()}
            for b, d in mine.items():
                files.setdefault(b, []).append(d)
            long = [b for b in mine if len(files[b]) > self.most]
            stale = [b for b in long if b not in packed or packed[b][0] != files[b]]
            if stale:  # what another writer added meanwhile goes in as well
                packed |= self._compacted(schema, {b: files[b] for b in stale})
            for b in long:
                files[b] = [packed[b][1]]
            made = {"version": now["version"] + 1, "buckets": self.buckets, "schema": schema.jsonValue(), "files": files}
            if self._taken(made):
                return made["version"]
            now = self._after(now["version"])
        raise WriteConflict(f"no version could be taken in {tries} tries")

    def vacuum(self, keep: int = 2) -> None:
        """Deletes manifests before the last ``keep`` and the deltas that only those name; what no manifest names may be a write under way and stays."""
        kept = self.versions()
        old, new = kept[:-keep], kept[-keep:]
        used = {d for v in new for ds in self.manifest(v)["files"].values() for d in ds}
        gone = {d for v in old for ds in self.manifest(v)["files"].values() for d in ds} - used
        for d in gone:
            self._fs().delete(self._at(f"data/{d}"), True)
        for v in old:
            self._fs().delete(self._at(f"manifest/{v}.json"), False)

    def _latest(self, rows: DataFrame) -> DataFrame:
        best = F.max_by(F.struct(*rows.columns), F.struct(F.col(self.ts).isNotNull(), self.ts, "_seq", F.xxhash64(*rows.columns)))
        return rows.groupBy(F.col(self.key).alias("_key")).agg(best.alias("_row")).select("_row.*")

    def _delta_rows(self, schema: T.StructType, deltas: Sequence[str]) -> DataFrame:
        whole = T.StructType([*schema.fields, T.StructField("_seq", T.LongType())])
        if not deltas:
            return self.spark.createDataFrame([], whole)
        return self.spark.read.schema(whole).parquet(*(f"{self.path}/data/{d}" for d in deltas))

    def _compacted(self, schema: T.StructType, files: dict[str, list[str]]) -> dict[str, tuple[list[str], str]]:
        tag = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}-c"
        rows = self._latest(self._delta_rows(schema, [d for ds in files.values() for d in ds]))
        bucket = F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(self.buckets)).cast("int")
        rows.withColumn("_bucket", bucket).repartition(self.buckets, "_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/data/{tag}")
        return {b: (ds, f"{tag}/_bucket={b}") for b, ds in files.items()}

    def _after(self, version: int, wait: float = 30.0) -> dict:
        """The manifest of the version after, once its writer has written it; one that stays empty was lost and counts as a copy of the one before."""
        until = time.time() + wait
        while time.time() < until:
            if self._text(version + 1):
                return self.manifest()
            time.sleep(0.1)
        return self.manifest() | {"version": version + 1}

    def _merged(self, old: dict | None, new: T.StructType) -> T.StructType:
        """Fields of both; types must not change."""
        fields = {f.name: f for f in (T.StructType.fromJson(old).fields if old else [])}
        for f in new.fields:
            if f.name in fields and fields[f.name].dataType != f.dataType:
                raise ValueError(f"{f.name} was {fields[f.name].dataType.simpleString()} and is {f.dataType.simpleString()}")
            fields.setdefault(f.name, T.StructField(f.name, f.dataType, True))
        return T.StructType(list(fields.values()))

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _fs(self):
        return self._at("x").getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def _names(self, folder: str) -> list[str]:
        at = self._at(folder)
        return [s.getPath().getName() for s in self._fs().listStatus(at)] if self._fs().exists(at) else []

    def _text(self, version: int) -> str:
        at = self._at(f"manifest/{version}.json")
        if not self._fs().exists(at):
            return ""
        stream = self._fs().open(at)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _taken(self, made: dict) -> bool:
        """Whether the version was free and is this writer's now."""
        try:
            out = self._fs().create(self._at(f"manifest/{made['version']}.json"), False)
        except Exception as e:
            if "AlreadyExists" in str(e) or "already exists" in str(e):
                return False
            raise
        out.write(bytearray(json.dumps(made).encode()))
        out.close()
        return True
