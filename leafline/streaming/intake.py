"""Library intake and latest-only display as micro-batch jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from leafline.functions.files import default_mime, route_tool
from leafline.operators.admission import MAX_INPUT, drop_stale, latest_only
from leafline.operators.library import MAX_BYTES, MAX_ITEMS, retain_library

LIBRARY = (
    "lib_id bigint, item_id string, name string, mime string, tool string, created_at bigint, size bigint, "
    "stored boolean, seq bigint"
)
MANIFEST = "bucket int, at bigint, stream string, epoch bigint"
BUCKETS = 256


def accept_files(files: DataFrame, max_bytes: int = MAX_INPUT) -> DataFrame:
    """Files of batches within the byte limit, empty ones left out, with their tool and type.

    ``files`` is (lib_id, batch_id, file_no, name, mime, size, created_at);
    batches and files within a batch are numbered below 2**31.
    """
    totals = files.groupBy("lib_id", "batch_id").agg(F.sum("size").alias("_total"))
    fits = totals.where(F.col("_total") <= max_bytes).select("lib_id", "batch_id")
    name, mime = F.col("name"), F.coalesce("mime", F.lit(""))
    kept = files.where(F.col("size") > 0).join(fits, ["lib_id", "batch_id"], "left_semi")
    return kept.select(
        "lib_id", F.concat_ws("-", "batch_id", "file_no").alias("item_id"), "name", default_mime(name, mime).alias("mime"),
        route_tool(name, mime).alias("tool"), "created_at", "size", F.lit(True).alias("stored"),
        (F.shiftleft(F.col("batch_id").cast("long"), 32) + F.col("file_no")).alias("seq"),
    )


def library_intake(
    library: DataFrame, files: DataFrame, max_batch: int = MAX_INPUT, max_items: int = MAX_ITEMS, max_bytes: int = MAX_BYTES
) -> DataFrame:
    """Library rows after a set of incoming files."""
    return retain_library(library.unionByName(accept_files(files, max_batch)), max_items, max_bytes)


class LibraryStore:
    """Library rows in buckets of libraries, each with versions of its own, and manifests that say which versions count.

    A commit writes the touched buckets, then a manifest; a manifest that was
    written whole is the switch, so a reader sees all of a commit or nothing.
    A manifest names its stream and epoch: an epoch that is repeated, as after
    a restart, starts from the manifest before its own. The files of the last
    two manifests are kept.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path, buckets
        self._place = spark._jvm.org.apache.hadoop.fs.Path(path)
        self._files = self._place.getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, *names: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *names]))

    def _versions(self) -> list[int]:
        """Numbers of the whole manifests, rising."""
        top = self._path("manifest")
        if not self._files.exists(top):
            return []
        names = [s.getPath().getName() for s in self._files.listStatus(top)]
        return sorted(int(n.partition("=")[2]) for n in names if n.startswith("version=") and self._files.exists(self._path("manifest", n, "_SUCCESS")))

    def _manifest(self, version: int) -> tuple[dict[int, int], str | None, int | None]:
        """Version by bucket, which are few, and what stream and epoch they are from."""
        rows = self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest/version={version}").collect()
        return {r.bucket: r.at for r in rows if r.bucket >= 0}, rows[0].stream, rows[0].epoch

    def _rows(self, versions: dict[int, int]) -> DataFrame:
        if not versions or not self._files.exists(self._path("data")):
            return self.spark.createDataFrame([], LIBRARY)
        kept = self.spark.read.schema(f"{LIBRARY}, bucket int, version bigint").parquet(f"{self.path}/data")
        # folders are chosen by these values; no other is read
        wanted = F.struct("bucket", "version").isin([F.struct(F.lit(b), F.lit(v).cast("long")) for b, v in versions.items()])
        return kept.where(F.col("bucket").isin(list(versions)) & F.col("version").isin(sorted(set(versions.values()))) & wanted).drop("bucket", "version")

    def read(self) -> DataFrame:
        """The library as of the last commit."""
        have = self._versions()
        return self._rows(self._manifest(have[-1])[0] if have else {})

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("lib_id"), F.lit(self.buckets)).cast("int")

    def commit(self, files: DataFrame, stream: str, epoch: int, **limits: int) -> None:
        """Add a batch of files; only the buckets of its libraries are read and written."""
        have = self._versions()
        number, now = (have[-1], self._manifest(have[-1])) if have else (0, ({}, None, None))
        if have and now[1:] == (stream, epoch):
            now = self._manifest(have[-2]) if len(have) > 1 else ({}, None, None)
        else:
            number += 1
        versions = now[0]
        touched = [r.bucket for r in files.select(self._bucket().alias("bucket")).distinct().collect()]  # no more than there are buckets
        before = self._rows({b: v for b, v in versions.items() if b in touched})
        after = library_intake(before, files, **limits).withColumn("bucket", self._bucket()).withColumn("version", F.lit(number).cast("long"))
        after.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "version").parquet(f"{self.path}/data")
        new = versions | dict.fromkeys(touched, number)
        rows = [(b, v, stream, epoch) for b, v in new.items()] or [(-1, 0, stream, epoch)]
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/version={number}")
        self._forget([v for v in have if v < number][:-1], [new, versions])

    def _forget(self, old: list[int], counted: list[dict[int, int]]) -> None:
        """Take away older manifests, and the buckets' versions that no kept one names."""
        for version in old:
            for bucket, at in self._manifest(version)[0].items():
                if all(c.get(bucket) != at for c in counted):
                    self._files.delete(self._path("data", f"bucket={bucket}", f"version={at}"), True)
            self._files.delete(self._path("manifest", f"version={version}"), True)


def start_intake(stream: DataFrame, path: str, checkpoint: str, buckets: int = BUCKETS, **trigger) -> StreamingQuery:
    """R4 on a stream: every micro-batch is a commit to the store at ``path``.

    The checkpoint folder names the stream, so a new one goes on from what the
    store holds, and a repeated batch of an old one changes nothing.
    """

    def apply(batch: DataFrame, epoch: int) -> None:
        batch = batch.persist()
        try:
            LibraryStore(batch.sparkSession, path, buckets).commit(batch, checkpoint, epoch)
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def start_latest(stream: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """R5 on a stream: newest result per source in each trigger, unless it is stale by then."""

    def apply(batch: DataFrame, epoch: int) -> None:
        drop_stale(latest_only(batch)).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**trigger).start()
