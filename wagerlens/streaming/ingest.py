"""The load-and-clean job for a landing folder that keeps receiving raw files.

Reports are batch queries over whole tables; only the load is incremental. Each
file is cleaned once, by the same reader and rules as a full load. What was taken in is recorded in the store: each file's
path and a digest of its rows. A batch is one part of the store, named by the files that it adds, and counts from the moment it is
recorded. So a batch that is repeated overwrites its part or adds nothing, whichever session, settings or checkpoint it runs
under; a lost checkpoint costs one more reading of the landing folder. A file whose rows have changed since is a new file.

One ingest of a table runs at a time; other tables, and readers, are not disturbed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from wagerlens.sources.store import record_folder, record_of, write_part
from wagerlens.sources.text import RAW_COLUMNS, stream_table

_FILE = "_landed_file"


def checkpoint_folder(store_dir: str, table: str) -> str:
    """Kept with the store, as it belongs to the store and not to a session."""
    return f"{store_dir}/_ingest/{table}"


def _digests(batch: DataFrame, table: str) -> DataFrame:
    """(file, digest) of a batch's files; the order of rows does not matter."""
    row = [F.col(name) for name in RAW_COLUMNS[table]]
    sums = [F.bit_xor(F.xxhash64(F.lit(seed), *row)) for seed in range(2)]
    parts = [F.hex(part) for part in (F.count("*"), *sums)]
    return batch.groupBy(F.col(_FILE).alias("file")).agg(F.concat_ws("-", *parts).alias("digest"))


def add_batch(batch: DataFrame, table: str, store_dir: str, tolerant: bool = False) -> str | None:
    """Add the rows of files not yet recorded as one part and record it; the part's name, or None if there are none."""
    spark = batch.sparkSession
    pending = f"{store_dir}/_pending/{table}"
    _digests(batch, table).write.mode("overwrite").parquet(pending)
    landed = spark.read.schema("file string, digest string").parquet(pending)
    fresh = landed.join(record_of(spark, store_dir, table), ["file", "digest"], "left_anti")
    name = [F.bit_xor(F.xxhash64(F.lit(seed), "file", "digest")) for seed in range(2)]
    number, *digest = fresh.agg(F.count("*"), *name).first()
    if not number:
        return None
    part = "files-" + "".join(f"{word % (1 << 64):016x}" for word in digest)
    if landed.count() > number:
        batch = batch.join(fresh.select(F.col("file").alias(_FILE)), _FILE, "left_semi")
    write_part(batch, table, store_dir, part, tolerant)
    # One file, so that the part counts as a whole or not at all.
    record = fresh.select(F.lit(part).alias("part"), "file", "digest")
    record.coalesce(1).write.mode("append").parquet(record_folder(store_dir, table))
    return part


def ingest_new_files(
    spark: SparkSession, table: str, landing_dir: str, store_dir: str, tolerant: bool = False
) -> StreamingQuery:
    """Append files not seen before from ``landing_dir`` to the stored ``table``, then stop."""

    def add(batch: DataFrame, _: int) -> None:
        add_batch(batch, table, store_dir, tolerant)

    return (
        stream_table(spark, table, landing_dir)
        .select("*", F.col("_metadata.file_path").alias(_FILE))
        .writeStream.foreachBatch(add)
        .option("checkpointLocation", checkpoint_folder(store_dir, table))
        .trigger(availableNow=True)
        .start()
    )
