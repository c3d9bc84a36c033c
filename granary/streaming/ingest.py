"""Incremental forms: files that arrive, chunks that were seen, generations that grow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.operators.dedup import fixed_chunks
from granary.sources.sinks import committed, read_container, write_container
from granary.store import stored


def arriving(spark: SparkSession, folder: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """A stream over the Parquet files of a folder as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def new_chunks(stream: DataFrame, time: str, key: str = "hash", late: str = "1 day") -> DataFrame:
    """Chunks not seen before.  The state holds what came within ``late``; repeats later than that pass again."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def append_generations(stream: DataFrame, folder: str, checkpoint: str, size: int = 1 << 16):
    """Every batch becomes a generation of the container at ``folder``: the whole tree so far, and the chunks that are new.

    stream: path, content; a path that comes again is replaced, the last of a batch by content counting.  Content is
    cut to chunks of ``size`` characters, and chunks that an earlier generation holds are not written again.  A
    batch that is run again writes the same generation over itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark, generation = batch.sparkSession, number + 1
        rows = stored(batch.groupBy("path").agg(F.max("content").alias("content")), "arrived")
        pieces = fixed_chunks(rows, size).select("path", "pos", "hash", "content")
        entries, members = rows.select("path", F.length("content").alias("size")), pieces.select("path", "pos", "hash")
        blobs = pieces.select("hash", "content").dropDuplicates(["hash"])
        before = [g for g in committed(spark, folder) if g < generation] if number else []
        if before:
            old_entries, old_members, old_blobs = read_container(spark, folder, before[-1])
            kept = rows.select("path")
            entries = entries.unionByName(old_entries.join(kept, "path", "left_anti"))
            members = members.unionByName(old_members.join(kept, "path", "left_anti"))
            blobs = blobs.join(old_blobs.select("hash"), "hash", "left_anti")
        write_container(folder, generation, entries, members, blobs)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()


def windowed_counts(events: DataFrame, time: str, key: str, length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts per window and key with a watermark, for streams and tables alike."""
    source = events.withWatermark(time, late) if events.isStreaming else events
    return source.groupBy(F.window(time, length).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


def progress(events: DataFrame, time: str, per: str = "10 seconds") -> DataFrame:
    """At most one progress row per interval: the last."""
    slot = F.window(time, per)
    return events.groupBy(slot.alias("w")).agg(F.max_by(F.struct("done", "total"), time).alias("p")).select(F.col("w.start").alias("start"), "p.done", "p.total")


def drain(stream: DataFrame, folder: str, checkpoint: str) -> DataFrame:
    """Run a stream over all that is there, into Parquet files of a folder that executors share, and read them.

    Rows come as the stream's own plan finishes them: with a watermark, windows that may still change stay in the
    state and are not among them.
    """
    q = stream.writeStream.outputMode("append").format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(folder)


def totals(stream: DataFrame, keys: list[str], folder: str, checkpoint: str) -> DataFrame:
    """Counts per key of all that a stream has brought, whatever its order: every batch adds its own counts to the
    folder, under its number, and the reader sums them, so no state grows with the keys and late rows count."""

    def add(batch: DataFrame, number: int) -> None:
        batch.groupBy(*keys).agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    q = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.parquet(folder).groupBy(*keys).agg(F.sum("n").alias("n"))
