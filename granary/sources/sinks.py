"""Outputs: listing lines, JSON lines, Markdown, and the Parquet container with its entries, chunks and blobs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import paths


def text_lines(entries: DataFrame) -> DataFrame:
    """kind, size, time and path, parted by tabs; an unknown time is a dash; paths are escaped."""
    return entries.select(F.concat_ws("\t", "kind", "size", F.coalesce(paths.iso_time(F.col("mtime_ns")), F.lit("-")), paths.escaped(F.col("path"))).alias("line"))


def json_lines(entries: DataFrame) -> DataFrame:
    """One object per entry; an unknown time is null."""
    return entries.select(F.to_json(F.struct("path", "kind", "size", "mtime_ns", "flags"), {"ignoreNullFields": "false"}).alias("line"))


def write_lines(lines: DataFrame, path: str) -> None:
    lines.write.mode("overwrite").text(path)


def write_files(files: DataFrame, folder: str) -> None:
    """Files (path, content) below a folder that all executors share.

    Each is written under a name of its own attempt and then moved, so a task that runs again leaves whole files."""

    def written(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, root = fs.FileSystem.from_uri(folder)
        task, made = TaskContext.get().taskAttemptId(), set()
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"]):
                at = f"{root}/{path}"
                above = at.rpartition("/")[0]
                if above not in made:
                    system.create_dir(above, recursive=True)
                    made.add(above)
                with system.open_output_stream(f"{above}/.{task}.part") as out:
                    out.write(content)
                system.move(f"{above}/.{task}.part", at)
        yield pd.DataFrame({"n": [0]})

    files.select("path", F.col("content").cast("binary").alias("content")).mapInPandas(written, "n long").write.format("noop").mode("overwrite").save()


def markdown(small: DataFrame) -> str:
    """A small result as a Markdown table; ``|`` is escaped."""
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|")
    rows = [small.columns, *[list(r) for r in small.collect()]]
    lines = ["| " + " | ".join(map(cell, r)) + " |" for r in rows]
    return "\n".join([lines[0], "|" + "---|" * len(small.columns), *lines[1:]])


def report(title: str, parts: list[tuple[str, DataFrame]]) -> str:
    """Small results under headings: one of several columns as a table, one of one column as lines; rows as they come.

    Nothing else goes in, no time and no machine, so equal rows make an equal text.
    """
    out = [f"# {title}"]
    for heading, rows in parts:
        body = markdown(rows) if len(rows.columns) > 1 else "\n".join("" if r[0] is None else str(r[0]) for r in rows.collect())
        out.append(f"## {heading}\n\n{body}")
    return "\n\n".join(out) + "\n"


def write_container(path: str, generation: int, entries: DataFrame, members: DataFrame, blobs: DataFrame) -> None:
    """Append a generation: entries, their chunk lists (path, pos, hash), and the new chunks (hash, content).

    The commit marker comes last; readers go by markers, so a torn append is not seen.
    """
    spark = entries.sparkSession
    for name, df in (("entries", entries), ("members", members), ("blobs", blobs)):
        df.write.mode("overwrite").parquet(f"{path}/{name}/generation={generation}")
    spark.range(1).select(F.lit(generation).alias("generation")).write.mode("overwrite").parquet(f"{path}/commits/at={generation}")


def committed(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the committed generations, ascending."""
    return sorted(r["generation"] for r in spark.read.parquet(f"{path}/commits/*").select("generation").distinct().collect())


def read_container(spark: SparkSession, path: str, generation: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entries and members of a generation (the last committed one), and all blobs up to it."""
    known = committed(spark, path)
    at = known[-1] if generation is None else generation
    if at not in known:
        raise ValueError(f"no generation {at}")
    blobs = spark.read.option("basePath", f"{path}/blobs").parquet(*[f"{path}/blobs/generation={g}" for g in known if g <= at])
    return spark.read.parquet(f"{path}/entries/generation={at}"), spark.read.parquet(f"{path}/members/generation={at}"), blobs


def extract(members: DataFrame, blobs: DataFrame) -> DataFrame:
    """(path, content): every file's chunks, in order, joined."""
    parts = members.join(blobs.select("hash", "content"), "hash").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("pos", "content"))).alias("parts"))
    return parts.select("path", F.array_join(F.transform("parts", lambda p: p["content"]), "").alias("content"))
