"""Inputs: directory walks, unions of named roots, lists of paths, and run, manifest and registry files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions.globs import to_regex


class Duplicate(ValueError):
    """A path that an input has twice."""


def walk(spark: SparkSession, folder: str, exclude: tuple[str, ...] = (), content: bool = False) -> DataFrame:
    """Files below a folder: path (relative), size, mtime_ns; with ``content`` the bytes too.

    Only listed columns are read, so without ``content`` no file is opened.  Times come in microseconds.
    """
    root = folder.rstrip("/") + "/"
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    path = F.substring_index(F.col("path"), root.split("://")[-1].split(":", 1)[-1], -1)
    rows = found.select(path.alias("path"), F.col("length").alias("size"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"), *(["content"] if content else []))
    for pattern in exclude:
        rows = rows.where(~F.col("path").rlike(to_regex(pattern)))
    return checked(rows)


def checked(inputs: DataFrame) -> DataFrame:
    """The inputs, unless a path comes twice."""
    twice = inputs.groupBy("path").agg(F.count("*").alias("n")).where("n > 1").orderBy("path").first()
    if twice:
        raise Duplicate(twice["path"])
    return inputs


def union_roots(roots: dict[str, DataFrame]) -> DataFrame:
    """Inputs of several named roots as one, each path below its root's name; a path in two places is refused."""
    parts = [df.withColumns({"root": F.lit(name), "path": F.concat(F.lit(f"{name}/"), "path")}) for name, df in sorted(roots.items())]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return checked(out)


def listed(inputs: DataFrame, lines: DataFrame) -> DataFrame:
    """Inputs named in lines (``value``); blank lines and those that begin with # don't count."""
    wanted = lines.select(F.trim("value").alias("path")).where((F.col("path") != "") & ~F.col("path").startswith("#")).distinct()
    return inputs.join(wanted, "path", "left_semi")


#: What a result file holds.
MEASURE = "struct<wall_seconds:double,user_cpu_seconds:double,kernel_cpu_seconds:double,peak_memory_bytes:bigint,timed_out:boolean,descendants_killed:boolean>"
SAMPLE = f"struct<archive_bytes:bigint,compress:{MEASURE},extract:{MEASURE}>"
RESULT = (
    "tool struct<id:string,version:string>, setting struct<id:string>, class string, threads int, "
    "corpus struct<profile:string,manifest_blake3:string,class_files:bigint,class_bytes:bigint>, "
    f"repeats array<{SAMPLE}>, median {SAMPLE}, skipped string, "
    "failed struct<step:string,reason:string,repeat:int,timed_out:boolean>"
)


def results(spark: SparkSession, folder: str) -> DataFrame:
    """Result rows of run folders with run (the folder's name) and aborted (it has no run.json)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").load(folder)
    named = files.select(F.element_at(F.split("path", "/"), -2).alias("run"), F.element_at(F.split("path", "/"), -1).alias("file"), F.col("content").cast("string").alias("json"))
    return parsed_results(named)


def parsed_results(files: DataFrame) -> DataFrame:
    """The same from rows (run, file, json)."""
    whole = files.where("file = 'run.json'").select("run").distinct().withColumn("done", F.lit(True))
    rows = files.where("file not in ('run.json', 'host.json', 'tools.json')").select("run", "file", F.from_json("json", RESULT).alias("r"))
    return rows.join(whole, "run", "left").select("run", "file", F.col("done").isNull().alias("aborted"), "r.*")


MANIFEST = "map<string,struct<bytes_total:bigint,files:array<struct<digest:string,bytes:bigint,licence:string,path:string,source:string>>>>"


def manifest(rows: DataFrame, json: str = "json") -> DataFrame:
    """A manifest's files: class, bytes_total, digest, bytes, licence, path, source."""
    classes = rows.select(F.explode(F.from_json(json, MANIFEST)).alias("class", "c"))
    return classes.select("class", "c.bytes_total", F.inline("c.files"))


def registry_faults(sources: DataFrame) -> DataFrame:
    """(id, fault) of entries without id, class or profile, with a repeated id or negative size."""
    times = sources.groupBy("id").agg(F.count("*").alias("times"))
    fault = (
        F.when(F.col("id").isNull() | (F.col("id") == ""), "no id")
        .when(F.col("times") > 1, "repeated id")
        .when(F.col("class").isNull() | (F.col("class") == ""), "no class")
        .when(F.size("profiles") == 0, "no profile")
        .when(F.col("bytes") < 0, "negative size")
    )
    return sources.join(times, "id", "left").select("id", fault.alias("fault")).where("fault is not null")


def registry_select(sources: DataFrame, profile: str, only: list[str] | None = None) -> DataFrame:
    """Sources of a profile; ``only`` keeps the named ones."""
    chosen: Column = F.array_contains("profiles", profile)
    return sources.where(chosen & F.col("id").isin(only) if only else chosen)


def scan(files: DataFrame, corpus_class: Column) -> DataFrame:
    """Classify and hash contents to a manifest: class, files, bytes_total, digest of the sorted members."""
    rows = files.select("path", "content", corpus_class.alias("class")).select("class", "path", F.octet_length("content").alias("bytes"), F.sha2(F.col("content").cast("binary"), 256).alias("digest"))
    # The members' digests are summed, so no task holds a whole class.
    part = F.conv(F.substring(F.sha2(F.concat_ws("\x00", "path", "bytes", "digest"), 256), 1, 8), 16, 10).cast("long")
    return rows.groupBy("class").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes_total"), F.sum(part).alias("digest"))
