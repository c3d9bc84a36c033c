"""Queries by name, each beside its SQL, and the relations that they read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from granary.store import numbered, stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under an operator's name, with SQL that DuckDB can run for the same rows."""

    def register(f):
        assert name not in QUERIES, name
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- a catalogue of files over ``documents``; the statement is the same in both engines

FILES = """
SELECT doc_id, lang || '/' || source || '/' || CASE doc_id % 10 WHEN 0 THEN CAST(doc_id AS VARCHAR(20)) || '.TXT' WHEN 1 THEN 'v' || CAST(doc_id AS VARCHAR(20)) || '.md'
         WHEN 2 THEN '.h' || CAST(doc_id AS VARCHAR(20)) WHEN 3 THEN 'README' || CAST(doc_id AS VARCHAR(20)) WHEN 4 THEN CAST(doc_id AS VARCHAR(20)) || '.tar.gz'
         ELSE CAST(doc_id AS VARCHAR(20)) || '.txt' END AS path,
       CASE WHEN doc_id % 23 = 0 THEN 'Symlink' ELSE 'File' END AS kind,
       CASE WHEN doc_id % 23 = 0 THEN 0 ELSE octet_length({raw}) END AS size,
       CASE WHEN doc_id % 17 = 0 THEN NULL ELSE (doc_id - 300) * 86400123456 END AS mtime_ns,
       CAST(doc_id % 16 AS INT) AS flags, lang, source
FROM {docs}
"""
DUCK_FILES = FILES.format(raw="encode(text)", docs="documents")
ENTRIES = f"""files AS ({DUCK_FILES}),
listed AS (SELECT path, kind, size::BIGINT AS size, mtime_ns, flags FROM files
  UNION ALL SELECT DISTINCT lang, 'Directory', 0, NULL::BIGINT, 0 FROM files
  UNION ALL SELECT DISTINCT lang || '/' || source, 'Directory', 0, NULL::BIGINT, 0 FROM files),
entries AS (SELECT row_number() OVER (ORDER BY path) - 1 AS id, * FROM listed)"""
NAME = "split_part(path, '/', -1)"
ANCESTORS = "list_transform(range(1, len(string_split(path, '/'))), lambda i: array_to_string(string_split(path, '/')[1:i], '/'))"

_kept: dict[tuple, DataFrame] = {}


def state_of(spark: SparkSession, path: str) -> tuple:
    """Names, sizes and times of a table's files: another state is another table."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return tuple((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in system.listStatus(at))


def once(kind: str):
    """A relation over documents that is built and stored once per session and state of their files."""

    def wrap(f):
        def get(spark: SparkSession, sf_dir: str) -> DataFrame:
            key = (kind, spark.sparkContext.applicationId, state_of(spark, f"{sf_dir}/documents.parquet"))
            if key not in _kept:
                _kept[key] = f(spark, sf_dir)
            return _kept[key]

        return get

    return wrap


def forget() -> None:
    """Build such relations anew from here on."""
    _kept.clear()


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    statement = FILES.replace("{raw}", "text")
    return spark.sql(statement, docs=table(spark, sf_dir, "documents"))


@once("entries")
def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entry table: id in path order, path, kind, size, mtime_ns, flags."""
    found = files(spark, sf_dir)
    rows = found.select("path", "kind", found["size"].cast("long").alias("size"), "mtime_ns", "flags")
    for folder in ("lang", "lang || '/' || source"):
        rows = rows.union(found.selectExpr(folder).distinct().selectExpr("*", "'Directory'", "0L", "CAST(NULL AS BIGINT)", "0"))
    return stored(numbered(rows, "path"), "entries").select("id", "path", "kind", "size", "mtime_ns", "flags")
