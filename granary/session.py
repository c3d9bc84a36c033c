"""Session settings that the library relies on."""

from __future__ import annotations

import io
import os
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

from granary.store import fresh_path

_shipped: set[str] = set()

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


#: Setting and bytes of an Arrow batch to or from Python; Spark's own default is 64 MB, several times over in flight.
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def local_session(app: str = "granary", cpus: int | None = None, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    settings = SETTINGS | {"spark.sql.shuffle.partitions": str(cpus), "spark.driver.memory": "12g"} | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Give the workers of a cluster this library, from the folder that all machines share; once a session.

    A local master's workers run on this machine: they get the folder itself on their path.
    """
    home, sc = Path(__file__).resolve().parents[1], spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    known = sc.environment.get("PYTHONPATH", "").split(os.pathsep)
    if str(home) not in known:
        sc.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [str(home), *known]))
    if sc.master == "local" or sc.master.startswith("local["):
        return
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for file in sorted((home / "granary").rglob("*.py")):
            z.write(file, file.relative_to(home))
    # Through Spark's own file systems, so that any store it knows will do.
    path = sc._jvm.org.apache.hadoop.fs.Path(fresh_path(spark, "library") + "/granary.zip")
    out = path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path)
    out.write(held.getvalue())
    out.close()
    sc.addPyFile(path.toString())


def modest_batches(spark: SparkSession) -> None:
    """Make ready for Python workers: they have the library, and batches are small unless the session's owner has chosen a size."""
    ship(spark)
    if spark.sparkContext.getConf().get(BATCH[0]) is None:
        spark.conf.set(*BATCH)
