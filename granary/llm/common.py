"""What the operators of this package share: tables in the shared folder and words."""

from __future__ import annotations

from pyspark.sql import SparkSession

from granary.session import modest_batches
from granary.store import fresh_path, release, shared_folder, stored

__all__ = ["WORD", "fresh_path", "modest_batches", "release", "shared_folder", "spread", "stored"]

#: Words are maximal runs of anything but ASCII space and the controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def spread(spark: SparkSession) -> int:
    """The number of shuffle partitions of the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
