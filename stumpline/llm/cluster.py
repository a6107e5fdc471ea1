"""What the operators of this package need from the session: their code on the executors, staged tables, key ids."""

from __future__ import annotations

import shutil
import tempfile
from functools import cache
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stumpline.sources.staging import staged

__all__ = ["bounded_text", "hashed_sample", "ship", "staged", "without_rows"]

SENT = 200_000


@cache
def _shipped(app: str) -> str:
    """The package as one archive on the driver; Spark's own file service hands it to the executors."""
    package = Path(__file__).resolve().parents[1]
    return shutil.make_archive(f"{tempfile.mkdtemp(prefix='run-')}/{package.name}", "zip", package.parent, package.name)


_sent: set[str] = set()


BATCH_BYTES = "4m"


def ship(spark: SparkSession) -> None:
    """Let executors import this package, wherever the driver took it from; bound what goes to Python at once.

    Texts differ much in length, so Arrow batches are bounded by bytes, in this session, and not by rows alone.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    app = spark.sparkContext.applicationId
    if app not in _sent:
        spark.sparkContext.addPyFile(_shipped(app))
        _sent.add(app)


def bounded_text(df: DataFrame, column: str) -> Column:
    """The text column, null as empty."""
    return F.coalesce(df[column].cast("string"), F.lit(""))


def hashed_sample(df: DataFrame, size: int, *key: str) -> DataFrame:
    """At most ``size`` rows, those whose key's hash is least.

    Rows far from it go where they are read: about twice as many as are wanted, however many there are, meet in one task.
    """
    share = min(1.0, 2 * size / max(1, df.count()))
    near = df.where(F.pmod(F.xxhash64(*key), F.lit(1 << 40)) <= F.lit(int(share * (1 << 40))))
    return near.orderBy(F.pmod(F.xxhash64(*key), F.lit(1 << 40)), *key).limit(size)


def without_rows(docs: DataFrame, keys: dict[str, Column], gone: DataFrame, repeated: DataFrame) -> DataFrame:
    """The documents without those whose keys are in ``gone``; of equal rows with keys in ``repeated``, one.

    Up to ``SENT`` keys are sent to the scan, so that no text is shuffled; beyond it, texts and keys are joined by hash.
    """
    columns = docs.columns
    named = {f"__{name}": column for name, column in keys.items()}
    rows = docs.withColumns(named)

    def sided(keyed: DataFrame) -> DataFrame:
        keyed = staged(keyed.select(*(F.col(name).alias(f"__{name}") for name in keys)).distinct())
        return F.broadcast(keyed) if keyed.count() <= SENT else keyed

    left = rows.join(sided(gone), list(named), "left_anti")
    again = staged(repeated.select(*keys).distinct())
    if not again.isEmpty():
        again = sided(again)
        once = left.join(again, list(named), "left_semi").dropDuplicates(list(named))
        left = left.join(again, list(named), "left_anti").unionByName(once)
    return left.select(*columns)
