"""Shared folder, written intermediate tables and reading of input tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The session names it in ``spark.checkpoint.dir``. Where that is unset, a local session (as
    in tests) gets a temporary folder of its own; on a cluster, where executors wouldn't see
    it, that is an error.
    """
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    path = path or context.getCheckpointDir()
    if not path:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        context.setCheckpointDir(path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own for one table or set of files in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage in a way that outlives lost executors.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Bound rows and bytes of an Arrow batch, so that long texts don't pile up in a worker.

    All operators set the same bounds, and leave lower ones as they are.
    """
    for name, bound in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = int(spark.conf.get(name).rstrip("b"))
        if not 0 < now <= bound:
            spark.conf.set(name, str(bound))


#: A table with a row for each group is broadcast up to so many rows (a few hundred bytes each); beyond, the join is salted.
BROADCAST_ROWS, SALTS = 50_000, 64


def keyed_join(rows: DataFrame, keyed: DataFrame, match: Column, salt: Column) -> DataFrame:
    """Inner join of rows with a written table that has few rows, at most one for each row of ``rows``.

    A larger one is joined in SALTS copies: the rows of a frequent key are dealt to as many tasks by ``salt``.
    """
    if keyed.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(keyed), match)
    copies = keyed.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.join(copies, match & (F.pmod(salt, F.lit(SALTS)) == F.col("_copy"))).drop("_copy")


#: Keys with more than this share of all rows are joined by broadcast; there are at most 1 / HOT of them.
HOT = 1e-5


def skewed_join(rows: DataFrame, keyed: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """Inner join of rows with ``keyed``, which has each key once, and in ``weight`` about how many rows have it.

    Frequent keys are broadcast, of which there are by their share of all rows at most 1 / HOT;
    the join by shuffle is of the others, and so has no hot key.
    """
    total = keyed.agg(F.sum(weight)).collect()[0][0] or 0
    least = max(1000, int(total * HOT))
    hot = F.broadcast(keyed.where(F.col(weight) > least))
    frequent = rows.join(hot, keys)
    others = rows.join(hot.select(*keys), keys, "left_anti").join(keyed.where(F.col(weight) <= least), keys)
    return frequent.unionByName(others)
