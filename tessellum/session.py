"""Session set-up, table access and lineage cuts shared by all operators."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Most bytes (of its rows written as JSON) and most rows that a join's side may have to be broadcast. Beyond either the
#: shuffle form of the same join runs.
BROADCAST_BYTES = 32 << 20
BROADCAST_ROWS = 500_000
#: Parts that each key of a shuffled join is split into.
SALTS = 8


def get_spark(app: str = "tessellum", cpus: int = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    os.environ.setdefault("SPARK_LOCAL_DIRS", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset, a local session gets a folder of its own; on a cluster that would be a folder which no other node
    reads, so it is refused.
    """
    set_by = spark.conf.get("spark.checkpoint.dir", None)
    if set_by:
        return set_by
    have = spark.sparkContext._jsc.sc().getCheckpointDir()
    if have.isDefined():
        return have.get()
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[[^]]*\])?", master):
        raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
    own = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(own)
    return own


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: the lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def forget(df: DataFrame) -> None:
    """Delete the files of a ``materialize`` result that nothing will read again, such as the state before the last round."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def small_enough(df: DataFrame, rows: int | None = None, size: int | None = None) -> bool:
    """Whether ``df`` provably holds at most ``rows`` rows and ``size`` bytes, by default the bounds above."""
    have = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*df.columns)))), F.lit(0)).alias("b")).first()
    return have.n <= (BROADCAST_ROWS if rows is None else rows) and have.b <= (BROADCAST_BYTES if size is None else size)


def salted_join(big: DataFrame, side: DataFrame, on: list[str], how: str = "inner", salts: int | None = None) -> DataFrame:
    """A shuffled join whose keys are split: rows of ``big`` with one key go to ``salts`` tasks by a hash of the row.

    ``side`` is repeated once for each part, so the result is that of the plain join; a key that fills a third of
    ``big`` is no single task's work. ``how`` is inner, left, left_semi or left_anti.
    """
    salts = SALTS if salts is None else salts
    cols = [f.name for f in big.schema.fields if not isinstance(f.dataType, T.MapType)]
    left = big.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in cols]), F.lit(salts)).cast("int"))
    right = side.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def join_small(big: DataFrame, side: DataFrame, on: str | list[str], how: str = "inner", rows: int | None = None, size: int | None = None) -> DataFrame:
    """A join that broadcasts ``side`` only where its rows and bytes are proven small, else shuffles both with split keys."""
    on = [on] if isinstance(on, str) else on
    return big.join(F.broadcast(side), on, how) if small_enough(side, rows, size) else salted_join(big, side, on, how)


def spread(df: DataFrame) -> DataFrame:
    """``df`` on at least as many partitions as there are cores, for work that costs far more than one shuffle of its input.

    A table in few files (or few row groups) would else be one task's work; a table that already has enough partitions,
    as any large one has, is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of a session, once, whatever their working folder and path are."""
    sc = spark.sparkContext
    if getattr(sc, "_tessellum_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="spark-"), "tessellum"), "zip", root, "tessellum")
    sc.addPyFile(archive)
    sc._tessellum_shipped = True
