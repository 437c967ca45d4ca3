"""Session settings, the shared checkpoint folder and table access."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession


def local_session(cores: int | str = "*", memory: str = "8g", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own settings."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tracequarry")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (``spark.checkpoint.dir``), set for checkpoints too.

    Only a local session that names none, as in tests, gets a temporary folder;
    on a cluster such a folder would not be shared, so there it is an error.
    """
    sc = spark.sparkContext
    now = sc._jsc.sc().getCheckpointDir()
    if now.isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all machines share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tracequarry-"))
        now = sc._jsc.sc().getCheckpointDir()
    return now.get()


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, partition by partition.

    Used where a result is read more than once and has to be the same each
    time (range partitions are drawn from a sample, so a second run could cut
    elsewhere), and where losing an executor must not repeat the work before.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """As ``cut``, but as a table in the shared folder: small on disk, and readers take the columns they need.

    Its partitions are not those of ``df``.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, per_core: int = 2, *by: Column) -> DataFrame:
    """``df`` in at least ``per_core`` partitions a core (hashed, if keys are given), for work that costs far more than a shuffle.

    Small files make few partitions, which would leave cores idle. The number
    is judged by the plan's estimated size, so nothing runs for it; large or
    unknown inputs are left as they are.
    """
    spark = df.sparkSession
    least = per_core * spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    each = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return df.repartition(least, *by) if size < least * each else df


def by_key(df: DataFrame, *key: str) -> DataFrame:
    """``df`` hashed by key into the session's number of partitions, which adaptive execution leaves as they are.

    For groups that are slow to work on and small to move.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors, once per session.

    Needed where they can't import it by themselves, as on a cluster that has
    only this repository's files on the driver.
    """
    sc = spark.sparkContext
    if getattr(sc, "_tracequarry_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="tracequarry-zip-")) / "tracequarry.zip"
    with zipfile.ZipFile(target, "w") as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, Path(root.name) / path.relative_to(root))
    sc.addPyFile(str(target))
    sc._tracequarry_shipped = True
