"""Session and table helpers shared by the library's own operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "gridloom", cores: str = "*") -> SparkSession:
    """A local session for tests and benches; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares for checkpoints; a temporary one only where none is set and all runs on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="gridloom-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def stored(df: DataFrame, label: str, paths: list[str] | None = None) -> DataFrame:
    """df as a table in the shared folder, read again. Unlike a checkpoint it has sizes and carries no constraints of the plan
    that made it, which pile up in loops. Its path is added to paths."""
    path = f"{shared_dir(df.sparkSession)}/gridloom-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if paths is not None:
        paths.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str, each: int | None = None) -> DataFrame:
    """df dealt by keys to as many tasks as the session shuffles to: few rows that take long each are not gathered in one task, as
    they would be by their size. each: to more of them where a task would get more rows than that."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(tasks, -(-df.count() // each)) if each else tasks, *keys)


def held(df: DataFrame) -> DataFrame:
    """df kept by Spark and made at once, so that plans built on it know by what its rows are dealt and do not move them again."""
    df.persist().count()
    return df


def dropped(spark: SparkSession, paths: list[str]) -> None:
    """Deletes tables that stored() wrote."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def settled(df: DataFrame) -> DataFrame:
    """df as a checkpoint in the shared folder: plans built on it start there, and lost executors do not take it with them."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()
