"""Session helpers shared by all subpackages: worker imports and the shared scratch folder."""

from __future__ import annotations

import atexit
import os
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no spark.checkpoint.dir and runs on this machine alone (tests, notebooks).
DEFAULT_SCRATCH = "/tmp/checkpoints/docframe"

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ensure_importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver found it.

    On a cluster the package is installed or sent with ``--py-files``; this covers sessions that were
    started from another working directory.
    """
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([_ROOT, *paths])


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir. Without that setting a cluster has no folder that all executors
    share, which is an error; a session on one machine takes a folder of its own."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named and not (sc.master == "local" or sc.master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (named or DEFAULT_SCRATCH).rstrip("/")


def _remove(jvm, conf, path: str) -> None:
    try:
        hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
        hadoop_path.getFileSystem(conf).delete(hadoop_path, True)
    except Exception:  # the session may be gone at exit; the folder's owner cleans it then
        pass


def write_stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there.

    Every executor reads the same files, so a lost executor costs only its running tasks.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/docframe-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    sc = spark.sparkContext
    atexit.register(_remove, sc._jvm, sc._jsc.hadoopConfiguration(), path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
