"""Reading the engine's input tables and the folder that all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_own_dirs: dict[str, str] = {}
_shipped: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Let Python workers import this package, once an application: Spark sends it unless PYTHONPATH has it anyway."""
    package = Path(__file__).resolve().parents[1]
    app = spark.sparkContext.applicationId
    if app in _shipped or not package.is_dir():
        return
    _shipped.add(app)
    if str(package.parent) in (str(Path(p).resolve()) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p):
        return
    path = Path(tempfile.mkdtemp(prefix="lexmill-code-")) / f"{package.name}.zip"
    with zipfile.ZipFile(path, "w") as out:
        for f in sorted(package.rglob("*.py")):
            out.write(f, f.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(path))


def arrow_map(df: DataFrame, function, schema: str) -> DataFrame:
    """df.mapInArrow with the package at hand on the workers."""
    ship_code(df.sparkSession)
    return df.mapInArrow(function, schema)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Table ``name`` of the data folder; any path that Spark's readers open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; on a local master without one, an own temporary one."""
    if base := spark.conf.get("spark.checkpoint.dir", None):
        return base
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = f"file://{tempfile.mkdtemp(prefix='lexmill-')}"
    return _own_dirs[app]


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/lexmill/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors, computed once."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_materialized(df: DataFrame) -> None:
    """Delete the files behind a materialized table that nothing reads any more."""
    spark = df.sparkSession
    root = f"{shared_dir(spark)}/lexmill/"
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/lexmill/" in folder:
            jvm = spark.sparkContext._jvm
            path = jvm.org.apache.hadoop.fs.Path(root + folder.rpartition("/lexmill/")[2])
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
