"""Session helpers: reading tables, cutting lineage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """A Parquet table of a data directory."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints.

    The cluster names it in ``spark.checkpoint.dir``. Only where all runs on one machine and that is unset, a folder of our own is
    made, and removed at the end; on a cluster a folder of one machine would be lost with it, so there it is an error.
    """
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    named = spark.conf.get("spark.checkpoint.dir", "")
    if not named:
        if not context.master.startswith("local"):  # local, local[n], local-cluster[...]: one machine
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="lodegraph-", dir=os.environ.get("TMPDIR"))
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    context.setCheckpointDir(named)
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise a relation in the shared folder, so that later steps neither recompute it nor lose it with an executor."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows laid over all cores where a table has fewer splits than these (one small file); larger tables stay as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


def share_file(spark: SparkSession, path: str) -> str:
    """Send a file of the driver's machine to the executors, once a context; gives the name that ``SparkFiles.get`` knows it by there."""
    context = spark.sparkContext
    sent = context.__dict__.setdefault("_lodegraph_files", set())
    if path not in sent:
        context.addFile(path)
        sent.add(path)
    return os.path.basename(path)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once a context; jobs whose functions run there call it first."""
    import zipfile
    from pathlib import Path

    context = spark.sparkContext
    root = Path(__file__).parent
    if getattr(context, "_lodegraph_shipped", False):
        return
    target = Path(tempfile.mkdtemp(prefix="lodegraph-code-")) / "lodegraph.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    context.addPyFile(str(target))
    context._lodegraph_shipped = True
