"""Where jobs put what they must be able to read again after losing executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Where the setting is missing, one is made and set for the session if the driver is the only machine
    (a local master: tests, a laptop); on a cluster that is an error.
    """
    root = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING, None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"set {SETTING} to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quillgate-")
        spark.conf.set(SETTING, root)
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


_MADE: list[str] = []


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A path of its own under the shared folder; nothing is created yet."""
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    _MADE.append(path)
    return path


def clear_workspace(spark: SparkSession) -> int:
    """Deletes what this process has put in the shared folder; results that were read from it are gone then."""
    gone = 0
    while _MADE:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        gone += bool(target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True))
    return gone


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage, survives executor loss."""
    spark = df.sparkSession
    path = fresh_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(table: DataFrame) -> DataFrame:
    """A table read from too few splits for the cores there are, dealt out to all; any other as it is.

    For a small table whose rows are costly to work on; a large one has more splits than cores.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    splits = table._jdf.queryExecution().toRdd().getNumPartitions()
    return table if splits >= cores else table.repartition(cores)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors, once a context, so that their Python can import it."""
    context = spark.sparkContext
    if getattr(context, "_quillgate_shipped", False):
        return
    here = Path(__file__).resolve().parent
    # code, not data; executors that join later fetch it from here, so it stays until the driver ends
    folder = tempfile.mkdtemp(prefix="quillgate-")
    atexit.register(shutil.rmtree, folder, True)
    for f in here.rglob("*.py"):
        target = Path(folder, "src", here.name, f.relative_to(here))
        target.parent.mkdir(parents=True, exist_ok=True)
        shutil.copy(f, target)
    context.addPyFile(shutil.make_archive(f"{folder}/quillgate-package", "zip", f"{folder}/src"))
    context._quillgate_shipped = True
