"""Session helpers: table access, checkpoint folder and sizing."""

from __future__ import annotations

import math
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package, once per context, wherever the driver found it."""
    sc = spark.sparkContext
    if getattr(sc, "_tracewright_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="tracewright-code-")) / "tracewright.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, Path(root.name) / p.relative_to(root))
    sc.addPyFile(str(target))
    sc._tracewright_shipped = True


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan one Parquet table of the data folder; columns are pruned by the plan that follows."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Set the checkpoint folder once and return it.

    The folder the cluster names in ``spark.checkpoint.dir`` is shared by all
    executors and always wins.  Only where the setting is absent (tests, a single
    machine) a temporary folder is made.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="tracewright-checkpoint-")
    sc.setCheckpointDir(configured)
    return configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the result survives the loss of any executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores where a scan has fewer partitions than there are cores; a larger one as it is.

    For row-local work that costs far more than moving the rows: a file of one block would
    keep all cores but one idle.  The rows and their results are the same either way.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def shuffle_width(spark: SparkSession) -> int:
    """The session's shuffle partition count."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def groups_for(spark: SparkSession, total_bytes: int | None, bytes_per_group: int) -> int:
    """Number of hash groups so that one group holds about ``bytes_per_group``.

    At least the session's shuffle width is used so that no core idles.
    """
    return max(shuffle_width(spark), math.ceil((total_bytes or 0) / bytes_per_group), 1)


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies; ``TRACEWRIGHT_TOKENIZERS`` overrides the folder."""
    return os.path.join(os.environ.get("TRACEWRIGHT_TOKENIZERS", "/opt/tokenizers"), name)
