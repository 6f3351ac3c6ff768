"""Results to storage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one the cluster shares: ``spark.checkpoint.dir`` or, where that is
    unset, the checkpoint folder given to the context.  Without either it is an error: executors
    would write to disks of their own and later reads would miss those files."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{base.rstrip('/')}/freightaudit-{uuid.uuid4().hex}"


def local_shared_folder(spark: SparkSession) -> None:
    """For tests and single-machine runs: name a temporary folder where the session names none."""
    context = spark.sparkContext
    if spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir():
        return
    if not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="freightaudit-"))


def stored(df: DataFrame, schema: StructType | None = None) -> DataFrame:
    """``df`` written to the shared folder and read back (as ``schema``, if given): work is done
    once, lineage is cut, and a lost executor costs a re-read."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema or df.schema).parquet(path)


def write_decisions(decisions: DataFrame, path: str, run_id: str, fmt: str = "parquet") -> None:
    """Decisions below ``path``, partitioned by run: runs add up, and a run written again replaces
    its own rows."""
    (
        decisions.withColumn("run_id", F.lit(run_id))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("run_id")
        .format(fmt)
        .save(path)
    )


def write_report(report: DataFrame, path: str, run_id: str) -> None:
    """The evidence table, nested columns kept."""
    write_decisions(report, path, run_id, "parquet")


def write_submission_json(decisions: DataFrame, path: str) -> None:
    """Decisions as JSON objects keyed by mail id, one object per row."""
    keyed = decisions.select(
        F.to_json(
            F.create_map(
                F.col("email_id"), F.struct(*[c for c in decisions.columns if c != "email_id"])
            ),
            {"ignoreNullFields": "false"},
        ).alias("value")
    )
    keyed.write.mode("append").text(path)
