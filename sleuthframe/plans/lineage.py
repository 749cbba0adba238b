"""Cutting lineage so that a lost executor costs a re-read and no recomputation."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str | None:
    """The shared folder the cluster names, or None where the session names none."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)


def scratch_folder(spark: SparkSession, prefix: str) -> str:
    """The shared folder, or one of this machine's where the session names none and all of it runs on this machine."""
    folder = checkpoint_folder(spark)
    if folder is None:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir: executors can't see each other's temporary folders")
        folder = tempfile.mkdtemp(prefix=prefix)
    return folder


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the session's checkpoint folder and go on from the written rows.

    The folder is the one in ``spark.checkpoint.dir``. A session on one machine
    that has none (as in tests) gets a temporary folder, any other an error.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(scratch_folder(df.sparkSession, "checkpoint-"))
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and go on from the table: for rounds that each join the last one's rows.

    A checkpoint keeps the planner's guess of its size, which joins multiply, so
    that after some rounds the guess alone has millions of digits and planning
    takes longer than the work; a table is as large as its files. It is also
    computed once, where a checkpoint computes its last stage twice. But it
    forgets how its rows were dealt.
    """
    folder = f"{scratch_folder(df.sparkSession, 'rounds-')}/rounds-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
