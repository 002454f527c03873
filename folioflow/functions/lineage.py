"""Cutting the lineage of a frame that is read more than once."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile

from pyspark.sql import DataFrame


def cut_lineage(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder of ``spark.checkpoint.dir``.

    Where none is set, a local session gets a folder of its own, which goes when the process ends; a cluster has to name a shared one.
    """
    context, shared = df.sparkSession.sparkContext, df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if not shared:
            if not re.match(r"local(\[|$)", context.master):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            shared = tempfile.mkdtemp(prefix="checkpoints-")
            atexit.register(shutil.rmtree, shared, ignore_errors=True)
        context.setCheckpointDir(shared)
    return df.checkpoint()
