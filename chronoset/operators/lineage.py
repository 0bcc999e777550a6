"""Tables that are read more than once: written to the folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def settled(df: DataFrame) -> DataFrame:
    """df as a checkpoint, so that it is made once and a lost executor costs only its tasks.

    The folder is that of spark.checkpoint.dir; a new one only where neither it nor another checkpoint folder is set and all tasks run
    on this machine.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="settled-"))
    return df.checkpoint(eager=True)
