"""The session, and cutting lineage in the folder that a cluster's machines share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tracepath", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for k, v in conf.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_end(df: DataFrame) -> Iterator[DataFrame]:
    """df as a frame whose shuffle files go when what is done with it is done. They would stay on the executors' disks until the driver
    collects garbage, which may be never."""
    conf = df.sparkSession.conf
    before = conf.get(CLEAN_UP, None)
    conf.set(CLEAN_UP, "true")
    try:
        yield df.select("*")
    finally:
        conf.unset(CLEAN_UP) if before is None else conf.set(CLEAN_UP, before)


def cut(df: DataFrame) -> DataFrame:
    """df computed once and kept in spark.checkpoint.dir. Only a local master may do without that setting.

    A checkpointed frame goes on with the estimated size of the plan it was made by, and a join's estimate is the product of its sides'. In
    loops that join what a round kept with itself the number's digits double each round, until the driver does nothing else; so the rows
    are taken up as a frame of unknown size, and what they measure decides on broadcasts."""
    _use_folder(df)
    with _shuffles_end(df) as ending:
        kept = ending.checkpoint(eager=True)
    rows = kept._jdf.queryExecution().logical().rdd()
    return DataFrame(df.sparkSession._jsparkSession.internalCreateDataFrame(rows, kept._jdf.schema(), False), df.sparkSession)


def _use_folder(df: DataFrame) -> str:
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tracepath-"))
    return sc._jsc.sc().getCheckpointDir().get()


def keep(df: DataFrame, measured: bool = False) -> DataFrame:
    """As cut(), for frames as large as the input: columns are written compressed, where a checkpoint writes rows as they stand in memory.
    With ``measured`` what was written is the frame's size, which decides on broadcasts."""
    path = f"{_use_folder(df)}/kept-{uuid.uuid4().hex}"
    with _shuffles_end(df) as ending:
        ending.write.option("compression", "zstd").parquet(path)
    kept = df.sparkSession.read.schema(df.schema).parquet(path)
    if not measured:
        rows = kept._jdf.queryExecution().toRdd()
        kept = DataFrame(df.sparkSession._jsparkSession.internalCreateDataFrame(rows, kept._jdf.schema(), False), df.sparkSession)
    kept._kept_at = path
    return kept


def narrow(union: DataFrame) -> DataFrame:
    """As few partitions as a shuffle has. A union adds up those of its parts; in a loop that cuts lineage they would double."""
    return union.coalesce(int(union.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def forget(kept: DataFrame) -> None:
    """Delete the files that cut() or keep() wrote for this frame; nothing may read it afterwards. Loops forget what a round replaced, so the
    shared folder holds one round."""
    at = vars(kept).get("_kept_at")
    if at is None:
        file = kept._jdf.queryExecution().logical().rdd().getCheckpointFile()
        at = file.get() if file.isDefined() else None
    if at is not None:
        jvm, conf = kept.sparkSession._jvm, kept.sparkSession._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(conf).delete(path, True)
