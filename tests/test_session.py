"""Kept frames: their rows, and what is left on disk."""

import os

from pyspark.sql import functions as F

from tracepath.plans import session


def shuffled(spark):
    return spark.range(20_000).groupBy((F.col("id") % 1999).alias("k")).agg(F.max("id").alias("m"))


def files(spark):
    return {f.getName() for f in (lambda a: [a.apply(i) for i in range(a.size())])(spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()) if f.getName().startswith("shuffle_")}


def test_shuffle_files_go_when_a_frame_is_cut(spark):
    before, setting = files(spark), spark.conf.get(session.CLEAN_UP, None)
    kept = session.cut(shuffled(spark))
    assert not files(spark) - before and kept.count() == 1999
    assert spark.conf.get(session.CLEAN_UP, None) == setting


def test_kept_frames_are_smaller_and_can_be_forgotten(spark):
    before = files(spark)
    df = shuffled(spark).select("k", "m", F.array(F.lit("root"), F.col("k").cast("string")).alias("path"))
    for measured in (False, True):
        kept = session.keep(df, measured)
        assert not files(spark) - before and sorted(kept.collect()) == sorted(df.collect()) and kept.dtypes == df.dtypes
        before = files(spark)
        at = kept._kept_at.removeprefix("file:")
        assert sum(os.path.getsize(f"{at}/{f}") for f in os.listdir(at)) < 60 * 1999
        session.forget(kept)
        assert not os.path.exists(at)
