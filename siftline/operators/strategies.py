"""General strategies: seeds merged into what is already stored."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from siftline import constants as K


def seed_strategies(spark: SparkSession) -> DataFrame:
    rows = [(i, *s) for i, s in enumerate(K.SEED_STRATEGIES)]
    return spark.createDataFrame(rows, "pos long, trigger string, tactic string, efficiency_gain string")


def merge_seeds(stored: DataFrame, seeds: DataFrame) -> DataFrame:
    """Stored strategies plus the seeds whose trigger is missing; stored rows come first, order kept."""
    cols = ["trigger", "tactic", "efficiency_gain"]
    known = stored.filter(F.coalesce("trigger", F.lit("")) != "").select("trigger").distinct()
    fresh = seeds.join(known, "trigger", "left_anti").select(F.lit(1).alias("seeded"), "pos", *cols)
    return stored.select(F.lit(0).alias("seeded"), "pos", *cols).unionByName(fresh)
