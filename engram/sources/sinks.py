"""Summaries, gathered while what they sum up is written."""

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from engram.functions.text import CATEGORIES

NAMES = [*CATEGORIES.values(), "Unknown"]


class Totals:
    """What is observed of rows while they are written; ``of`` may be read then."""

    def __init__(self, names: list[str]):
        self.names, self.seen = names, Observation()

    @property
    def of(self) -> dict:
        """By name; None for all where Spark found out that there are no rows and dropped the observation."""
        row = self.seen._jo.getRow()
        return self.seen.get if row.schema() is not None else dict.fromkeys(self.names)


def observed(rows: DataFrame, **totals: Column) -> tuple[DataFrame, Totals]:
    """The rows, and the totals that will be known as soon as they were written; no scan of its own."""
    t = Totals([*totals])
    return rows.observe(t.seen, *[c.alias(name) for name, c in totals.items()]), t


def token_totals() -> dict[str, Column]:
    """Number, mean and deviation of f1 and bleu1: overall, and for each of the few categories (category_name)."""
    out = {}
    for i, name in enumerate([None, *NAMES]):
        here = F.lit(True) if name is None else F.col("category_name") == name
        out[f"n_{i}"] = F.count_if(here)
        for m in ("f1", "bleu1"):
            of = F.when(here, F.col(m))
            out |= {f"{m}_mean_{i}": F.avg(of), f"{m}_std_{i}": F.stddev_samp(of)}
    return out


def token_summary(seen: dict) -> dict:
    """What ``token_totals`` have gathered: overall metrics, and ``per_category`` in order of name; without rows all are 0."""

    def of(i: int) -> dict:
        return {"n": seen[f"n_{i}"] or 0, **{f"{m}_{what}": round(seen[f"{m}_{what}_{i}"] or 0.0, 9) for m in ("f1", "bleu1") for what in ("mean", "std")}}

    parts = [{"category": name, **of(i)} for i, name in enumerate(NAMES, 1) if seen[f"n_{i}"]]
    return {**of(0), "per_category": sorted(parts, key=lambda x: x["category"])}


SCORES = "n BIGINT, f1_mean DOUBLE, f1_std DOUBLE, bleu1_mean DOUBLE, bleu1_std DOUBLE"


def write_summary(spark: SparkSession, path: str, totals: dict, kinds: str, parameters: dict) -> DataFrame:
    """One JSON document: the totals (of the given columns) and the parameters. What grows with the input, as failed graphs, is rows elsewhere."""
    row = spark.createDataFrame([{**totals, "parameters": {k: str(v) for k, v in sorted(parameters.items())}}], f"{kinds}, parameters MAP<STRING, STRING>")
    row.coalesce(1).write.mode("overwrite").json(path)
    return row
