"""Answer scoring and rollups."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engram.functions.text import category_name, common_tokens, tokens


def token_scores(pairs: DataFrame) -> DataFrame:
    """f1 and bleu1 of (id, prediction, reference) by multiset overlap of tokens. The formulas are those of the benchmark."""
    t = pairs.withColumns({"p": tokens(F.col("prediction")), "r": tokens(F.col("reference"))})
    t = t.withColumns({"np": F.size("p"), "nr": F.size("r"), "o": common_tokens(F.col("p"), F.col("r"))})
    f1 = F.when((F.col("np") == 0) & (F.col("nr") == 0), 1.0).when(F.col("o") == 0, 0.0).otherwise(2.0 * F.col("o") / (F.col("np") + F.col("nr")))
    short = F.when(F.col("np") < F.col("nr"), F.exp(1 - F.col("nr") / F.col("np"))).otherwise(1.0)
    bleu = F.when((F.col("np") == 0) | (F.col("nr") == 0), 0.0).otherwise(short * F.col("o") / F.col("np"))
    return t.withColumns({"f1": f1, "bleu1": bleu}).drop("p", "r", "np", "nr", "o", "prediction", "reference")


def summary(scored: DataFrame, *by: str) -> DataFrame:
    out = [F.count("*").alias("n")]
    for m in ("f1", "bleu1"):
        out += [F.round(F.coalesce(F.avg(m), F.lit(0.0)), 9).alias(f"{m}_mean"), F.round(F.coalesce(F.stddev_samp(m), F.lit(0.0)), 9).alias(f"{m}_std")]
    return scored.groupBy(*by).agg(*out)


def by_category(scored: DataFrame, category: str = "category") -> DataFrame:
    """The summary of each category, by its name."""
    return summary(scored.withColumn("category", category_name(F.col(category))), "category")


def running(scored: DataFrame, key: str, order: str, metric: str, name: str) -> DataFrame:
    """The mean of a metric over a key's rows so far."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return scored.withColumn(name, F.round(F.avg(metric).over(w), 9))


def encode_totals(turns: DataFrame, key: str) -> DataFrame:
    """Graphs, nodes and characters of encoded turns, in one row."""
    n_chars = F.sum(F.length("user_text") + F.length("ai_text")).cast("long")
    return turns.agg(F.countDistinct(key).alias("n_graphs"), F.count("*").alias("n_nodes"), n_chars.alias("n_chars"))


def accuracy(judged: DataFrame) -> DataFrame:
    """Per question type and overall (null type), in percent."""
    return judged.rollup("question_type").agg(F.count("*").alias("n"), F.sum("correct").alias("n_correct"), F.round(F.coalesce(F.try_divide(F.sum("correct") * 100.0, F.count("*")), F.lit(0.0)), 6).alias("accuracy"))
