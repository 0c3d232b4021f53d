"""Learned forecasts: boosted trees of three classes, isotonic calibration, exact contributions and occlusion effects."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .outcomes import r6
from .trees import TREE, Boosting, Forest, explained, fitted, probabilities

CLASSES = ("up", "down", "flat")


def label(net: Column) -> Column:
    """0 up, 1 down, 2 flat, by two pips."""
    return F.when(net > 2, 0).when(net < -2, 1).otherwise(2).cast("double")


def walk_forward(df: DataFrame, key: str, ts: str, share: float = 0.8) -> DataFrame:
    """is_train: the first rows of each key in time order."""
    w = Window.partitionBy(key).orderBy(ts)
    return df.withColumn("is_train", F.row_number().over(w) <= F.floor(share * F.count(F.lit(1)).over(Window.partitionBy(key))))


def staged(df: DataFrame, key: str, ts: str, train: float = 0.64, calibrate: float = 0.8) -> DataFrame:
    """part: train, then calibrate, then test, by shares of each key's rows in time order."""
    w = Window.partitionBy(key)
    at = F.row_number().over(w.orderBy(ts)) / F.count(F.lit(1)).over(w)
    return df.withColumn("part", F.when(at <= train, "train").when(at <= calibrate, "calibrate").otherwise("test"))


def kept(path: str, spark: SparkSession, train) -> Forest:
    """The model stored at path; if there is none, the one that ``train`` gives, stored there."""
    try:
        return Forest.of([tuple(r) for r in spark.read.schema(TREE).parquet(path).collect()])
    except AnalysisException as e:  # none yet
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    model = train()
    spark.createDataFrame(model.rows(), TREE).coalesce(1).write.mode("overwrite").parquet(path)
    return model


def trained(df: DataFrame, features: str, target: str, key: str, how: Boosting = Boosting()) -> Forest:
    """Boosted trees of the three classes, on the rows of df."""
    return fitted(df, features, target, F.col(key), how)


def predicted(df: DataFrame, model: Forest, features: str) -> DataFrame:
    """ml_up, ml_down, ml_flat, that add up to 1."""
    df = df.withColumn("_p", probabilities(features, model))
    return df.select(*[c for c in df.columns if c != "_p"], *[F.col("_p")[k].alias(f"ml_{n}") for k, n in enumerate(CLASSES)])


def metrics(df: DataFrame, target: str) -> DataFrame:
    """n, accuracy, recall of each class, and weighted_f1: the classes' F1 by their share of rows (0 for a class never hit)."""
    pred = F.when((F.col("ml_up") >= F.col("ml_down")) & (F.col("ml_up") >= F.col("ml_flat")), 0).when(F.col("ml_down") >= F.col("ml_flat"), 1).otherwise(2)
    df = df.select((pred == F.col(target)).alias("hit"), pred.alias("pred"), F.col(target).alias("y"))
    n = [F.count_if(F.col("y") == k) for k in range(3)]
    f1 = sum((n[k] * 2 * F.count_if(F.col("hit") & (F.col("y") == k)) / F.greatest(n[k] + F.count_if(F.col("pred") == k), F.lit(1)) for k in (1, 2)), n[0] * 2 * F.count_if(F.col("hit") & (F.col("y") == 0)) / F.greatest(n[0] + F.count_if(F.col("pred") == 0), F.lit(1)))
    recalls = [r6(F.avg(F.when(F.col("y") == k, F.col("hit").cast("double")))).alias(f"recall_{c}") for k, c in enumerate(CLASSES)]
    return df.agg(F.count(F.lit(1)).alias("n"), r6(F.avg(F.col("hit").cast("double"))).alias("accuracy"), r6(f1 / F.count(F.lit(1))).alias("weighted_f1"), *recalls)


def calibrators(df: DataFrame, target: str) -> list:
    """An isotonic model for each class's probability."""
    return [IsotonicRegression(featuresCol=f"ml_{n}", labelCol="y", predictionCol=f"cal_{n}").fit(df.withColumn("y", (F.col(target) == k).cast("double")).select(f"ml_{n}", "y")) for k, n in enumerate(CLASSES)]


def calibrated(df: DataFrame, models: list) -> DataFrame:
    """cal_up, cal_down, cal_flat: clipped, adding up to 1; as they were where the sum is 0."""
    df = PipelineModel(models).transform(df)
    total = reduce(lambda a, b: a + b, [F.col(f"cal_{n}") for n in CLASSES])
    return df.withColumns({f"cal_{n}": F.when(total > 0, F.col(f"cal_{n}") / F.when(total > 0, total).otherwise(1.0)).otherwise(F.col(f"ml_{n}")) for n in CLASSES})


def occlusion(df: DataFrame, model: Forest, features: str, key: str, top: int = 5) -> DataFrame:
    """The features whose neutral value changes the up probability most: an approximation of their contributions."""
    n = df.select(F.size(features)).first()[0]
    base = predicted(df.select(key, features), model, features).select(key, F.col("ml_up").alias("base"))
    hidden = df.select(key, F.posexplode(F.sequence(F.lit(0), F.lit(n - 1))).alias("feature", "_i"), features)
    hidden = hidden.withColumn(features, F.transform(features, lambda x, i: F.when(i == F.col("feature"), 0.5).otherwise(x)))
    out = predicted(hidden, model, features).join(base, key).withColumn("effect", r6(F.col("base") - F.col("ml_up")))
    w = Window.partitionBy(key).orderBy(F.abs("effect").desc(), "feature")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select(key, "rank", "feature", "effect")


def contributions(df: DataFrame, model: Forest, features: str, key: str, top: int = 5) -> DataFrame:
    """The features that move the margin of up most, by their exact Shapley values, with the base value and the margin that all of them lead to."""
    e = df.select(key, explained(features, model).alias("_e")).select(key, "_e.base", "_e.margin", F.posexplode("_e.effects").alias("feature", "effect"))
    e = e.withColumns({"effect": r6(F.col("effect")), "base": r6(F.col("base")), "margin": r6(F.col("margin"))})
    w = Window.partitionBy(key).orderBy(F.abs("effect").desc(), "feature")
    return e.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select(key, "rank", "feature", "effect", "base", "margin")
