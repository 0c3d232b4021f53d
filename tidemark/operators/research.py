"""Forecasts held against what happened: evaluation, calibration, accuracy by regime, contributions, drift, A/B runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .outcomes import r6
from .writes import written
from .scoring import bucket


def realised(net: Column, flat: float = 2.0) -> Column:
    return F.when(net > flat, "UP").when(net < -flat, "DOWN").otherwise("FLAT")


def predicted(up: str, down: str, flat: str) -> Column:
    """Ties: up before down before flat."""
    return F.when((F.col(up) >= F.col(down)) & (F.col(up) >= F.col(flat)), "UP").when(F.col(down) >= F.col(flat), "DOWN").otherwise("FLAT")


def evaluated(f: DataFrame) -> DataFrame:
    """Forecasts (up, down, flat, expected_move_pips, confidence, net_return_pips) with their errors and scores."""
    net, err = F.col("net_return_pips"), F.col("expected_move_pips") - F.col("net_return_pips")
    f = f.withColumns({"direction_predicted": predicted("up", "down", "flat"), "direction_actual": realised(net), "error": r6(err, 2), "abs_error": r6(F.abs(err), 2), "squared_error": r6(err * err, 4)})
    hit = F.col("direction_predicted") == F.col("direction_actual")
    brier = None
    for d in ("up", "down", "flat"):
        x = F.col(d) - F.when(F.col("direction_actual") == d.upper(), 1.0).otherwise(0.0)
        brier = x * x if brier is None else brier + x * x
    return f.withColumns(
        {
            "direction_accuracy": hit.cast("int"),
            "brier": r6(brier / 3),
            "calibration_error": r6(F.col("confidence") - hit.cast("int"), 6),
            "bucket": bucket(F.col("confidence")),
            "tradeability_success": hit & (F.abs(err) <= 0.5 * F.abs(net)),
        }
    )


def maturity(f: DataFrame, as_of: str) -> DataFrame:
    """Rows with status evaluated, outcome_unavailable (8 hours past expiry) or waiting."""
    late = F.col("expiry") + F.expr("interval 8 hours") <= F.lit(as_of).cast("timestamp_ntz")
    return f.withColumn("status", F.when(F.col("net_return_pips").isNotNull(), "evaluated").when(late, "outcome_unavailable").otherwise("waiting"))


def calibration(e: DataFrame) -> DataFrame:
    """Ten confidence buckets: n, observed rate, distance to the middle, whether there are ten rows."""
    spark = e.sparkSession
    g = e.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.avg("direction_accuracy").alias("rate"))
    all_ = spark.range(10).select(bucket(F.col("id") / 10 + 0.05).alias("bucket"), (F.col("id") / 10 + 0.05).alias("mid"))
    out = all_.join(g, "bucket", "left")
    out = out.withColumn("n", F.coalesce("n", F.lit(0)))
    return out.select("bucket", "n", r6(F.col("rate")).alias("observed_rate"), r6(F.abs(F.col("mid") - F.col("rate"))).alias("deviation"), (F.col("n") < 10).alias("insufficient"))


def overall(report: DataFrame) -> DataFrame:
    """The calibration score of a report: mean deviation of the buckets with enough rows, null if there are none."""
    return report.agg(r6(F.avg(F.when(~F.col("insufficient"), F.col("deviation")))).alias("overall"), F.count_if(~F.col("insufficient")).alias("buckets"))


def regime_accuracy(e: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """Accuracy in percent by regime, asset and direction, and its change against an earlier run."""
    keys = ["regime", "asset", "direction_predicted"]
    g = e.groupBy(*keys).agg(r6(100 * F.avg("direction_accuracy"), 2).alias("accuracy"), F.count(F.lit(1)).alias("n"))
    g = g.withColumns({"significant": F.col("n") >= 30, "underperforming": F.col("accuracy") < 40})
    if before is None:
        return g
    return g.join(before.select(*keys, F.col("accuracy").alias("_b")), keys, "left").withColumn("delta", r6(F.col("accuracy") - F.col("_b"), 2)).drop("_b")


def correlation(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Pearson's r by keys; 0 below two rows or without variance, within [-1, 1]."""
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(F.col(x) * F.col(y)).alias("sxy"), F.sum(F.col(x) * F.col(x)).alias("sxx"), F.sum(F.col(y) * F.col(y)).alias("syy"))
    vx, vy = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx"), F.col("n") * F.col("syy") - F.col("sy") * F.col("sy")
    ok = (F.col("n") >= 2) & (vx > 1e-9) & (vy > 1e-9)
    r = (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / F.sqrt(F.when(ok, vx * vy).otherwise(1.0))
    return g.select(*keys, "n", r6(F.when(ok, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))).otherwise(0.0)).alias("correlation"))


def contributions(e: DataFrame, matches: DataFrame) -> DataFrame:
    """A row for each evaluation and pipeline stage: contribution_score (the stage's correlation with accuracy over all rows), layer_dominant, marginal_accuracy_delta, is_low_confidence.

    e: evaluations with confidence, has_macro and has_sentiment; matches: the layer scores s1
    to s5 of their matches by rank. Similarity is told by an evaluation's mean match score,
    macro and sentiment by whether there was data, the other three by the confidence. The
    dominant layer (similarity only) is the highest of the first match, the first one on a
    tie; the delta (macro and sentiment only) is accuracy with data less accuracy without,
    null if either has no rows. Confidence is low where asset and regime have under ten rows.
    """
    top = F.array_max(F.array(*[F.struct(F.col(f"s{i}").alias("s"), F.lit(-i).alias("o")) for i in range(1, 6)]))
    m = matches.groupBy("fingerprint_id").agg(F.avg("score").alias("similarity"), F.max(F.when(F.col("rank") == 1, F.concat(F.lit("L"), -top["o"]))).alias("dominant"))
    few = F.count(F.lit(1)).over(Window.partitionBy("asset", "regime")) < 10
    e = e.join(m, "fingerprint_id", "left").withColumn("is_low_confidence", few)
    told = {"similarity": "similarity", "regime": "confidence", "macro": "has_macro", "sentiment": "has_sentiment", "confidence": "confidence", "outcome": "confidence"}
    kinds = F.array(*[F.struct(F.lit(s).alias("stage"), F.col(c).cast("double").alias("value")) for s, c in told.items()])
    long = e.select("fingerprint_id", "is_low_confidence", "dominant", F.col("direction_accuracy").cast("double").alias("hit"), F.inline(kinds))
    scores = correlation(long.where("value is not null"), ["stage"], "value", "hit").select("stage", F.col("correlation").alias("contribution_score"))
    deltas = None
    for s in ("macro", "sentiment"):
        one = marginal(e, F.col(f"has_{s}")).select(F.lit(s).alias("stage"), F.col("delta").alias("marginal_accuracy_delta"))
        deltas = one if deltas is None else deltas.union(one)
    out = long.join(F.broadcast(scores), "stage", "left").join(F.broadcast(deltas), "stage", "left")  # six and two rows
    dominant = F.when(F.col("stage") == "similarity", F.col("dominant"))
    return out.select("fingerprint_id", "stage", F.coalesce("contribution_score", F.lit(0.0)).alias("contribution_score"), dominant.alias("layer_dominant"), "marginal_accuracy_delta", "is_low_confidence")


def marginal(e: DataFrame, flag: Column) -> DataFrame:
    """Mean accuracy with and without a flag, and the difference (null if either has no rows)."""
    a, b = F.avg(F.when(flag, F.col("direction_accuracy"))), F.avg(F.when(~flag, F.col("direction_accuracy")))
    return e.agg(r6(a).alias("with_rate"), r6(b).alias("without_rate"), r6(a - b).alias("delta"))


def drift(e: DataFrame, key: str, order: list[str], window: int = 30, base: int = 100, sigmas: float = 2.0) -> DataFrame:
    """For each key the accuracy of the newest ``window`` rows against the mean and deviation of all full windows within the newest ``base`` rows."""
    rev = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
    newest = e.withColumn("_rn", F.row_number().over(rev)).where(F.col("_rn") <= base)
    w = Window.partitionBy(key).orderBy(F.col("_rn").desc()).rowsBetween(-(window - 1), 0)
    rows = newest.withColumns({"_acc": F.avg("direction_accuracy").over(w), "_n": F.count("direction_accuracy").over(w)})
    full = F.when(F.col("_n") == window, F.col("_acc"))
    g = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("_rn") == 1, full)).alias("rolling"), F.avg(full).alias("mean"), F.avg(full * full).alias("sq"))
    sd = F.sqrt(F.greatest(F.col("sq") - F.col("mean") * F.col("mean"), F.lit(0.0)))
    g = g.where(F.col("n") >= window).withColumn("sd", r6(sd))
    hit = (F.col("sd") > 0) & (F.col("rolling") < F.col("mean") - sigmas * F.col("sd"))
    off = F.when(F.col("sd") > 0, r6((F.col("mean") - F.col("rolling")) / F.when(F.col("sd") > 0, F.col("sd")).otherwise(1.0), 2)).otherwise(0.0)
    return g.select(key, "n", r6(F.col("rolling")).alias("rolling_accuracy"), r6(F.col("mean")).alias("baseline_mean"), F.col("sd").alias("baseline_std"), hit.alias("drifted"), off.alias("deviation"))


def compared(results: dict[str, DataFrame]) -> DataFrame:
    """By fingerprint_id what every version gives, and whether all agree."""
    out = None
    for v, one in results.items():
        one = one.select("fingerprint_id", F.lit(v).alias("version"), "result")
        out = one if out is None else out.unionByName(one)
    return out.groupBy("fingerprint_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("version", "result"))), lambda x: F.concat(x["version"], F.lit("="), x["result"])), ",").alias("results"), (F.count_distinct("result") == 1).alias("agree"))


def experiment(inputs: DataFrame, engines: dict) -> DataFrame:
    """Every engine (version to a function from DataFrame to DataFrame with fingerprint_id, result) over the same inputs, and whether all agree."""
    if len(engines) < 2:
        raise ValueError("an experiment compares two versions or more")
    return compared({v: f(inputs) for v, f in engines.items()})


def experiment_apart(inputs: DataFrame, engines: dict) -> tuple[DataFrame, dict[str, str]]:
    """``experiment`` with a job of its own for every version: the rows of those that did not fail, and the errors of the others."""
    if len(engines) < 2:
        raise ValueError("an experiment compares two versions or more")
    done, errors = {}, {}
    for v, f in engines.items():
        try:
            done[v] = written(f(inputs).select("fingerprint_id", "result"), "version")
        except Exception as e:  # whatever a version does, the others' rows are kept
            errors[v] = f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"
    if not done:
        raise ValueError(f"all versions failed: {errors}")
    return compared(done), errors
