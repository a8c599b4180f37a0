"""Model evaluation."""

from pyspark.ml import PipelineModel
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ontime.functions.columns import log10_minutes, minutes_from_log10
from ontime.operators.models import is_trained
from ontime.sources.shared import materialize


def auroc(predictions: DataFrame, score: str = "rawPrediction", label: str = "label") -> float:
    """Area under the ROC curve of a score column.

    The raw score ranks flights finely. With ``score="prediction"`` only the
    predicted class counts, which gives another, coarser figure: name the score
    when comparing models. Every distinct score is a threshold.
    """
    return BinaryClassificationEvaluator(
        rawPredictionCol=score, labelCol=label, numBins=0
    ).evaluate(predictions)


def hit_rate(label: Column, prediction: Column) -> Column:
    """Share of correct predictions, as an aggregate."""
    return F.avg(F.when(label == prediction, 1.0).otherwise(0.0))


def root_mean_square(actual: Column, predicted: Column) -> Column:
    """Root mean square error, as an aggregate."""
    return F.sqrt(F.avg(F.pow(actual - predicted, F.lit(2.0))))


def accuracy(
    predictions: DataFrame, label: str = "label", prediction: str = "prediction"
) -> DataFrame:
    """One row: share of correct predictions, and the test error."""
    hit = hit_rate(F.col(label), F.col(prediction))
    return predictions.agg(hit.alias("accuracy"), (1 - hit).alias("test_error"))


def rmse(predictions: DataFrame, actual: str, prediction: str = "prediction") -> DataFrame:
    """One row: root mean square error."""
    return predictions.agg(root_mean_square(F.col(actual), F.col(prediction)).alias("rmse"))


def rmse_minutes(
    predictions: DataFrame, actual: str = "WeatherDelay", prediction: str = "prediction"
) -> DataFrame:
    """One row: root mean square error in minutes of a prediction of log10."""
    minutes = minutes_from_log10(F.col(prediction))
    return predictions.agg(root_mean_square(F.col(actual), minutes).alias("rmse_minutes"))


def minutes_errors(
    predictions: DataFrame, actual: str = "WeatherDelay", prediction: str = "prediction"
) -> DataFrame:
    """One row: error of log10 minutes against log10, and in minutes."""
    minutes, guess = F.col(actual), F.col(prediction)
    return predictions.agg(
        root_mean_square(log10_minutes(minutes), guess).alias("rmse_log10"),
        root_mean_square(minutes, minutes_from_log10(guess)).alias("rmse_minutes"),
    )


def training_fit(model: PipelineModel) -> dict[str, float | None]:
    """Error and r2 of a linear regression on its training examples, if there were any."""
    if not is_trained(model):
        return {"training_rmse": None, "training_r2": None}
    summary = model.stages[-1].summary
    return {"training_rmse": summary.rootMeanSquaredError, "training_r2": summary.r2}


def training_auroc(model: PipelineModel) -> float:
    """Area under the training ROC curve of a logistic regression."""
    return model.stages[-1].summary.areaUnderROC


def roc_curve(model: PipelineModel) -> DataFrame:
    """Training ROC curve of a logistic regression: columns FPR and TPR.

    Spark thins this curve to about a thousand points; :func:`roc_points` is exact. Without examples, there are none.
    """
    if not is_trained(model):
        return SparkSession.active().createDataFrame([], "FPR double, TPR double")
    return model.stages[-1].summary.roc


def roc_points(predictions: DataFrame, score: str, label: str = "label") -> DataFrame:
    """Exact ROC curve: threshold, FPR and TPR of every distinct score.

    Scores are counted, dealt by range and numbered within each range; the counts
    of the higher ranges, one row each, are added. No task sees all scores.
    """
    good, bad = F.col(label) == 1, F.col(label) != 1
    counts = predictions.groupBy(F.col(score).cast("double").alias("threshold")).agg(
        F.count_if(good).alias("p"), F.count_if(bad).alias("n")
    )
    ranged = counts.repartitionByRange(F.desc("threshold")).withColumn("part", F.spark_partition_id())
    ranged = materialize(ranged, "scores")
    parts = ranged.groupBy("part").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    higher = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    before = parts.select(
        "part",
        *[F.coalesce(F.sum(c).over(higher), F.lit(0)).alias(f"{c}_before") for c in "pn"],
        *[F.sum(c).over(whole).alias(f"{c}_all") for c in "pn"],
    )
    down = Window.partitionBy("part").orderBy(F.desc("threshold"))
    return ranged.join(before, "part").select(
        "threshold",
        F.try_divide(F.col("n_before") + F.sum("n").over(down), F.col("n_all")).alias("FPR"),
        F.try_divide(F.col("p_before") + F.sum("p").over(down), F.col("p_all")).alias("TPR"),
    )
