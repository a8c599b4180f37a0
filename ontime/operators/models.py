"""Delay models: yes or no, bucket, minutes, clusters, and their tuning."""

import warnings

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import SQLTransformer, StringIndexerModel, VectorAssembler
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ontime.functions.columns import log10_minutes, minutes_from_log10, or_zero
from ontime.operators.features import (
    categories,
    delay_pipeline,
    feature_stages,
    fit_domain_index,
    fit_label_index,
    label_decoder,
)
from ontime.sources.shared import materialize

# Settings of the models.
LOGISTIC_ITERATIONS = 10
FOREST_TREES = 10
FOREST_DEPTH = 10
FOREST_BINS = 500
GRID_REG_PARAM = [0.001, 0.01, 0.1]
GRID_ELASTIC_NET = [0.0, 0.5, 1.0]
CLUSTER_SEED = 1


def untrained(**outputs: str) -> PipelineModel:
    """The model of no examples: it predicts NULL, in columns given with their types."""
    unknown = ", ".join(f"cast(null as {kind}) as {name}" for name, kind in outputs.items())
    return PipelineModel(stages=[SQLTransformer(statement=f"select *, {unknown} from __THIS__")])


def is_trained(model: PipelineModel) -> bool:
    """Whether a fitted model has seen examples: it then has feature stages."""
    return len(model.stages) > 1


def _without(examples: DataFrame, after=()) -> PipelineModel | None:
    """The model that is left if there are no examples."""
    if not examples.isEmpty():
        return None
    warnings.warn("no examples to fit a model on: it predicts NULL")
    return untrained(prediction="double", **{stage.getOutputCol(): "string" for stage in after})


def _fit(estimator, examples: DataFrame, with_weather: bool, domain, before=(), after=()):
    if nothing := _without(examples, after):
        return nothing
    domain = domain or fit_domain_index(examples, categories(with_weather))
    return delay_pipeline(estimator, domain, with_weather, before, after).fit(examples)


def fit_delay_forest(
    examples: DataFrame, with_weather: bool, domain: StringIndexerModel | None = None, seed: int = 1
) -> PipelineModel:
    """Random forest for delay yes or no.

    ``domain`` is the category index of the whole table; without it, the index
    covers the examples only.
    """
    return _fit(RandomForestClassifier(seed=seed), examples, with_weather, domain)


def fit_delay_logistic(
    examples: DataFrame, with_weather: bool, domain: StringIndexerModel | None = None, **params
) -> PipelineModel:
    """Logistic regression for delay yes or no."""
    params = {"maxIter": LOGISTIC_ITERATIONS} | params
    return _fit(LogisticRegression(**params), examples, with_weather, domain)


def fit_bucket_forest(
    examples: DataFrame,
    with_weather: bool,
    domain: StringIndexerModel | None = None,
    num_trees: int = FOREST_TREES,
    max_depth: int = FOREST_DEPTH,
    seed: int = 1,
    labels: StringIndexerModel | None = None,
) -> PipelineModel:
    """Random forest for the delay bucket, with the label it predicts."""
    labels = labels or fit_label_index(examples, "delayCat")
    forest = RandomForestClassifier(
        labelCol=labels.getOutputCol(),
        numTrees=num_trees,
        maxDepth=max_depth,
        maxBins=FOREST_BINS,
        seed=seed,
    )
    return _fit(forest, examples, with_weather, domain, [labels], [label_decoder(labels)])


def fit_minutes_linear(
    examples: DataFrame, domain: StringIndexerModel | None = None
) -> PipelineModel:
    """Linear regression for log10 of the delay."""
    return _fit(LinearRegression(labelCol="LogWeatherDelay"), examples, True, domain)


def fit_minutes_forest(
    examples: DataFrame, domain: StringIndexerModel | None = None, seed: int = 1
) -> PipelineModel:
    """Random-forest regression for log10 of the delay."""
    forest = RandomForestRegressor(labelCol="LogWeatherDelay", seed=seed)
    return _fit(forest, examples, True, domain)


def _minute_counts(flights: DataFrame) -> DataFrame:
    """(log, flights): log10 of each different delay, 0 where there is none, with its number of flights."""
    return flights.groupBy(or_zero(log10_minutes(F.col("WeatherDelay"))).alias("log")).agg(
        F.count("*").cast("double").alias("flights")
    )


def _log_delay_weights(flights: DataFrame) -> DataFrame:
    """log10 of the delay (0 where there is none) with its number of flights.

    Clustering weighted values equals clustering every flight, and there are
    only as many values as different minutes. Dealing them by range and sorting
    them makes the initial draw repeatable.
    """
    points = VectorAssembler(inputCols=["log"], outputCol="features").transform(_minute_counts(flights))
    return points.repartitionByRange("log").sortWithinPartitions("log")


def fit_delay_clusters(
    flights: DataFrame, k: int, seed: int = CLUSTER_SEED
) -> KMeansModel | None:
    """k-means on log10 of the delay; without flights, there is no model."""
    if flights.isEmpty():
        return None
    return _fit_clusters(_log_delay_weights(flights), k, seed)


def _fit_clusters(points: DataFrame, k: int, seed: int) -> KMeansModel:
    return KMeans(k=k, seed=seed, weightCol="flights").fit(points)


def elbow(flights: DataFrame, ks=range(2, 10), seed: int = CLUSTER_SEED) -> DataFrame:
    """Sum of squared distances to the centres for each number of clusters, if there are flights."""
    if flights.isEmpty():
        ks = ()
    points = _log_delay_weights(flights).persist()
    try:
        costs = [(k, float(_fit_clusters(points, k, seed).summary.trainingCost)) for k in ks]
    finally:
        points.unpersist()
    return flights.sparkSession.createDataFrame(costs, "k int, cost double")


#: Different minutes that exact clustering takes. They are whole and fit a field of four digits.
EXACT_MINUTES = 20_000


def exact_elbow(flights: DataFrame, most: int = 9) -> DataFrame:
    """The least possible sum of squared distances for 1 to ``most`` clusters, and the centres: k, cost, centres.

    Clusters on a line are intervals, so dynamic programming over the sorted minutes is exact: the
    best k clusters of the first values are the best k - 1 of fewer and one more interval, whose cost follows from
    running sums. The table of different minutes with their flights, which is all that it needs, must
    have no more than ``EXACT_MINUTES`` rows. Use it to judge what k-means arrives at.
    """
    counts = _minute_counts(flights).limit(EXACT_MINUTES + 1).toPandas().sort_values("log")
    if len(counts) > EXACT_MINUTES:
        raise ValueError(f"more than {EXACT_MINUTES} different delays")
    found = interval_clusters(counts["log"].to_numpy(), counts["flights"].to_numpy(), most)
    return flights.sparkSession.createDataFrame(found, "k int, cost double, centres array<double>")


def interval_clusters(values: np.ndarray, weights: np.ndarray, most: int) -> list[tuple[int, float, list[float]]]:
    """(k, cost, centres) of the best intervals of sorted values, for each k up to the number of values."""
    n = len(values)
    # Distances are from the mean, so that the differences of sums below keep their digits.
    middle = np.average(values, weights=weights) if n else 0.0
    moments = np.stack([weights, weights * (values - middle), weights * (values - middle) ** 2])
    sums = np.concatenate([np.zeros((3, 1)), np.cumsum(moments, 1)], 1)

    def costs(first: np.ndarray, end: int) -> np.ndarray:
        """Squared distances to the mean from each first place up to the end."""
        w, x, xx = sums[:, end, None] - sums[:, first]
        return np.maximum(xx - x * x / w, 0.0)

    best = np.array([0.0] + [costs(np.array([0]), end)[0] for end in range(1, n + 1)])
    cuts, found = [np.zeros(n + 1, int)], []
    for k in range(1, min(most, n) + 1):
        if k > 1:
            longer, cut = np.full(n + 1, np.inf), np.zeros(n + 1, int)
            for end in range(k, n + 1):
                first = np.arange(k - 1, end)
                total = best[first] + costs(first, end)
                longer[end], cut[end] = total.min(), first[total.argmin()]
            best = longer
            cuts.append(cut)
        centres, end = [], n
        for cut in reversed(cuts):
            w, x, _ = sums[:, end] - sums[:, cut[end]]
            centres.append(float(middle + x / w))
            end = cut[end]
        found.append((k, float(best[n]), centres[::-1]))
    return found


def cluster_minutes(model: KMeansModel | None, spark) -> DataFrame:
    """Cluster centres back in minutes, smallest first; none without a model."""
    centres = [(float(centre[0]),) for centre in model.clusterCenters()] if model else []
    return (
        spark.createDataFrame(centres, "log10_value double")
        .withColumn("minutes", minutes_from_log10(F.col("log10_value")))
        .orderBy("log10_value")
    )


def centre_cost(flights: DataFrame, centres: list[float]) -> DataFrame:
    """One row: sum of squared distances of log10 of the delays to the nearest of the centres."""
    squares = F.transform(F.array(*map(F.lit, centres)).cast("array<double>"), lambda centre: F.pow(F.col("log") - centre, F.lit(2.0)))
    return _minute_counts(flights).agg(F.sum(F.col("flights") * F.array_min(squares)).alias("cost"))


def logistic_grid(logistic: LogisticRegression) -> list:
    """The nine combinations of regularisation to try."""
    return (
        ParamGridBuilder()
        .addGrid(logistic.regParam, GRID_REG_PARAM)
        .addGrid(logistic.elasticNetParam, GRID_ELASTIC_NET)
        .build()
    )


def fold_of_row(folds: int, columns: list[str]) -> Column:
    """A fold, from 0, by a hash of the row, so that rows keep their fold on any layout; equal rows stay together."""
    return F.pmod(F.xxhash64(F.lit("fold"), *columns), F.lit(folds)).cast("int")


def cross_validate(
    examples: DataFrame,
    with_weather: bool = True,
    domain: StringIndexerModel | None = None,
    estimator: LogisticRegression | None = None,
    grid: list | None = None,
    folds: int = 3,
    parallelism: int = 3,
) -> tuple[PipelineModel, CrossValidatorModel | None]:
    """Best logistic regression of a grid by area under ROC.

    Feature stages learn nothing from a fold, so they run once: vectors are written with their fold, and every
    fit and evaluation reads those. Gives the whole pipeline with the best model, and
    the validation itself with its metrics; there is none without examples.
    """
    if nothing := _without(examples):
        return nothing, None
    domain = domain or fit_domain_index(examples, categories(with_weather))
    estimator = estimator or LogisticRegression(maxIter=LOGISTIC_ITERATIONS)
    features = Pipeline(stages=feature_stages(domain, with_weather)).fit(examples)
    vectors = features.transform(examples).select(
        "features", "label", fold_of_row(folds, examples.columns).alias("fold")
    )
    validated = CrossValidator(
        estimator=estimator,
        estimatorParamMaps=grid or logistic_grid(estimator),
        evaluator=BinaryClassificationEvaluator(numBins=0),
        numFolds=folds,
        foldCol="fold",
        parallelism=parallelism,
    ).fit(materialize(vectors, "vectors"))
    return PipelineModel(stages=[*features.stages, validated.bestModel]), validated
