"""Training runs on an enriched table: examples, split, fit, evaluation.

Examples are written to the shared folder with their part, drawn once, as partition
column. Training reads a part many times, by partition filter alone, and neither a new
draw nor a lost executor can change it.
"""

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.ml import PipelineModel
from pyspark.ml.feature import StringIndexerModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ontime.operators import evaluate, features, models, sampling
from ontime.sources import catalog, shared

# Shares of training and test rows, and of the on-time flights
# that stand against the delayed ones.
CLASS_SPLIT = [0.7, 0.3]
MINUTES_SPLIT = [0.8, 0.2]
ON_TIME_SHARE = 0.02


@dataclass
class Trained:
    """A fitted pipeline and its figures, which are measured when they are first asked for."""

    model: PipelineModel
    measure: Callable[[], dict[str, float | None]]

    @cached_property
    def metrics(self) -> dict[str, float | None]:
        return self.measure()


@dataclass
class Parts:
    """Training and test rows, and the flights whose categories they use."""

    flights: DataFrame
    training: DataFrame
    test: DataFrame
    labels: StringIndexerModel | None = None
    _fitted: dict[bool, StringIndexerModel] = field(default_factory=dict)

    def index(self, with_weather: bool) -> StringIndexerModel:
        """Category index of the whole table, fitted once for all training runs on these parts."""
        if with_weather not in self._fitted:
            self._fitted[with_weather] = features.fit_domain_index(self.flights, features.categories(with_weather))
        return self._fitted[with_weather]


def _parts(flights: DataFrame, examples: DataFrame, weights: list[float], seed: int) -> Parts:
    path = shared.new_folder(flights.sparkSession, "examples")
    drawn = examples.withColumn("part", sampling.draw_part(weights, seed))
    drawn.write.partitionBy("part").parquet(path)
    written = flights.sparkSession.read.schema(drawn.schema).parquet(path)
    return Parts(flights, *(written.where(F.col("part") == k).drop("part") for k in range(len(weights))))


def delay_parts(flights: DataFrame, on_time_share: float = ON_TIME_SHARE, seed: int = 1) -> Parts:
    """Parts for delay yes or no: all delayed flights, a share of the others."""
    examples = features.delay_examples(flights)
    if on_time_share < 1:
        examples = sampling.balance(examples, "label", {1: 1.0, 0: on_time_share}, seed)
    return _parts(flights, examples, CLASS_SPLIT, seed)


def minutes_parts(flights: DataFrame, seed: int = 10) -> Parts:
    """Parts for the length of a delay."""
    return _parts(flights, features.minutes_examples(flights), MINUTES_SPLIT, seed)


def bucket_parts(flights: DataFrame, buckets=None, seed: int = 1) -> Parts:
    """Parts for the bucket of a delay, with the label index of all examples."""
    parts = _parts(flights, features.bucket_examples(flights, buckets), CLASS_SPLIT, seed)
    parts.labels = features.fit_label_index(parts.training.unionByName(parts.test), "delayCat")
    return parts


def train_delay(parts: Parts, kind: str = "logistic", with_weather: bool = True) -> Trained:
    """Delay yes or no by "forest", "logistic" or a "grid" of the latter; without examples, there are no figures."""
    index = parts.index(with_weather)
    if kind == "forest":
        model = models.fit_delay_forest(parts.training, with_weather, index)
    elif kind == "logistic":
        model = models.fit_delay_logistic(parts.training, with_weather, index)
    elif kind == "grid":
        model, validated = models.cross_validate(parts.training, with_weather, index)
    else:
        raise ValueError(f"kind must be 'forest', 'logistic' or 'grid', not {kind!r}")

    def measure() -> dict[str, float]:
        if not models.is_trained(model):
            return {}
        made = model.transform(parts.test)
        metrics = {
            "auroc": evaluate.auroc(made),
            "auroc_hard_label": evaluate.auroc(made, "prediction"),
        }
        if kind != "forest":
            metrics["training_auroc"] = evaluate.training_auroc(model)
        if kind == "grid":
            for params, value in zip(validated.getEstimatorParamMaps(), validated.avgMetrics):
                given = {param.name: setting for param, setting in params.items()}
                name = f"cv_auroc reg={given['regParam']} net={given['elasticNetParam']}"
                metrics[name] = value
        return metrics

    return Trained(model, measure)


def train_minutes(parts: Parts, kind: str = "linear") -> Trained:
    """Length of a delay by "linear" regression or "forest"."""
    index = parts.index(True)
    if kind == "linear":
        model = models.fit_minutes_linear(parts.training, index)
    elif kind == "forest":
        model = models.fit_minutes_forest(parts.training, index)
    else:
        raise ValueError(f"kind must be 'linear' or 'forest', not {kind!r}")

    def measure() -> dict[str, float]:
        metrics = evaluate.minutes_errors(model.transform(parts.test)).first().asDict()
        if kind == "linear":
            metrics |= evaluate.training_fit(model)
        return metrics

    return Trained(model, measure)


def train_buckets(
    parts: Parts,
    with_weather: bool = True,
    num_trees: int = models.FOREST_TREES,
    max_depth: int = models.FOREST_DEPTH,
) -> Trained:
    """Bucket of a delay by random forest."""
    index = parts.index(with_weather)
    model = models.fit_bucket_forest(
        parts.training, with_weather, index, num_trees, max_depth, labels=parts.labels
    )

    def measure() -> dict[str, float]:
        return evaluate.accuracy(model.transform(parts.test), "delayCat", "predictedLabel").first().asDict()

    return Trained(model, measure)


def bucket_experiment(
    spark: SparkSession, flights: DataFrame, log: str, run: str, num_trees: int, max_depth: int, path: str
) -> Trained:
    """Train a bucket forest, save it and append its figures to the log table."""
    trained = train_buckets(bucket_parts(flights), True, num_trees, max_depth)
    catalog.save_model(trained.model, path)
    params = {"num_trees": num_trees, "max_depth": max_depth}
    catalog.log_metrics(spark, log, run, params, trained.metrics)
    return trained
