"""Batch scoring of flight requests."""

from pyspark.ml import PipelineModel
from pyspark.ml.feature import OneHotEncoderModel, SQLTransformer, StringIndexerModel, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ontime import schemas
from ontime.functions.columns import minutes_from_log10, strip, to_double
from ontime.operators.models import is_trained, untrained
from ontime.operators.rejects import Counted, watched

REQUEST = "request"
RESULT = "result"

# While a request is read: its parts, and what they hold.
_PARTS, _READ = "request_parts", "request_read"

_TEXT_INPUTS = {"UniqueCarrier", "Origin", "Dest", "MaxPresentWeatherCode"}


def parse_requests(requests: DataFrame, on_bad: str = "drop", counted: Counted | None = None) -> DataFrame:
    """Inputs from comma-separated requests of 7 or 13 values.

    Seven values name the flight only: the weather is then NULL. A request of
    another length or with text in a numeric place is bad: it is dropped, or
    marked in a column ``valid`` when ``on_bad`` is "keep". ``counted`` gets the number of requests and of bad ones.

    A request is split once: Spark would repeat the split in each value and in the test of the row, which it
    pushes below them, but not through the explode.
    """
    names = schemas.FLIGHT_INPUTS + schemas.WEATHER_INPUTS
    short, full = len(schemas.FLIGHT_INPUTS), len(names)
    values = []
    for place, name in enumerate(names):
        text = strip(F.get(F.col(_PARTS), F.lit(place)))
        values.append((text if name in _TEXT_INPUTS else to_double(text)).alias(name))
    read = F.struct(F.size(_PARTS).alias("size"), *values)
    split = requests.withColumn(_PARTS, F.split(F.col(REQUEST), ","))
    split = split.withColumn(_READ, F.explode(F.array(read)))
    size, inputs = F.col(f"{_READ}.size"), {name: F.col(f"{_READ}.{name}") for name in names}
    valid = size.isin(short, full)
    for place, name in enumerate(names):
        if name not in _TEXT_INPUTS:
            given = inputs[name].isNotNull()
            valid = valid & (given if place < short else given | (size == short))
    parsed = split.withColumns(inputs | {"valid": valid}).drop(_PARTS, _READ)
    parsed = watched(parsed, F.col("valid"), counted)
    if on_bad == "keep":
        return parsed
    if on_bad == "drop":
        return parsed.where("valid").drop("valid")
    raise ValueError(f"on_bad must be 'drop' or 'keep', not {on_bad!r}")


def fill_missing_weather(requests: DataFrame) -> DataFrame:
    """Requests with unknown weather replaced by the missing codes."""
    return requests.withColumns(
        {
            name: F.coalesce(F.col(name), F.lit(code).cast("string" if name in _TEXT_INPUTS else "double"))
            for name, code in schemas.WEATHER_INPUT_DEFAULTS.items()
        }
    )


def combine_stages(delayed: Column, log_minutes: Column) -> Column:
    """0 for a flight predicted on time, otherwise the predicted minutes."""
    return F.when(delayed == 1, minutes_from_log10(log_minutes)).otherwise(0.0)


def _feature_pass(model: PipelineModel) -> list:
    """The stages that make ``features``, up to the assembler."""
    last = max(i for i, stage in enumerate(model.stages) if isinstance(stage, VectorAssembler))
    return model.stages[: last + 1]


def _settings(stage) -> dict:
    """What a feature stage does: the parameters that were set, and what an index or an encoder has learned."""
    settings = {param.name: stage.getOrDefault(param) for param in stage.params if stage.isSet(param)}
    if isinstance(stage, StringIndexerModel):
        settings["labels"] = [list(labels) for labels in stage.labelsArray]
    if isinstance(stage, OneHotEncoderModel):
        settings["sizes"] = list(stage.categorySizes)
    return settings


def same_features(one: PipelineModel, other: PipelineModel) -> bool:
    """Whether two models see a request as the same vector; a model of no examples looks at none."""
    if not (is_trained(one) and is_trained(other)):
        return True
    first, second = _feature_pass(one), _feature_pass(other)
    return [type(x) for x in first] == [type(x) for x in second] and all(
        _settings(x) == _settings(y) for x, y in zip(first, second)
    )


def _predictor(model: PipelineModel, **names: str):
    """The fitted predictor of a pipeline, a copy that writes to columns of its own."""
    predictor = model.stages[-1].copy()
    for param, name in names.items():
        predictor._set(**{param: name})
    return predictor


def two_stage(classifier: PipelineModel, regressor: PipelineModel) -> PipelineModel:
    """Both models as one, which indexes, encodes and assembles a request once.

    It adds ``predicted_delay`` and ``result`` and is saved and loaded like any model. The two must see a request as
    the same vector: fit them on parts of one table, with the category index of that table. What a model of no examples
    would have to tell is NULL.
    """
    if not same_features(classifier, regressor):
        raise ValueError("the models were fitted on different features")
    if not is_trained(classifier):
        return untrained(predicted_delay="double", **{RESULT: "double"})
    classes = _predictor(
        classifier, predictionCol="predicted_delay", rawPredictionCol="delay_scores", probabilityCol="delay_chances"
    )
    if is_trained(regressor):
        minutes = _predictor(regressor, predictionCol="log_minutes")
    else:
        minutes = untrained(log_minutes="double").stages[0]
    result = f"case when predicted_delay = 1 then pow(10.0D, log_minutes) else 0.0D end as {RESULT}"
    combined = SQLTransformer(statement=f"select *, {result} from __THIS__")
    return PipelineModel(stages=[*_feature_pass(classifier), classes, minutes, combined])


def score_two_stage(requests: DataFrame, model: PipelineModel) -> DataFrame:
    """Expected weather delay of each request, in minutes, as ``result``."""
    return model.transform(requests).select(*requests.columns, "predicted_delay", RESULT)


def score(requests: DataFrame, classifier: PipelineModel, regressor: PipelineModel) -> DataFrame:
    """The same from two models; where they see a request alike, its features are made once.

    Otherwise both share the names of their intermediate columns, so only the class is kept from the first one.
    """
    if same_features(classifier, regressor):
        return score_two_stage(requests, two_stage(classifier, regressor))
    kept = requests.columns
    classed = classifier.transform(requests).select(
        *kept, F.col("prediction").alias("predicted_delay")
    )
    return regressor.transform(classed).select(
        *kept,
        "predicted_delay",
        combine_stages(F.col("predicted_delay"), F.col("prediction")).alias(RESULT),
    )
