"""Feature engineering: training frames, category indexes, vector assembly."""

from pyspark.ml import Pipeline
from pyspark.ml.feature import (
    IndexToString,
    OneHotEncoder,
    StringIndexer,
    StringIndexerModel,
    VectorAssembler,
)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontime import schemas
from ontime.functions.columns import delay_bucket, log10_minutes
from ontime.operators.reports import delayed, drop_null

FLIGHT_CATEGORIES = ["UniqueCarrier", "Origin", "Dest"]
WEATHER_CATEGORY = "MaxPresentWeatherCode"

_KEY = ["Year"] + schemas.FLIGHT_INPUTS


def _index(column: str) -> str:
    return column + "Index"


def _one_hot(column: str) -> str:
    return column + "OneHot"


def fill_sentinels(table: DataFrame) -> DataFrame:
    """Unknown weather inputs replaced by their missing codes.

    The weather code is left as it is: NULL has an index of its own.
    """
    filled = {
        name: F.coalesce(F.col(name), F.lit(code))
        for name, code in schemas.WEATHER_INPUT_DEFAULTS.items()
        if name != WEATHER_CATEGORY and name in table.columns
    }
    return table.withColumns(filled)


def delay_examples(flights: DataFrame) -> DataFrame:
    """Examples of flights with (label 1) and without (0) weather delay.

    Flights with unknown delay or weather are left out. One scan labels both
    classes.
    """
    known = drop_null(flights, [c for c in schemas.WEATHER_INPUTS if c != "MaxPrecipitation48"])
    return fill_sentinels(
        known.where(F.col("WeatherDelay") >= 0).select(
            *_KEY,
            *schemas.WEATHER_INPUTS,
            F.when(F.col("WeatherDelay") > 0, 1).otherwise(0).alias("label"),
        )
    )


def minutes_examples(flights: DataFrame) -> DataFrame:
    """Examples of the length of a weather delay, in minutes and as log10."""
    known = drop_null(delayed(flights), [WEATHER_CATEGORY])
    return fill_sentinels(known).select(
        *_KEY,
        *schemas.WEATHER_INPUTS,
        log10_minutes(F.col("WeatherDelay")).alias("LogWeatherDelay"),
        "WeatherDelay",
    )


def bucket_examples(flights: DataFrame, buckets=None) -> DataFrame:
    """Examples of the bucket that a weather delay falls into."""
    return fill_sentinels(delayed(flights)).select(
        *_KEY,
        *schemas.WEATHER_INPUTS,
        delay_bucket(F.col("WeatherDelay"), buckets).alias("delayCat"),
    )


def categories(with_weather: bool) -> list[str]:
    return FLIGHT_CATEGORIES + [WEATHER_CATEGORY] * with_weather


def fit_domain_index(table: DataFrame, columns: list[str]) -> StringIndexerModel:
    """Index of each column over all its values in the table, in code order.

    Fit it on the whole table, not on a training part. One job serves all the
    columns; the driver gets the distinct codes only. NULL and codes that were
    not in the table share one more index.
    """
    return StringIndexer(
        inputCols=columns,
        outputCols=[_index(c) for c in columns],
        handleInvalid="keep",
        stringOrderType="alphabetAsc",
    ).fit(table.select(*columns))


def fit_label_index(table: DataFrame, column: str, output: str | None = None) -> StringIndexerModel:
    """Index of a label by frequency: 0 for the most frequent value."""
    return StringIndexer(inputCol=column, outputCol=output or column + "Ind").fit(
        table.select(column)
    )


def one_hot(columns: list[str]) -> OneHotEncoder:
    """Encoder of the columns' indexes."""
    return OneHotEncoder(
        inputCols=[_index(c) for c in columns], outputCols=[_one_hot(c) for c in columns]
    )


def assemble(with_weather: bool) -> VectorAssembler:
    """Assembler of 7 flight inputs, or of 13 with the weather.

    Fails on NULL input: fill the weather first.
    """
    inputs = schemas.FLIGHT_INPUTS + schemas.WEATHER_INPUTS * with_weather
    coded = set(categories(with_weather))
    return VectorAssembler(
        inputCols=[_one_hot(c) if c in coded else c for c in inputs], outputCol="features"
    )


def label_decoder(index: StringIndexerModel, output: str = "predictedLabel") -> IndexToString:
    """Predicted index back to its label."""
    return IndexToString(inputCol="prediction", outputCol=output, labels=index.labelsArray[0])


def feature_stages(domain: StringIndexerModel, with_weather: bool) -> list:
    """Stages from examples to the column ``features``."""
    return [domain, one_hot(categories(with_weather)), assemble(with_weather)]


def delay_pipeline(estimator, domain: StringIndexerModel, with_weather: bool, before=(), after=()):
    """Pipeline of feature stages and an estimator.

    ``before`` and ``after`` are stages around the estimator, such as a label
    index and its decoder.
    """
    return Pipeline(
        stages=[*feature_stages(domain, with_weather), *before, estimator, *after]
    )
