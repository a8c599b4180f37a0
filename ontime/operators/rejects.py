"""Counts of the lines that a reader or parser rejects, taken while it works."""

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


#: Takes the rows out of a plan that can't give any, because what they meet in a join turned out to be empty.
_LEAVES_ROWS_OUT = "org.apache.spark.sql.execution.adaptive.AQEPropagateEmptyRelation"
_LEFT_OUT = "spark.sql.adaptive.optimizer.excludedRules"


def counting_session(spark: SparkSession) -> SparkSession:
    """A session with the same settings, catalog and executors, to count rows in.

    Once a session has observed rows, Spark 4.1 can't serialize what it fits in the same session, as a model's
    summary holds on to it. So count in a session of its own. There, rows are read even if they meet nothing.
    """
    session = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(key):
            session.conf.set(key, value)
    others = spark.conf.get(_LEFT_OUT, None)
    session.conf.set(_LEFT_OUT, f"{others},{_LEAVES_ROWS_OUT}" if others else _LEAVES_ROWS_OUT)
    return session


class Counted:
    """How many rows of an input were read and rejected.

    The counts come out of the first job that runs over the rows, so no further pass is needed; ask for them after that
    job. They count what its tasks saw: a stage that runs again after a loss may count
    rows twice, and a limit above may leave rows unseen. Rows that the job could do without, as what they meet in a join is
    empty, are counted in a pass of their own. One object counts one input once. See :func:`counting_session`.
    """

    def __init__(self, name: str):
        self.name = name
        self._seen = Observation(f"{name} read and rejected")

    def watch(self, rows: DataFrame, valid: Column) -> DataFrame:
        """The rows, which are counted as they pass."""
        counts = [F.count(F.lit(1)).alias("read"), F.count_if(~F.coalesce(valid, F.lit(False))).alias("rejected")]
        self._apart = rows.agg(*counts)
        return rows.observe(self._seen, *counts)

    def _observed(self) -> dict[str, int]:
        """What the job saw; nothing if Spark took the rows out of its plan."""
        try:
            return self._seen.get
        except Py4JJavaError:
            return {}

    def metrics(self) -> dict[str, int]:
        """The counts under the names that a metric log gives them."""
        seen = self._observed()
        if not seen.get("read"):
            seen = self._apart.first().asDict()
        return {f"{self.name}_{what}": seen[what] for what in ("read", "rejected")}


def watched(rows: DataFrame, valid: Column, counted: Counted | None) -> DataFrame:
    """The rows, counted if there is something to count with."""
    return rows if counted is None else counted.watch(rows, valid)
