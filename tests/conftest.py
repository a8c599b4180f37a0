import pytest

from checks.compare import session


@pytest.fixture(scope="session")
def spark():
    active = session("4")
    active.sparkContext.setLogLevel("ERROR")
    yield active
    active.stop()


def plan_of(table) -> str:
    """The physical plan as text."""
    return table._jdf.queryExecution().executedPlan().toString()


def final_plan_of(table) -> str:
    """The plan that adaptive execution arrived at, after a run."""
    table.collect()
    return plan_of(table).split("== Initial Plan ==")[0]
