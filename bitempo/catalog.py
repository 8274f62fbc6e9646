"""Name -> query, and name -> the SQL that says the same."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession

from .functions.dialect import Duck, Spark
from .plans import audits, graphs, pages, records, states, validators, values  # noqa: F401 - they add their plans
from .plans.queries import PLANS
from .sources.adapters import run


def _planned(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return run(spark, sf_dir, PLANS[name](Spark()))


QUERIES: dict = {name: partial(_planned, name=name) for name in PLANS if name not in graphs.OPERATED} | graphs.OPERATED
ORACLE_SQL: dict[str, str] = {name: f(Duck()) for name, f in PLANS.items() if name not in graphs.OPERATED} | graphs.OPERATED_SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Robust anomaly of each facility, species and day against its own 8 to 56 days before."""
    return QUERIES["robust_baseline_z"](spark, sf_dir)
