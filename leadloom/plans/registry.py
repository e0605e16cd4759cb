"""``@query`` registers a DataFrame-producing function, its oracle SQL and the inventory rows it covers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from leadloom.plans.views import Views, oracle_text
from leadloom.session import small_batches


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Views], DataFrame]
    covers: tuple[str, ...]
    oracle: str | None

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        for key, value in TABLE_READING.items():
            spark.conf.set(key, value)
        small_batches(spark)
        return self.build(Views(spark, sf_dir))


# The tables store UTC wall-clock times without a zone: read them as instants.
TABLE_READING = {"spark.sql.session.timeZone": "UTC", "spark.sql.parquet.inferTimestampNTZ.enabled": "false"}

QUERIES: dict[str, Query] = {}


def query(name: str, covers: str, oracle: str | None = None):
    def register(build: Callable[[Views], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = Query(name, build, tuple(covers.split()), oracle_text(oracle) if oracle else None)
        return build

    return register
