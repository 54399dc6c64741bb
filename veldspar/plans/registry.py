"""Named queries and the SQL that they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import ship

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """Tables of a folder by name."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        ship(spark)

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(sql: str | None = None):
    """Register a function of Tables under its name."""

    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, folder: f(Tables(spark, folder))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def both(name: str, sql: str, duck: str | None = None) -> None:
    """A query that Spark SQL runs as it stands; {table} names a table.  DuckDB runs the same text with its own name of SHA-256, or ``duck``."""
    used = [t for t in TABLES if "{" + t + "}" in sql]

    def run(spark: SparkSession, folder: str) -> DataFrame:
        t = Tables(spark, folder)
        return spark.sql(sql, **{n: getattr(t, n) for n in used})

    QUERIES[name] = run
    SQL[name] = (duck or sql.replace("sha2(text, 256)", "sha256(text)")).format(**{t: t for t in TABLES})


from . import analysis, contents, corpus, flow, ledgers, ordering, pairs, relational, screening  # noqa: E402, F401  they register their queries
