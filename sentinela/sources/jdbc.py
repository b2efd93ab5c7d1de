"""Queries against relational databases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# URL form per technology.
URL_FORMS = {
    "sqlserver": "jdbc:sqlserver://{host}:{port};databaseName={database}",
    "oracle": "jdbc:oracle:thin:@//{host}:{port}/{database}",
    "postgresql": "jdbc:postgresql://{host}:{port}/{database}",
}


def jdbc_url(technology: str, host: str, port: str | int, database: str) -> str:
    form = URL_FORMS.get(technology.lower())
    if form is None:
        raise ValueError(f"unsupported database technology {technology!r}")
    return form.format(host=host, port=port, database=database)


def jdbc_query_options(url: str, query: str, user: str, password: str, fetch_size: int = 10_000) -> dict[str, str]:
    return {"url": url, "user": user, "password": password, "query": query, "fetchsize": str(fetch_size)}


def jdbc_split_options(url: str, query: str, user: str, password: str, split_column: str, lower: int, upper: int,
                       partitions: int, fetch_size: int = 10_000) -> dict[str, str]:
    """Options that read one query in parallel ranges of a numeric column."""
    return {
        "url": url, "user": user, "password": password, "fetchsize": str(fetch_size),
        "dbtable": f"({query}) q", "partitionColumn": split_column,
        "lowerBound": str(lower), "upperBound": str(upper), "numPartitions": str(partitions),
    }


def read_jdbc(spark: SparkSession, options: dict[str, str]) -> DataFrame:
    return spark.read.format("jdbc").options(**options).load()
