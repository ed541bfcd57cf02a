"""Form documents for the tests: field readings and the document texts made of them."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "document_id bigint, text string"

# Rows that every operator must take: null and empty texts, white space, ties, repeated rows, a null id.
AWKWARD = [(None, "a text without an id"), (900, None), (901, ""), (902, " \t\n"), (903, "x"), (904, "same row"), (904, "same row"), (905, "née Ünal\r\n\r\nß"), (906, "w " * 4000)]


def documents(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def with_clashes(df: DataFrame, *names: str) -> DataFrame:
    """Extra columns whose names the operators use inside."""
    for n in names or ("h1", "position", "n_lines", "score", "signatures", "class_id", "rate", "dropped", "raw", "_text"):
        df = df.selectExpr("*", f"'extra' AS {n}")
    return df


def words(rng: random.Random, n: int, pool: int = 400) -> list[str]:
    return [f"w{rng.randrange(pool)}" for _ in range(n)]
