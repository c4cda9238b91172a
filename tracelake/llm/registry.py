"""Queries of the corpus operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def _all() -> tuple[dict[str, Query], dict[str, str | None]]:
    from tracelake.llm import queries as q

    return q.QUERIES, q.ORACLES


def queries() -> dict[str, Query]:
    import corpus_pipeline

    return {**_all()[0], "pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    found = {**_all()[1], "pipeline": corpus_pipeline.ORACLE_SQL}
    return {k: v for k, v in found.items() if v is not None}
