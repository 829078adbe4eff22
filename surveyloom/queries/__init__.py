"""Registered queries: each operator on the shared test tables, with its SQL check."""

from surveyloom.queries.registry import ORACLE, QUERIES  # noqa: F401
from surveyloom.queries import (  # noqa: F401
    amounts, entity, file_queries, join_queries, kpi, recode, schema, score_queries, stat_queries, tables, text,
)
