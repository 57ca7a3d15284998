"""Registered queries over the given tables, one module per operator family."""

from tabloom.catalog import align_queries, corpus_queries, dense_queries, example_queries, lexical_queries, program_queries, scalar_queries, scoring_queries, source_queries  # noqa: F401
from tabloom.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
