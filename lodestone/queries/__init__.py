"""Registered queries: name -> callable, and the SQL that says the same."""

from lodestone.queries import billing, models, records, reporting, retrieval, rounds, services, standards, streams, texts
from lodestone.queries.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "billing", "models", "records", "reporting", "retrieval", "rounds", "services", "standards", "streams", "texts"]
