"""Umbra: SQL over shadow tables on Spark; writes and DDL are simulated, real tables are never touched."""

from umbra.errors import ShadowError, UnknownSchema, UnsupportedSql, is_unknown_schema
from umbra.session import Mutation, Plan, QueryKind, ShadowSession

__all__ = ["Mutation", "Plan", "QueryKind", "ShadowError", "ShadowSession", "UnknownSchema", "UnsupportedSql", "is_unknown_schema"]
