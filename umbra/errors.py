"""The two errors that planning raises, and the classifier of Spark's own."""

from __future__ import annotations

from pyspark.errors import AnalysisException, PySparkException


class ShadowError(Exception):
    """Base of the engine's errors; ``sql`` is the statement at fault."""

    def __init__(self, message: str, sql: str = ""):
        super().__init__(message)
        self.sql = sql


class UnsupportedSql(ShadowError):
    """A statement, or a form of one, that the engine refuses."""


class UnknownSchema(ShadowError):
    """A statement that reads or changes a table or column that isn't known."""


_UNKNOWN = ("TABLE_OR_VIEW_NOT_FOUND", "UNRESOLVED_COLUMN", "COLUMN_NOT_FOUND", "UNRESOLVED_FIELD")


def is_unknown_schema(error: BaseException) -> bool:
    """Whether an error says that a table or column doesn't exist."""
    if isinstance(error, UnknownSchema):
        return True
    condition = error.getCondition() if isinstance(error, (AnalysisException, PySparkException)) else None
    return bool(condition) and condition.startswith(_UNKNOWN)
