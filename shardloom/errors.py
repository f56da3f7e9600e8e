"""Errors with SQLSTATE codes."""

from __future__ import annotations


class EngineError(Exception):
    """Base of all errors of this package."""

    sqlstate = "XX000"


class ParseError(EngineError):
    sqlstate = "42601"


class UnsupportedError(EngineError):
    """A statement that is understood but not served, such as a write."""

    sqlstate = "42501"


class NotFoundError(EngineError):
    sqlstate = "XX000"


class UnhealthyError(EngineError):
    """Too few healthy shards."""

    sqlstate = "08006"


class RowLimitError(EngineError):
    sqlstate = "53400"


class DisabledError(EngineError):
    sqlstate = "0A000"


class MissingParameterError(ParseError):
    """A placeholder without a value."""
