"""Failures that a caller can act on: a code, a message and a hint."""

from __future__ import annotations


class AnalysisError(Exception):
    """An analysis that cannot be done as asked."""

    def __init__(self, code: str, message: str, hint: str | None = None) -> None:
        super().__init__(message)
        self.code, self.message, self.hint = code, message, hint


class IngestError(Exception):
    """A file that cannot be read as a table."""

    def __init__(self, code: str, message: str) -> None:
        super().__init__(message)
        self.code, self.message = code, message
