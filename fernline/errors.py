"""Errors of the query language."""


class QueryError(ValueError):
    """A query that can't be compiled: what is wrong, and the character position where (0 if it has none)."""

    def __init__(self, message: str, position: int = 0):
        super().__init__(f"{message} (at {position})")
        self.message, self.position = message, position
