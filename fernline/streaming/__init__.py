"""Queries over Structured Streaming sources.

A streaming DataFrame added to a catalog is a table like any other. Queries that look at one row at a
time (where, select, unnest, joins with tables at rest) compile unchanged; aggregates by key run
in update or complete mode, or, with ``watermark``, in append mode over the windows of a time column.
"""

from .continuous import append_windows, stream_query, write_stream

__all__ = ["append_windows", "stream_query", "write_stream"]
