"""Readers and writers (R-style CSV, JSON-lines requests/responses, table sinks)."""

from raterspark.sources import io
from raterspark.sources.io import (
    materialize,
    model_from_path,
    read_r_csv,
    read_response_lines,
    review_sink,
    write_requests,
    write_table,
)

__all__ = ["io", "materialize", "model_from_path", "read_r_csv", "read_response_lines", "review_sink", "write_requests",
           "write_table"]
