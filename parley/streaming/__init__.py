"""The same preparation on a stream."""

from .rows import parquet_stream, training_stream, write_stream

__all__ = ["parquet_stream", "training_stream", "write_stream"]
