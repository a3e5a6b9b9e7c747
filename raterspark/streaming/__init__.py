"""Structured Streaming entry points (incremental response ingestion and vote counts).

The original workflow has no stream processing; its one asynchronous step is a remote
batch whose response files arrive later. These jobs ingest such files as they land.
"""

from raterspark.streaming.ingest import mode_from_counts, response_stream, start_ingest, start_vote_counts

__all__ = ["mode_from_counts", "response_stream", "start_ingest", "start_vote_counts"]
