"""raterspark: consensus labelling and coverage analytics as Spark DataFrame operators.

Sub-packages:

* ``functions``  -- column expressions (missing-value rules, text folding, JSON extraction)
* ``sources``    -- readers and writers (R-style CSV, JSON-lines requests/responses, tables)
* ``operators``  -- DataFrame -> DataFrame operators (votes, agreement, linkage, reshape, summaries)
* ``plans``      -- the registered queries over the driver tables and their SQL oracles
* ``streaming``  -- incremental response ingestion with Structured Streaming
"""

from raterspark.session import build_session, ensure_checkpoint_dir

__all__ = ["build_session", "ensure_checkpoint_dir"]
__version__ = "0.1.0"
