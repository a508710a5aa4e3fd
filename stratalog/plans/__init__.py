"""The library's queries over the driver's tables. Importing this registers them."""

from . import codec_queries, compaction_queries, log_queries, metric_queries, run_queries, source_queries, stream_queries  # noqa: F401
