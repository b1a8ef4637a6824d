"""The identify and motion jobs, run continuously."""

from facejobs.streaming.streams import identify_stream, motion_stream, pinned_version, table_sink

__all__ = ["identify_stream", "motion_stream", "pinned_version", "table_sink"]
