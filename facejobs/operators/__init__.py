"""Operators over detections, members and tracks."""
