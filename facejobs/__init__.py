"""Spark jobs over face detections, with a training-data subpackage in :mod:`facejobs.llm`."""
