"""Column expressions."""

from facejobs.functions.columns import area, classify_direction, dot, geometry, is_guest, is_known, label, match_band, usable_vector

__all__ = ["area", "classify_direction", "dot", "geometry", "is_guest", "is_known", "label", "match_band", "usable_vector"]
