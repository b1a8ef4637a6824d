"""Settings of the jobs."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    """Thresholds and sizes; the defaults are those of a small household gallery."""

    #: Detections that score lower are dropped; equal is kept.
    det_threshold: float = 0.5
    #: Similarity from which a face is an enrolled person.
    threshold: float = 0.4
    #: Similarity from which an unmatched face is called uncertain.
    unknown_threshold: float = 0.25
    #: Share of the frame's width from which a move counts.
    min_displacement_fraction: float = 0.05
    #: Similarity from which guests in different frames are linked.
    cross_frame_similarity: float = 0.5
    #: Share of the mean box area from which a change of size counts.
    area_change_fraction: float = 0.15
    #: Box colours of the overlay, blue-green-red.
    known_colour: tuple[int, int, int] = (0, 200, 0)
    unknown_colour: tuple[int, int, int] = (0, 165, 255)
    #: Bytes of centroids that may be broadcast as one matrix; larger galleries are cut into blocks.
    broadcast_bytes: int = 64 << 20

    def __post_init__(self) -> None:
        for name in ("det_threshold", "threshold", "unknown_threshold", "cross_frame_similarity"):
            if not -1 <= getattr(self, name) <= 1:
                raise ValueError(f"{name} must lie in [-1, 1]")
        if self.min_displacement_fraction <= 0 or self.area_change_fraction <= 0:
            raise ValueError("min_displacement_fraction and area_change_fraction must be positive")
        if self.broadcast_bytes <= 0:
            raise ValueError("broadcast_bytes must be positive")


DEFAULTS = Params()
