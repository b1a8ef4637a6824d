"""The state of continuous motion: tracks of sequences that are still open, not their frames.

Rows wait until the watermark has passed them, so that they are taken in order of time whatever
order they come in; what waits is what came within the watermark's delay. Then a row is folded
into its sequence's tracks: of each its first and last point, counts and sums, and of guests the
last vector. A timer at the end of the gap closes the sequence.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from facejobs.operators.linking import Tracks
from facejobs.schemas import POINT, UNKNOWN

FACE = ("face_index", "bbox", "person_id", "name", "confidence", "embedding")
#: ``body`` is JSON: frame_index, height, width and faces.
WAITING = "us long, body string"
SESSION = "start long, last long, frames int"
#: A track while it is open.
TRACK = "n int, total double, link_no int, name string, frame int, face int, height int, width int, x0 double, y0 double, w0 double, h0 double, x1 double, y1 double, w1 double, h1 double"
#: JSON of :meth:`facejobs.operators.linking.Tracks.state`.
LINKS = "body string"
#: What a closed sequence gives for each track of two entries or more.
OUT = f"sequence_id string, start long, track_key string, n_entries int, mean_confidence double, link_no int, name string, first_at struct<frame_index: int, face_index: int>, first_point {POINT}, last_point {POINT}, height int, width int"


def _point(bbox: list[float]) -> tuple:
    x1, y1, x2, y2 = bbox
    return (x1 + x2) / 2, (y1 + y2) / 2, x2 - x1, y2 - y1


class OpenTracks(StatefulProcessor):
    """Tracks of one sequence, from rows (us, frame_index, height, width, faces) to :data:`OUT`."""

    def __init__(self, gap_us: int, least: float):
        self.gap, self.least = gap_us, least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", WAITING)
        self.session = handle.getValueState("session", SESSION)
        self.tracks = handle.getMapState("tracks", "track_key string", TRACK)
        self.links = handle.getValueState("links", LINKS)

    def close(self) -> None:
        pass

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        came = [(r.us, r.frame_index, r.height, r.width, [tuple(f[k] for k in FACE) for f in r.faces or []]) for r in rows]
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        yield from self._fold(key, [*self._held(), *came], timerValues.getCurrentWatermarkInMs() * 1000)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._fold(key, self._held(), timerValues.getCurrentWatermarkInMs() * 1000)

    def _fold(self, key: tuple, waiting: list[tuple], passed: int) -> Iterator[Row]:
        """Take the rows that the watermark has passed, in order; then close the sequence or have
        a timer close it later."""
        self.touched: dict[str, tuple] = {}  # tracks of this turn, written once at its end
        order = lambda w: (w[0], w[1] is not None, w[1] or 0)
        ready, rest = sorted((w for w in waiting if w[0] <= passed), key=order), [w for w in waiting if w[0] > passed]
        session = list(self.session.get()) if self.session.exists() else None
        links = self._linked() if session else Tracks(self.least)
        for us, frame, height, width, faces in ready:
            if session and us >= session[1] + self.gap:
                yield from self._closed(key, session)
                session, links = None, Tracks(self.least)
            session = [session[0], max(us, session[1]), session[2] + 1] if session else [us, us, 1]
            for face in sorted(faces, key=lambda f: (f[0] is not None, f[0] or 0)):
                self._entry(face, frame, height, width, links)
        if session and session[1] + self.gap <= passed:
            yield from self._closed(key, session)
            session = None
        for track, held in self.touched.items():
            self.tracks.updateValue((track,), held)
        if rest:
            self.waiting.put([(w[0], json.dumps(w[1:])) for w in rest])
        else:
            self.waiting.clear()
        if session:
            self.session.update(tuple(session))
            self.links.update((json.dumps(links.state()),))
        end = session[1] + self.gap if session else None
        for us, *_ in sorted(rest, key=order):
            if end is None or us < end:
                end = us + self.gap
        if end is not None:  # the first moment at which a part of the sequence can close
            self.handle.registerTimer(-(-end // 1000))

    def _held(self) -> list[tuple]:
        return [(us, *json.loads(body)) for us, body in self.waiting.get()]

    def _linked(self) -> Tracks:
        return Tracks.of(self.least, json.loads(self.links.get()[0]))

    def _entry(self, face: tuple, frame: int, height: int, width: int, links: Tracks) -> None:
        number, bbox, person, name, sure, vector = face
        link = None
        if person == UNKNOWN:
            usable = vector is not None and None not in vector and len(vector)
            link = links.add(np.array(vector, np.float64) if usable else None)
        track = person if link is None else f"{UNKNOWN}_{link}"
        point = _point(bbox)
        held = self.touched.get(track)
        if held is None and self.tracks.containsKey((track,)):
            held = self.tracks.getValue((track,))
        if held:
            n, total, *rest = held
            self.touched[track] = (n + 1, total + sure, *rest[:10], *point)
        else:
            self.touched[track] = (1, sure, link, name, frame, number, height, width, *point, *point)

    def _closed(self, key: tuple, session: list) -> Iterator[Row]:
        start, _, frames = session
        if frames >= 2:
            tracks = {track: tuple(held) for (track,), held in self.tracks.iterator()} | self.touched
            for track, held in tracks.items():
                n, total, link, name, frame, face, height, width, *points = held
                if n >= 2:
                    yield Row(sequence_id=key[0], start=start, track_key=track, n_entries=n, mean_confidence=total / n, link_no=link, name=name, first_at=(frame, face), first_point=tuple(points[:4]), last_point=tuple(points[4:]), height=height, width=width)
        self.touched = {}
        for state in (self.tracks, self.session, self.links):
            state.clear()
