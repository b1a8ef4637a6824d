"""First-fit linking of guests: the tracks of one sequence, and its run over sorted batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa


class Tracks:
    """The last vector of each track. What is held grows with tracks, not with faces."""

    def __init__(self, least: float):
        self.least, self.n, self._of = least, 0, {}

    def add(self, vector: np.ndarray | None) -> int:
        """Number of the first track, oldest first, whose last vector is similar enough; else a new
        track's. Only vectors of one length are compared; None, and a vector that holds anything
        but finite numbers, opens a track that nothing joins."""
        if vector is None or not np.isfinite(vector).all():
            self.n += 1
            return self.n - 1
        last, numbers = self._of.setdefault(len(vector), (np.empty((16, len(vector))), []))
        fits = last[: len(numbers)] @ vector >= self.least
        k = int(fits.argmax()) if fits.any() else len(numbers)
        if k == len(numbers):
            numbers.append(self.n)
            self.n += 1
            if k == len(last):
                last = np.concatenate([last, np.empty_like(last)])
                self._of[len(vector)] = last, numbers
        last[k] = vector
        return numbers[k]

    def state(self) -> dict:
        """All of it as plain lists, for :meth:`of`."""
        return {"n": self.n, "numbers": [k for _, numbers in self._of.values() for k in numbers], "last": [last[k].tolist() for last, numbers in self._of.values() for k in range(len(numbers))]}

    @classmethod
    def of(cls, least: float, state: dict) -> Tracks:
        """The tracks that :meth:`state` gave."""
        made = cls(least)
        for number, vector in zip(state["numbers"], state["last"]):
            last, numbers = made._of.setdefault(len(vector), (np.empty((16, len(vector))), []))
            if len(numbers) == len(last):
                last = np.concatenate([last, np.empty_like(last)])
                made._of[len(vector)] = last, numbers
            last[len(numbers)] = vector
            numbers.append(number)
        made.n = state["n"]
        return made


def rows(column: pa.Array) -> list[np.ndarray | None]:
    """A list column's vectors in doubles; None for null, NaN for null elements."""
    flat, lengths = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    ends = np.cumsum(np.maximum(lengths, 0))
    return [None if n < 0 else flat[end - n : end] for n, end in zip(lengths, ends)]


def linked(batches: Iterable[pa.RecordBatch], least: float, key: str = "sequence_id", vector: str = "embedding") -> Iterator[pa.RecordBatch]:
    """The batches, sorted by key, without their vectors and with ``link_no``. A sequence goes on
    from batch to batch; only the tracks of the one that is being read are held."""
    tracks, current = None, None
    for batch in batches:
        numbers = np.empty(batch.num_rows, np.int32)
        for k, (sequence, face) in enumerate(zip(batch.column(key).to_pylist(), rows(batch.column(vector)))):
            if tracks is None or sequence != current:
                tracks, current = Tracks(least), sequence
            numbers[k] = tracks.add(face)
        kept = [name for name in batch.schema.names if name != vector]
        yield pa.RecordBatch.from_arrays([*(batch.column(name) for name in kept), pa.array(numbers)], names=[*kept, "link_no"])
