"""Best-fit packing of token sequences: a configuration linear program over the length histogram.

Documents are tokenised and cut into pieces; only a count per length (at most ``capacity`` rows)
reaches the driver. There, multiplicative weights solve the covering program whose columns are
fillings of a sequence: a knapsack dynamic program prices them, which also bounds the number of
sequences from below, fillings of nearly the best worth are used a little, and what they cover
gets cheaper. The fractional solution is rounded down, what is left is packed at its dual prices or
as a smaller program, and the last few pieces go by best fit, over the histogram too. Pieces find their place by arithmetic: the r-th piece of a length
lies in a known run of places of that length.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from facejobs.llm import common
from facejobs.llm.units import units

FILE = "word_bpe_49k.json"
CAPACITY, END_ID = 4096, 1
#: Rounds of the weights, how strongly coverage lowers a price, how much of a length's need a
#: filling covers at once, and how much less than the best it may be worth.
ROUNDS, RATE, STEP, SLACK = 40, 0.1, 0.25, 0.05
#: Fillings of a round at most; distance to the dual bound at which the weights have settled.
FILLINGS, CLOSE = 600, 0.002
#: Turns of fillings at the dual prices, and the share of a sequence's worth that they may lack.
TURNS, LACKING = 8, 0.03
#: Programs solved one after the other at most, and share of each that is rounded before the next.
LEVELS, LEVEL = 8, 0.6

Filling = tuple[tuple[int, int], ...]


def knapsack(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> np.ndarray:
    """For each room up to ``capacity`` the best price of a filling."""
    best = np.zeros(capacity + 1)
    fitting = np.searchsorted(lengths, np.arange(capacity + 1), "right").tolist()
    for room in range(int(lengths[0]), capacity + 1):
        n = fitting[room]
        best[room] = max(best[room - 1], (best[room - lengths[:n]] + prices[:n]).max())
    return best


def _filling(lengths: np.ndarray, prices: np.ndarray, best: np.ndarray, first: int) -> tuple[dict[int, int], float]:
    """A filling that holds the ``first`` length, as counts by place in ``lengths``, and its worth:
    each time the piece that with the best use of the room behind it is worth most, of equals the
    longest. ``best`` may be of somewhat earlier, higher prices."""
    found, room, worth = {first: 1}, len(best) - 1 - int(lengths[first]), prices[first]
    while n := int(np.searchsorted(lengths, room, "right")):
        reach = prices[:n] + best[room - lengths[:n]]
        k = int(np.flatnonzero(reach >= reach.max() - 1e-9)[-1])
        found[k] = found.get(k, 0) + 1
        room, worth = room - int(lengths[k]), worth + prices[k]
    return found, worth


@dataclass(frozen=True)
class Fraction:
    """A fractional solution of the program."""

    #: How often each filling (pairs of place in ``lengths`` and copies) is used, before scaling.
    used: dict[Filling, float]
    #: Uses are to be divided by this.
    scale: float
    #: Sequences of a scaled solution, lengths that it lacks made up by sequences of one length.
    primal: float
    #: No packing, fractional or whole, has fewer: what all pieces are worth at ``prices``, at which
    #: no filling is worth more than 1.
    dual: float
    prices: np.ndarray


def fractional(lengths: np.ndarray, need: np.ndarray, capacity: int, rounds: int = ROUNDS, rate: float = RATE) -> Fraction:
    """The covering program min sum(x) over fillings, each length covered ``need`` times, by
    multiplicative weights.

    A length's price is its share of the capacity times exp(-rate * how often it has been covered
    so far). Each round a knapsack dynamic program finds the best worth of a filling at these
    prices, and with it a dual bound; then, for the least covered lengths first, a filling that
    holds the length is used for a step if it is worth nearly the best, and the prices of what it
    covers fall at once. The solution is the sum over rounds, scaled; it stands when it is within
    CLOSE of the best bound.
    """
    covered, used, dual, primal = np.zeros(len(lengths)), Counter(), 0.0, np.inf
    alone = need / (capacity // lengths)  # sequences if each length had its own
    for _ in range(rounds):
        prices = lengths / capacity * np.exp(-rate * (covered - covered.min()))
        best = knapsack(lengths, prices, capacity)
        if (bound := float(need @ prices) / best[-1]) > dual:
            dual, tight = bound, prices / best[-1]
        gain, now = np.zeros(len(lengths)), prices.copy()
        for first in np.argsort(covered, kind="stable")[:FILLINGS].tolist():
            if gain[first] >= STEP:
                continue
            found, worth = _filling(lengths, now, best, first)
            if worth < best[-1] * (1 - SLACK):
                continue
            of, copies = np.fromiter(found, int), np.fromiter(found.values(), float)
            step = float((STEP * need[of] / copies).min())
            used[tuple(sorted(found.items()))] += step
            gain[of] += copies * step / need[of]
            now[of] = prices[of] * np.exp(-rate * gain[of])
        covered += gain
        times = sum(used.values())
        for by in (covered.min(), (covered.min() + covered.mean()) / 2, covered.mean()):
            if by > 0:
                primal = min(primal, times / by + float(alone @ np.maximum(0, 1 - covered / by)))
        if primal <= dual * (1 + CLOSE):
            break
    return Fraction(used, float(max(covered.mean(), 1e-9)), float(primal), dual, tight)


def _best_fit(left: dict[int, int], capacity: int) -> Iterator[tuple[Filling, int]]:
    """Fillings and how often, longest first, each time the longest piece that still fits."""
    stock = np.zeros(capacity + 1, np.int64)
    for k, n in left.items():
        stock[k] = n
    longest = capacity
    while True:
        while longest and not stock[longest]:
            longest -= 1
        if not longest:
            return
        filling, room = Counter(), capacity
        while True:
            fits = np.flatnonzero(stock[1 : room + 1])[::-1] + 1
            k = next((int(x) for x in fits if stock[x] > filling[int(x)]), 0)
            if not k:
                break
            copies = min(int(stock[k]) - filling[k], room // k)
            filling[k] += copies
            room -= k * copies
        times = min(int(stock[k]) // n for k, n in filling.items())
        for k, n in filling.items():
            stock[k] -= n * times
        yield tuple(sorted(filling.items(), reverse=True)), times


@dataclass(frozen=True)
class Plan:
    #: Fillings with how many sequences use each; together they hold every piece exactly once.
    fillings: list[tuple[Filling, int]]
    #: No packing has fewer sequences: the program's dual bound, rounded up.
    bound: int
    #: Share of all tokens in fillings of the program; the rest went by best fit.
    bought: float
    #: Sequences of the fractional solution.
    primal: float


def _floors(solved: Fraction, need: np.ndarray) -> tuple[list[tuple[Filling, int]], np.ndarray]:
    """The fractional solution rounded down, most used fillings first, and what is left then."""
    bought, rest = [], need.copy()
    for filling, used in sorted(solved.used.items(), key=lambda x: (-x[1], x[0])):
        if times := min([int(used / solved.scale), *(int(rest[k]) // copies for k, copies in filling)]):
            _take(rest, filling, times)
            bought.append((filling, times))
    return bought, rest


def _take(rest: np.ndarray, filling: Filling, times: int) -> None:
    for k, copies in filling:
        rest[k] -= copies * times


def _tight(lengths: np.ndarray, rest: np.ndarray, prices: np.ndarray, capacity: int) -> list[tuple[Filling, int]]:
    """Fillings of what is left (changed in place) that at the dual prices are worth 1 or nearly,
    longest pieces first, each as often as it can; what they may lack doubles from turn to turn."""
    bought = []
    for turn in range(TURNS):
        if not (live := rest > 0).any():
            break
        best = knapsack(lengths[live], prices[live], capacity)
        least = best[-1] * (1 - min((2**turn - 1) * 0.5 / capacity, LACKING)) - 1e-12
        for first in np.flatnonzero(live)[::-1].tolist():
            while rest[first] > 0 and (found := _reaching(lengths, prices, best, first, rest, least)):
                filling = tuple(sorted(found.items()))
                times = min(int(rest[k]) // copies for k, copies in filling)
                _take(rest, filling, times)
                bought.append((filling, times))
    return bought


def _reaching(lengths: np.ndarray, prices: np.ndarray, best: np.ndarray, first: int, left: np.ndarray, least: float) -> dict[int, int] | None:
    """A filling worth ``least`` or more that holds the ``first`` length and no more of any than
    are left; each time the longest piece that can still reach that worth. None if it finds none."""
    found, room, worth = {first: 1}, len(best) - 1 - int(lengths[first]), prices[first]
    while n := int(np.searchsorted(lengths, room, "right")):
        usable = left[:n] > 0
        for k, copies in found.items():
            if k < n and left[k] <= copies:
                usable[k] = False
        reach = np.flatnonzero(usable & (worth + prices[:n] + best[room - lengths[:n]] >= least))
        if not len(reach):
            break
        k = int(reach[-1])
        found[k] = found.get(k, 0) + 1
        room, worth = room - int(lengths[k]), worth + prices[k]
    return found if worth >= least else None


def _drawn(lengths: np.ndarray, need: np.ndarray, solved: Fraction, capacity: int, rounds: int, rate: float) -> list[tuple[Filling, int]]:
    """Fillings of the fractional solution once more each, the most used first, until LEVEL of what
    is left (changed in place) is placed; then those of the program of what still is left."""
    bought, at = [], np.arange(len(lengths))
    for level in range(LEVELS):
        before = need.copy()
        most = LEVEL * int(lengths @ need)
        for filling, used in sorted(solved.used.items(), key=lambda x: (-x[1], x[0])):
            if level < LEVELS - 1 and int(lengths @ (before - need)) >= most:
                break
            there = tuple((int(at[k]), copies) for k, copies in filling)
            if times := min([max(1, int(used / solved.scale)), *(int(need[k]) // copies for k, copies in there)]):
                _take(need, there, times)
                bought.append((there, times))
        if not (need > 0).any() or (need == before).all():
            break
        at = np.flatnonzero(need)
        solved = fractional(lengths[at], need[at], capacity, rounds, rate)
    return bought


def solve(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS, rate: float = RATE) -> Plan:
    """Pack pieces of given lengths, 1 to ``capacity``; never more sequences than by best fit alone.

    The fractional solution is rounded down. What is left goes into fillings that the dual prices
    make worth a sequence, or, if that does not come CLOSE to the bound, into the solution's own fillings
    and those of the smaller programs that remain; the better of both stands. The last few pieces
    go by best fit.
    """
    histogram = {k: n for k, n in histogram.items() if n}
    if not histogram:
        return Plan([], 0, 0.0, 0.0)
    lengths = np.array(sorted(histogram), np.int64)
    need = np.array([histogram[int(k)] for k in lengths], np.int64)
    total, solved = int(lengths @ need), fractional(lengths, need, capacity, rounds, rate)
    bound = int(np.ceil(max(solved.dual, total / capacity) - 1e-9))
    floors, left = _floors(solved, need)
    count = lambda fillings: sum(times for _, times in fillings)

    def whole(bought: list[tuple[Filling, int]], rest: np.ndarray) -> tuple[int, float, list]:
        made = [(tuple(sorted(((int(lengths[k]), copies) for k, copies in filling), reverse=True)), times) for filling, times in bought]
        made += _best_fit({int(k): int(n) for k, n in zip(lengths, rest) if n}, capacity)
        return count(made), int(lengths @ rest) / total, made

    rest = left.copy()
    found = [whole(floors + _tight(lengths, rest, solved.prices, capacity), rest)]
    if found[0][0] > bound:  # the weights may not have settled where best fit comes near the bound
        rest = need.copy()
        found.append(whole(_tight(lengths, rest, solved.prices, capacity), rest))
    if min(found, key=lambda x: x[:2])[0] > bound * (1 + CLOSE):
        rest = left.copy()
        found.append(whole(floors + _drawn(lengths, rest, solved, capacity, rounds, rate), rest))
    sequences, lacking, made = min(found, key=lambda x: x[:2])
    alone = list(_best_fit(histogram, capacity))
    if sequences > count(alone):
        lacking, made = 1.0, alone
    return Plan(made, bound, 1 - lacking, solved.primal)


class Places:
    """Where the r-th piece of each length goes."""

    def __init__(self, fillings: list[tuple[Filling, int]]) -> None:
        seen, rows, sequence = Counter(), [], 0
        for filling, times in fillings:
            offset = 0
            for length, copies in filling:
                rows.append((length, seen[length], copies, sequence, offset))
                seen[length] += copies * times
                offset += length * copies
            sequence += times
        self.sequences = sequence
        rows.sort()
        self.length, self.rank, self.copies, self.sequence, self.offset = (np.array(x, np.int64) for x in (zip(*rows) if rows else [[]] * 5))

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of pieces."""
        k = np.searchsorted(self.length << 40 | self.rank, length << 40 | rank, "right") - 1
        within = rank - self.rank[k]
        return self.sequence[k] + within // self.copies[k], self.offset[k] + within % self.copies[k] * length


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = True, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Pieces of each document's ids and end id, cut only where longer than ``capacity``: part and
    ``local`` number the pieces of one length; ``ids`` array<int> if asked for.

    Null and empty texts are one piece with the end id; repeated rows and ids each have their
    own pieces; an empty table gives none. ``doc_id`` may be of any type, other columns are left
    out whatever their names, and a long text is held one at a time.
    """
    kinds = {"piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "local": pa.int64()}

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, part, seen = units(path), TaskContext.get().partitionId(), Counter()
        for batch in common.slices(batches, "text", 4 << 20):
            docs, out, ids = [], [], []
            for doc, found in zip(batch.column("doc_id").to_pylist(), u.encode(common.texts(batch.column("text")))):
                found = np.append(found, np.int32(end_id)).astype("<i4")
                for k, at in enumerate(range(0, len(found), capacity)):
                    cut = found[at : at + capacity]
                    docs.append(doc)
                    out.append((k, at, len(cut), zlib.crc32(cut.tobytes()), seen[len(cut)]))
                    seen[len(cut)] += 1
                    if with_ids:
                        ids.append(cut)
            columns = {"part": pa.array([part] * len(docs), pa.int32()), "doc_id": pa.array(docs, batch.schema.field("doc_id").type)}
            columns |= {name: pa.array(x, kind) for (name, kind), x in zip(kinds.items(), zip(*out))}
            if with_ids:
                columns["ids"] = pa.array(ids, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(columns)

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = f"part int, doc_id {common.type_of(rows, 'doc_id')}, piece int, start long, length long, ids_crc32 long, local long"
    return rows.mapInArrow(read, schema + (", ids array<int>" if with_ids else ""))


def place(stored: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` (long) to a stored table of :func:`pieces`.

    No window runs over the pieces of a length: they are numbered within parts, and only counts
    per part and length are summed. The join is by shuffle, as those counts grow with the parts.
    An empty table gives no rows; which of equally long pieces takes which place is of no account.
    """
    counted = common.stage(stored.groupBy("part", "length").agg(F.count("*").alias("n")), "lengths")
    histogram = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counted.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    places = Places(solve(histogram, capacity).fillings)

    @F.arrow_udf("sequence_id long, offset long")
    def find(length: pa.Array, rank: pa.Array) -> pa.Array:
        sequence, offset = places.find(length.to_numpy(zero_copy_only=False), rank.to_numpy(zero_copy_only=False))
        return common.struct(sequence_id=sequence, offset=offset)

    ranked = stored.join(base.hint("merge"), ["part", "length"]).withColumn(common.RESULT, find(F.col("length"), F.col("local") + F.col("base")))
    return ranked.select(*(c for c in stored.columns if c not in ("part", "local")), f"{common.RESULT}.*")


def pack(docs: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, (ids,) sequence_id, offset.
    Nulls, repeated rows, empty tables and long texts as in :func:`pieces`."""
    common.small_batches(docs.sparkSession)
    return place(common.stage(pieces(docs, path or common.tokenizer_file(FILE), with_ids=with_ids), "pieces"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: the place of every piece of every document."""
    return pack(common.documents(spark, sf_dir))
