"""Hard negatives by a vertical scan of decomposed vectors (BOND).

Anchors and all rows meet tile by tile: a tile is a group of anchors against a block of rows,
held dimension by dimension. For each anchor the dimensions are read in descending order of its
own magnitudes. After some of them a row's score lies between what it has so far plus the least
and plus the most that the dimensions not yet read can add, which the smallest and the largest
value of each column in the block bound. Rows that can reach no place leave the candidate bitmap;
the scores of those that stay to the end are exact.

A first scan finds each anchor's positives, a second one the negatives in the windows that the
positives' scores span.
"""

from __future__ import annotations

from fractions import Fraction
from math import floor

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facejobs.llm import common

EVERY, POSITIVES, NEGATIVES = 50, 5, 3
#: Window of a negative's score, in per cent of the positive's.
LOWEST, HIGHEST = 50, 95
SCALE = 256
#: Anchors and rows of a tile at most, and dimensions read between two looks at the bitmap.
ANCHORS, ROWS, STEP = 16384, 16384, 8
#: Sums below this are exact in doubles; larger ones take Python's whole numbers.
EXACT = 2.0**53
_LONG = (-(1 << 63), (1 << 63) - 1)


def usable(rows: DataFrame, vector: str = "embedding", label: str = "label", row_id: str = "vec_id") -> DataFrame:
    """(vec_id, label, vector) of the rows that take part: id, label and vector are there, and
    every component is a finite number. Where the id is divisible by 7 the label becomes
    (label + 1) % 10."""
    x, v, y = F.col(vector), F.col(row_id).cast("long"), F.col(label).cast("long")
    finite = lambda e: F.coalesce(F.abs(e.cast("double")) < float("inf"), F.lit(False))
    held = rows.where(v.isNotNull() & y.isNotNull() & x.isNotNull() & F.forall(x, finite))
    return held.select(v.alias("vec_id"), F.when(v % 7 == 0, (y + 1) % 10).otherwise(y).alias("label"), x.alias("vector"))


def whole(vectors: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) of vectors, a row a dimension; Python's whole numbers where doubles are too coarse."""
    with np.errstate(over="ignore"):
        x = np.floor(vectors.T * SCALE)
    if np.isfinite(x).all() and (np.abs(x) < EXACT).all():
        return np.ascontiguousarray(x)
    return _objects(vectors.T, lambda e: floor(Fraction(float(e)) * SCALE))


def _objects(x: np.ndarray, of=int) -> np.ndarray:
    out = np.empty(x.shape, object)
    out[...] = [[of(e) for e in row] for row in x] if x.size else 0
    return out


class Block:
    """Rows of one length: ids, labels and columns of whole numbers with their least and largest."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, columns: np.ndarray):
        self.ids, self.labels, self.columns = ids, labels, columns
        self.least, self.most = self.columns.min(axis=1), self.columns.max(axis=1)

    def within(self, anchors: np.ndarray) -> bool:
        """Whether all sums with these anchors (a column each) are exact in doubles."""
        if self.columns.dtype == object or anchors.dtype == object:
            return False
        largest = np.maximum(np.abs(self.least), np.abs(self.most))
        return bool((np.abs(anchors).T @ largest < EXACT).all())

    def scan(self, anchor: np.ndarray, bitmap: np.ndarray, prune) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of the rows of ``bitmap`` that ``prune(lower, upper)`` keeps after
        each step; it gets the bounds of all rows that are left and gives a mask, or None for all."""
        order = np.argsort(-np.abs(anchor), kind="stable")
        a, b = anchor * self.least, anchor * self.most
        rest_low = np.append(np.cumsum(np.minimum(a, b)[order][::-1])[::-1], 0)
        rest_high = np.append(np.cumsum(np.maximum(a, b)[order][::-1])[::-1], 0)
        places = np.flatnonzero(bitmap)
        score, all_rows = np.zeros(len(places), anchor.dtype), len(places) == len(bitmap)
        for k in range(0, len(order), STEP):
            read = order[k : k + STEP]
            columns = self.columns[read] if all_rows else self.columns[read[:, None], places]
            score = score + anchor[read] @ columns
            end = k + len(read)
            if end < len(order) and (keep := prune(score + rest_low[end], score + rest_high[end])) is not None and not keep.all():
                places, score, all_rows = places[keep], score[keep], False
                if not len(places):
                    break
        return places, score


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, of equals the smaller id; all, if there are fewer."""
    if len(scores) > 4 * k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= cut)
        return near[np.lexsort((ids[near], -scores[near]))][:k]
    return np.lexsort((ids, -scores))[:k]


def _kth(values: np.ndarray, k: int):
    """The k-th largest; minus infinity if there are fewer."""
    return np.partition(values, len(values) - k)[len(values) - k] if len(values) >= k else -np.inf


def positives(block: Block, anchor_id: int, label: int, anchor: np.ndarray, k: int) -> list[tuple]:
    """(id, score) of the block's first ``k`` rows of the label, but for the anchor's own."""
    places, scores = block.scan(anchor, (block.labels == label) & (block.ids != anchor_id), lambda low, high: high >= _kth(low, k) if len(low) > k else None)
    return [(int(block.ids[places[j]]), int(scores[j])) for j in _best(block.ids[places], scores, k)]


def negatives(block: Block, label: int, anchor: np.ndarray, windows: list[tuple[int, int]], k: int) -> list[tuple]:
    """(window, id, score) of the first ``k`` rows of other labels in each window [low, high].

    A row can reach a window if its bounds meet it and the k-th surest row inside does not beat
    it; it stays while it can reach one.
    """
    open_windows = sorted({w for w in windows if w[0] <= w[1]})
    if not open_windows:
        return []
    bottom, top = open_windows[0][0], max(w[1] for w in open_windows)

    def prune(low, high):
        keep = (high >= bottom) & (low <= top)
        near = np.flatnonzero(keep)
        if len(near) > k * len(open_windows):
            lo, hi, reach = low[near], high[near], np.zeros(len(near), bool)
            for a, b in open_windows:
                sure = lo[(lo >= a) & (hi <= b)]
                reach |= (hi >= max(a, _kth(sure, k))) & (lo <= b)
            keep[near] = reach
        return keep

    places, scores = block.scan(anchor, block.labels != label, prune)
    found, ids = [], block.ids[places]
    for w, (a, b) in enumerate(windows):
        inside = np.flatnonzero((scores >= a) & (scores <= b))
        found += [(w, int(ids[j]), int(scores[j])) for j in inside[_best(ids[inside], scores[inside], k)]]
    return found


def window_of(score: int) -> tuple[int, int]:
    """Whole scores s with LOWEST * score <= 100 * s <= HIGHEST * score; low > high if there is none."""
    return -(-LOWEST * score // 100), HIGHEST * score // 100


def _by_length(table: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Of each length of vectors: the rows that have it, and their vectors in doubles."""
    column = table["vector"].combine_chunks()
    flat, lengths = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), column.value_lengths().to_numpy(zero_copy_only=False)
    starts = np.cumsum(lengths) - lengths
    rows = {int(size): np.flatnonzero(lengths == size) for size in np.unique(lengths)}
    return {size: (k, flat[starts[k][:, None] + np.arange(size)].reshape(len(k), size)) for size, k in rows.items()}


def _tiles(anchors: DataFrame, rows: DataFrame, play, schema: str, n_anchors: int, n_rows: int) -> DataFrame:
    """``play(anchor's columns, block, anchor's vector)`` for every anchor and block. Both sides
    are dealt by place, so no key of theirs makes a hot tile; there are as many blocks as the
    session has shuffle partitions, or as many as ROWS asks for."""
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups, blocks = max(1, -(-n_anchors // ANCHORS)), max(partitions, -(-n_rows // ROWS))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda n: F.pmod(F.monotonically_increasing_id(), F.lit(n)).cast("int")
    left = anchors.withColumn("_group", dealt(groups)).withColumn("_block", every(blocks))
    right = rows.withColumn("_block", dealt(blocks)).withColumn("_group", every(groups))
    names = [c.split()[0] for c in schema.split(", ")]

    def tile(a: pa.Table, b: pa.Table) -> pa.Table:
        out, mine, theirs = [], _by_length(a), _by_length(b)
        asked = a.drop_columns(["vector"]).to_pylist()
        for size in mine.keys() & theirs.keys():
            k, vectors = theirs[size]
            block = Block(*(b[c].to_numpy()[k] for c in ("vec_id", "label")), whole(vectors))
            which, vectors = mine[size]
            columns = whole(vectors)
            if not block.within(columns):
                block, columns = Block(block.ids, block.labels, _objects(block.columns)), _objects(columns)
            for place, k in enumerate(which):
                out += play(asked[k], block, columns[:, place])
        clip = lambda v: min(max(v, _LONG[0]), _LONG[1])
        return pa.Table.from_arrays([pa.array([clip(r[k]) for r in out], pa.int64()) for k in range(len(names))], names=names)

    return left.groupBy("_group", "_block").cogroup(right.groupBy("_group", "_block")).applyInArrow(tile, schema)


def _first(found: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each key with their ``place`` from 1; tasks cut before the shuffle."""
    return found.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("place") <= k)


def hard_negatives(rows: DataFrame, vector: str = "embedding", label: str = "label", row_id: str = "vec_id") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), all long.

    Rows with a null id, label, vector or component, or one that is not finite, take no part; so
    do others with rows of another vector length only. Rows that repeat an id are rows of their
    own, but an id is an anchor once (its smallest label, then vector, counts) and never its own
    positive. Scores come in descending order, of equals the smaller id first; a score that does
    not fit a long is clipped to it before windows and ranks. No anchors, positives or rows in a window give no rows; other
    columns are left out whatever their names.
    """
    held = common.stage(usable(rows, vector, label, row_id), "vectors")
    n_rows = held.count()
    anchors = held.where(F.col("vec_id") % EVERY == 0).groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("a")).select("vec_id", "a.*")
    anchors = common.stage(anchors, "anchors")
    n_anchors = anchors.count()

    def near(anchor: dict, block: Block, columns: np.ndarray) -> list[tuple]:
        return [(anchor["vec_id"], *p) for p in positives(block, anchor["vec_id"], anchor["label"], columns, POSITIVES)]

    found = _tiles(anchors, held, near, "anchor_id long, positive_id long, positive_score long", n_anchors, n_rows)
    best = common.stage(_first(found, ["anchor_id"], [F.desc("positive_score"), F.asc("positive_id")], POSITIVES), "positives")
    asked = best.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.array_sort(F.collect_list(F.struct("place", "positive_id", "positive_score"))).alias("asked"))
    asked = anchors.join(asked, "vec_id")  # five numbers an anchor

    def hard(anchor: dict, block: Block, columns: np.ndarray) -> list[tuple]:
        windows = [window_of(p["positive_score"]) for p in anchor["asked"]]
        of = lambda w: (anchor["vec_id"], anchor["asked"][w]["place"], anchor["asked"][w]["positive_id"], anchor["asked"][w]["positive_score"])
        return [(*of(w), j, s) for w, j, s in negatives(block, anchor["label"], columns, windows, NEGATIVES)]

    schema = "anchor_id long, slot long, positive_id long, positive_score long, negative_id long, negative_score long"
    local = _tiles(asked, held, hard, schema, n_anchors, n_rows)
    ranked = _first(local, ["anchor_id", "slot"], [F.desc("negative_score"), F.asc("negative_id")], NEGATIVES)
    return ranked.select("anchor_id", "positive_id", F.col("place").cast("long").alias("rank"), "negative_id", "positive_score", "negative_score")


def query(spark, sf_dir: str) -> DataFrame:
    """op11: hard negatives of all embeddings."""
    return hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_dot_product(a.x, b.x)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5),
n AS (SELECT anchor_id, positive_id, positive_score, other AS negative_id, score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3"""
