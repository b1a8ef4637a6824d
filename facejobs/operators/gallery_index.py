"""An exact pruning index over a gallery that is too large to send to every task.

Members are grouped around pivots and cut into blocks, each with its centre c and radius r. By
the Cauchy-Schwarz inequality no member of a block scores more than ``x . c + |x| r`` with a face
x, so a block whose bound lies below the best score so far is never read. Blocks lie in files of
the shared storage; faces stay where they are, and tasks read the blocks that they need, keeping
a bounded number. The heads of the blocks (centre, radius, place) go to every task; how large a
block is follows from the bytes that heads may take.
"""

from __future__ import annotations

import uuid
from collections import OrderedDict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from facejobs.operators.linking import rows
from facejobs.params import DEFAULTS, Params

#: Members that serve as pivots at most, and members of a block at least (of the last of a cell, fewer).
PIVOTS, LEAST_BLOCK = 1024, 512
#: Bytes of faces that meet the blocks together.
FACES_BYTES = 64 << 20
#: Share of a score's scale by which a bound may be off for rounding.
SLACK = 1e-9

HEADS = "size int, n long, centre binary, radius double, path string, at long, length long"
BEST = "minus: double, at: long, person_id: string, name: string"


@dataclass(frozen=True)
class GalleryIndex:
    """A stored index; :func:`open_index` opens it in a later session."""

    spark: SparkSession
    folder: str

    @property
    def heads(self) -> DataFrame:
        return self.spark.read.schema(HEADS).parquet(f"{self.folder}/heads")


def _nearest(pivots: dict[int, np.ndarray]):
    @F.arrow_udf("int")
    def cell(column: pa.Array) -> pa.Array:
        found = np.zeros(len(column), np.int32)
        lengths = column.value_lengths().to_numpy(zero_copy_only=False)
        for size in np.unique(lengths):
            of = np.flatnonzero(lengths == size)
            if (near := pivots.get(int(size))) is not None:
                x = column.take(pa.array(of)).flatten().to_numpy(zero_copy_only=False).reshape(len(of), size)
                found[of] = (x @ near.T - (near**2).sum(axis=1) / 2).argmax(axis=1)  # the least distance
        return pa.array(found)

    return cell


def build_index(gallery: DataFrame, folder: str, params: Params = DEFAULTS) -> GalleryIndex:
    """Index of person_id, name, at, centroid (doubles, finite, not empty) in ``folder``.

    Of members with one and the same centroid only the first in gallery order can ever win, so
    one is kept. What reaches the driver is a count for each vector length and at most PIVOTS
    members. A cell of any size is cut into blocks by ranges, so none is one task's alone.
    """
    spark = gallery.sparkSession
    first = gallery.groupBy("centroid").agg(F.min(F.struct("at", "person_id", "name")).alias("m")).select("m.*", "centroid", F.size("centroid").alias("size"))
    first.write.parquet(f"{folder}/members")
    first = spark.read.parquet(f"{folder}/members")
    bytes_of = {r["size"]: (r["n"], 8 * r["size"]) for r in first.groupBy("size").agg(F.count("*").alias("n")).collect()}
    total = sum(n for n, _ in bytes_of.values())
    head_bytes = max(1, params.broadcast_bytes // 4)
    block = max(LEAST_BLOCK, -(-sum(n * b for n, b in bytes_of.values()) // head_bytes))
    chosen = first.orderBy(F.xxhash64("person_id"), "person_id").limit(min(PIVOTS, int(total**0.5) + 1)).collect()
    pivots = {size: np.array([r["centroid"] for r in chosen if r["size"] == size]) for size in {r["size"] for r in chosen}}

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(f"{folder}/blocks")
        store.create_dir(root, recursive=True)
        path, out, place, heads = f"{root}/{uuid.uuid4().hex}", None, 0, []
        held, key = [], None

        def close() -> None:
            nonlocal out, place
            held.sort(key=lambda m: m[:2])
            x = np.array([m[3] for m in held])
            centre = x.mean(axis=0)
            members = pa.RecordBatch.from_pydict({"at": [m[0] for m in held], "person_id": [m[1] for m in held], "name": pa.array([m[2] for m in held], pa.string())})
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, members.schema) as writer:
                writer.write_batch(members)
            data = x.tobytes() + sink.getvalue().to_pybytes()
            out = out or store.open_output_stream(path)
            out.write(data)
            heads.append((x.shape[1], len(x), centre.tobytes(), float(np.sqrt(((x - centre) ** 2).sum(axis=1)).max()), path, place, len(data)))
            place += len(data)
            held.clear()

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("size", "cell", "at", "person_id", "name")]
            for size, cell, at, person, name, x in zip(*columns, rows(batch.column("centroid"))):
                if held and (key != (size, cell) or len(held) >= block):
                    close()
                key = size, cell
                held.append((at, person, name, x))
        if held:
            close()
        if out:
            out.close()
        names = [c.split()[0] for c in HEADS.split(", ")]
        kinds = [pa.int32(), pa.int64(), pa.binary(), pa.float64(), pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([h[k] for h in heads], t) for k, t in enumerate(kinds)], names=names)

    celled = first.withColumn("cell", _nearest(pivots)(F.col("centroid")))
    order = ("size", "cell", F.xxhash64("person_id"))
    packed = celled.repartitionByRange(*order).sortWithinPartitions(*order).select("size", "cell", "at", "person_id", "name", "centroid")
    packed.mapInArrow(pack, HEADS).write.parquet(f"{folder}/heads")
    return GalleryIndex(spark, folder)


def open_index(spark: SparkSession, folder: str) -> GalleryIndex:
    return GalleryIndex(spark, folder)


class Blocks:
    """Blocks by number, the latest kept up to a number of bytes. A block is its matrix in
    doubles, and then its members as an Arrow stream."""

    def __init__(self, heads: list[tuple], folder: str, most_bytes: int):
        from pyarrow import fs

        self.store, _ = fs.FileSystem.from_uri(folder)
        self.heads, self.most, self.held, self.bytes = heads, most_bytes, OrderedDict(), 0

    def get(self, k: int) -> tuple[pa.Table, np.ndarray]:
        if k in self.held:
            self.held.move_to_end(k)
            return self.held[k]
        size, n, _, _, path, at, length = self.heads[k]
        with self.store.open_input_file(path) as f:
            f.seek(at)
            data = f.read(length)
        found = pa.ipc.open_stream(data[8 * size * n :]).read_all().combine_chunks(), np.frombuffer(data, np.float64, size * n).reshape(n, size)
        self.held[k] = found
        self.bytes += length
        while self.bytes > self.most and len(self.held) > 1:
            gone, _ = self.held.popitem(last=False)
            self.bytes -= self.heads[gone][6]
        return found


def search(faces: np.ndarray, numbers: list[int], centres: np.ndarray, radii: np.ndarray, blocks: Blocks) -> tuple[list, np.ndarray]:
    """Of each face its best (minus score, at, person_id, name) or None, and how many members it
    was compared with. ``numbers`` are the blocks of the centres."""
    best, score, compared = [None] * len(faces), np.full(len(faces), -np.inf), np.zeros(len(faces), np.int64)
    near = faces @ centres.T
    length = np.sqrt((faces**2).sum(axis=1))
    bound = near + length[:, None] * radii + SLACK * (1 + length[:, None] * (np.sqrt((centres**2).sum(axis=1)) + radii))
    home, seen = near.argmax(axis=1), np.zeros(near.shape, bool)

    def meet(b: int, who: np.ndarray) -> None:
        members, x = blocks.get(numbers[b])
        with np.errstate(invalid="ignore", over="ignore"):
            products = faces[who] @ x.T
        products[~np.isfinite(products)] = -np.inf
        compared[who] += len(x)
        k = products.argmax(axis=1)  # the first of equals in gallery order
        won = products[np.arange(len(who)), k]
        better = (won >= score[who]) & np.isfinite(won)
        for face, j, s in zip(who[better], k[better], won[better]):
            mine = (-float(s), *(members[c][int(j)].as_py() for c in ("at", "person_id", "name")))
            if best[face] is None or mine[:3] < best[face][:3]:
                best[face], score[face] = mine, s

    for b in np.unique(home):
        who = np.flatnonzero(home == b)
        seen[who, b] = True
        meet(b, who)
    for b in np.argsort(-bound.max(axis=0)):
        if len(who := np.flatnonzero((bound[:, b] >= score) & ~seen[:, b])):
            meet(b, who)
    return best, compared


def identify_by_index(detections: DataFrame, index: GalleryIndex, params: Params = DEFAULTS) -> DataFrame:
    """Detections with struct ``_best`` of their most similar member (null if there is none) and
    long ``_compared``. Vectors that are null, of a length that no member has, or not finite are
    compared with nobody. Nothing is shuffled."""
    heads = [tuple(r) for r in index.heads.where("n > 0").collect()]  # their bytes are bounded by how blocks are cut
    sizes = {size: [k for k, h in enumerate(heads) if h[0] == size] for size in {h[0] for h in heads}}
    folder, cache = index.folder, params.broadcast_bytes
    schema = StructType([*detections.schema, *StructType.fromDDL(f"_best struct<{BEST}>, _compared long")])
    vector = detections.columns.index("embedding")

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = Blocks(heads, folder, cache)
        of = {size: (np.array([np.frombuffer(heads[k][2]) for k in numbers]), np.array([heads[k][3] for k in numbers])) for size, numbers in sizes.items()}
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.column(vector).nbytes
            if size >= FACES_BYTES:
                yield from solve(held, blocks, of)
                held, size = [], 0
        if held:
            yield from solve(held, blocks, of)

    def solve(held: list[pa.RecordBatch], blocks: Blocks, of: dict) -> Iterator[pa.RecordBatch]:
        vectors = [v for batch in held for v in rows(batch.column(vector))]
        best, compared = [None] * len(vectors), np.zeros(len(vectors), np.int64)
        for length, (centres, radii) in of.items():
            who = np.array([k for k, v in enumerate(vectors) if v is not None and len(v) == length and np.isfinite(v).all()], int)
            if len(who):
                found, n = search(np.stack([vectors[k] for k in who]), sizes[length], centres, radii, blocks)
                compared[who] = n
                for k, b in zip(who, found):
                    best[k] = b
        start = 0
        kinds = pa.struct([("minus", pa.float64()), ("at", pa.int64()), ("person_id", pa.string()), ("name", pa.string())])
        for batch in held:
            mine = best[start : start + batch.num_rows]
            structs = pa.array([None if b is None else dict(zip(("minus", "at", "person_id", "name"), b)) for b in mine], kinds)
            yield pa.RecordBatch.from_arrays([*batch.columns, structs, pa.array(compared[start : start + batch.num_rows])], names=[*batch.schema.names, "_best", "_compared"])
            start += batch.num_rows

    return detections.mapInArrow(find, schema)
