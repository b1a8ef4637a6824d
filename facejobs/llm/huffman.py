"""Token ids in files of canonical, length-limited Huffman codes.

Documents are sorted by id and encoded in blocks. Codes come from the global counts of ids:
package-merge gives the best code lengths up to a limit, and lengths alone fix the canonical
codes, so the file set holds them as one small table. A block is decoded by itself through a
lookup table; bit offsets of every 256th id let its parts be decoded side by side.

Files, below one folder: ``codes`` (symbol, length) and ``blocks`` (start, ids and lengths of its
documents, number of ids, checkpoints, bits), both Parquet, written and read by Spark.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facejobs.llm import common
from facejobs.llm.units import units

FILE = "byte_bpe_50k.json"
END_ID = 2
#: Longest code in bits, where the number of symbols allows it.
LONGEST = 16
BLOCK_IDS, STRIDE = 1 << 19, 256
#: Ids encoded at a time, a multiple of STRIDE: few enough for a core's own cache.
PIECE = 1 << 15


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Best code lengths of at most ``longest`` bits for positive counts, by package-merge."""
    n = len(counts)
    if n <= 1:
        return np.ones(n, np.int64)
    if n > 1 << longest:
        raise ValueError(f"{n} symbols do not fit codes of {longest} bits")
    order = np.argsort(counts, kind="stable")
    leaves = counts[order].astype(np.float64)
    levels, packages = [], np.zeros(0)
    for _ in range(longest):
        weight = np.concatenate([leaves, packages])
        by = np.argsort(weight, kind="stable")
        levels.append(by < n)
        weight = weight[by]
        packages = weight[: len(weight) // 2 * 2].reshape(-1, 2).sum(1)
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for leaf in reversed(levels):
        k = int(leaf[:take].sum())
        lengths[order[:k]] += 1
        take = 2 * (take - k)
    return lengths


class Codes:
    """Canonical codes of symbols with given lengths, and the table that decodes them."""

    def __init__(self, symbols: np.ndarray, lengths: np.ndarray) -> None:
        order = np.lexsort((symbols, lengths))
        self.symbols, self.lengths = symbols[order], lengths[order]
        self.longest = int(self.lengths[-1]) if len(order) else 1
        spans = 1 << (self.longest - self.lengths)
        first = np.concatenate([[0], np.cumsum(spans)[:-1]]) if len(order) else np.zeros(0, np.int64)
        size = int(self.symbols.max()) + 1 if len(order) else 0
        #: Codes from the highest bit of a word on, and their lengths.
        self.left, self.bits = np.zeros(size, np.uint64), np.zeros(size, np.int64)
        self.left[self.symbols] = first.astype(np.uint64) << np.uint64(64 - self.longest)
        self.bits[self.symbols] = self.lengths
        self.table = np.zeros(1 << self.longest, np.uint32)
        entry = (self.symbols << 8 | self.lengths).astype(np.uint32)
        self.table[: int(spans.sum())] = np.repeat(entry, spans)

    def encode(self, ids: np.ndarray) -> tuple[bytes, bytes]:
        """Bits of the ids, and the bit offsets of every STRIDE-th as 64-bit numbers."""
        if not len(ids):
            return b"", b""
        words = np.zeros((len(ids) * self.longest >> 6) + 2, np.uint64)
        checkpoints, end = [], 0
        for k in range(0, len(ids), PIECE):
            piece = ids[k : k + PIECE]
            bits, left = self.bits[piece], self.left[piece]
            ends = np.cumsum(bits)
            ends += end
            at = ends - bits
            word, skip = at >> 6, at & 63
            head = left >> skip.astype(np.uint64)
            starts = np.append(0, np.flatnonzero(word[1:] != word[:-1]) + 1)
            words[word[starts]] |= np.bitwise_or.reduceat(head, starts)
            over = np.flatnonzero(skip + bits > 64)
            words[word[over] + 1] |= left[over] << (64 - skip[over]).astype(np.uint64)
            checkpoints.append(at[::STRIDE])
            end = int(ends[-1])
        return words[: end + 63 >> 6].astype(">u8").tobytes()[: end + 7 >> 3], np.concatenate(checkpoints).astype("<u8").tobytes()

    def decode(self, bits: bytes, checkpoints: bytes, n: int) -> np.ndarray:
        """The n ids, all stretches between checkpoints step by step side by side."""
        if not n:
            return np.zeros(0, np.int32)
        raw = np.frombuffer(bits + bytes(8), np.uint8).astype(np.uint32)
        four = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
        at = np.frombuffer(checkpoints, "<u8").astype(np.int64)
        last, shift = len(bits) * 8, np.uint32(32 - self.longest)
        out = np.empty((len(at), STRIDE), np.int32)
        for k in range(STRIDE):
            found = self.table[(four[at >> 3] << (at & 7).astype(np.uint32)) >> shift]
            out[:, k] = found >> 8
            at = np.minimum(at + (found & 255), last)
        return out.ravel()[:n]


def _batch(columns: dict, kinds: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[k], t) for k, t in kinds.items()], names=list(kinds))


def _raw(doc: pa.DataType) -> dict:
    return {"part": pa.int32(), "seq": pa.int64(), "before": pa.int64(), "doc_ids": pa.list_(doc), "lengths": pa.list_(pa.int64()), "ids": pa.binary()}


def _files(doc: pa.DataType) -> dict:
    return {"start": pa.int64(), "doc_ids": pa.list_(doc), "lengths": pa.list_(pa.int64()), "n": pa.int64(), "checkpoints": pa.binary(), "bits": pa.binary()}


def _stored(doc: str) -> str:
    return f"start long, doc_ids array<{doc}>, lengths array<long>, n long, checkpoints binary, bits binary"


def token_blocks(docs: DataFrame, path: str, end_id: int = END_ID, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Blocks of ids in ascending order of doc_id (of any type that orders; null first; repeated
    ids by a hash of their text): part and seq order the blocks, ``before`` counts the part's ids
    before the block. Ranges are cut by id, hash and row, so no id is one unsplit key."""

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, part, seq, before, held = units(path), TaskContext.get().partitionId(), 0, 0, 0
        kind = "<u2" if max(u.size, end_id + 1) <= 1 << 16 else "<u4"
        docs, lengths, ids = [], [], []

        def close(doc: pa.DataType) -> pa.RecordBatch:
            row = {"part": part, "seq": seq, "before": before, "doc_ids": docs, "lengths": lengths, "ids": np.concatenate(ids).astype(kind).tobytes()}
            return _batch({k: [v] for k, v in row.items()}, _raw(doc))

        for batch in common.slices(batches, "text", 8 << 20):
            doc_type = batch.schema.field("doc_id").type
            for doc, found in zip(batch.column("doc_id").to_pylist(), u.encode_column(batch.column("text"))):
                docs.append(doc)
                ids.append(np.append(found, np.int32(end_id)))
                lengths.append(len(found) + 1)
                held += len(found) + 1
                if held >= BLOCK_IDS:
                    yield close(doc_type)
                    seq, before, held = seq + 1, before + held, 0
                    docs, lengths, ids = [], [], []
        if docs:
            yield close(doc_type)

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("h"), F.monotonically_increasing_id().alias("row"))
    order = ("doc_id", "h", "row")
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    return ranged.mapInArrow(read, f"part int, seq long, before long, doc_ids array<{common.type_of(rows, 'doc_id')}>, lengths array<long>, ids binary")


def write(docs: DataFrame, path: str, folder: str, end_id: int = END_ID, text: str = "text", doc_id: str = "doc_id") -> None:
    """Encode ``docs`` into ``folder``. What reaches the driver is bounded: a count per id of the
    vocabulary, and the number of ids per part.

    Null and empty texts hold the end id alone, repeated rows are stored as often as they occur,
    an empty table gives files without rows, a text of any length is one entry of one block, and
    other columns are left out whatever their names.
    """
    spark = docs.sparkSession
    raw = common.stage(token_blocks(docs, path, end_id, text, doc_id), "ids")
    u = units(path)
    kind = "<u2" if max(u.size, end_id + 1) <= 1 << 16 else "<u4"

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for x in batch.column("ids"):
                n = np.bincount(np.frombuffer(x.as_buffer(), kind))
                total = np.pad(total, (0, max(0, len(n) - len(total))))
                total[: len(n)] += n
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(total)), pa.array(total[total > 0])], names=["symbol", "n"])

    rows = raw.select("ids").mapInArrow(count, "symbol long, n long").groupBy("symbol").agg(F.sum("n").alias("n")).orderBy("symbol").collect()
    symbols, counts = (np.array([r[k] for r in rows], np.int64) for k in ("symbol", "n"))
    lengths = code_lengths(counts, max(LONGEST, int(len(symbols)).bit_length() + 1))
    spark.createDataFrame([(int(s), int(n)) for s, n in zip(symbols, lengths)], "symbol int, length int").coalesce(1).write.parquet(f"{folder}/codes")
    parts = raw.select("part", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()
    offset, at = {}, 0
    for r in parts:
        offset[r["part"]], at = at, at + r["n"]

    doc = raw.schema["doc_ids"].dataType.elementType.simpleString()

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes(symbols, lengths)
        for batch in batches:
            for r in range(batch.num_rows):
                ids = np.frombuffer(batch.column("ids")[r].as_buffer(), kind)
                bits, checkpoints = codes.encode(ids)
                row = {"start": offset[batch.column("part")[r].as_py()] + batch.column("before")[r].as_py(), "n": len(ids), "checkpoints": checkpoints, "bits": bits}
                files = _files(batch.schema.field("doc_ids").type.value_type)
                yield _batch({k: [row[k]] if k in row else [batch.column(k)[r].as_py()] for k in files}, files)

    raw.mapInArrow(encode, _stored(doc)).write.option("compression", "none").parquet(f"{folder}/blocks")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, ids) of each document in the files; ids array<int> with the end id."""
    return _read(spark, folder, lambda ids: pa.array(list(ids), pa.list_(pa.int32())), "ids array<int>")


def _read(spark: SparkSession, folder: str, made, column: str) -> DataFrame:
    """``made`` turns the ids of a block's documents into the column that is returned."""
    rows = spark.read.schema("symbol int, length int").parquet(f"{folder}/codes").collect()  # at most one per id of the vocabulary
    symbols, lengths = (np.array([r[k] for r in rows], np.int64) for k in ("symbol", "length"))

    def decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes(symbols, lengths)
        for batch in batches:
            for r in range(batch.num_rows):
                cell = lambda k: batch.column(k)[r]  # noqa: E731, B023
                ids = codes.decode(cell("bits").as_py(), cell("checkpoints").as_py(), cell("n").as_py())
                sizes = np.array(cell("lengths").as_py(), np.int64)
                starts = np.cumsum(sizes) - sizes
                parts = np.split(ids, starts[1:])
                yield pa.RecordBatch.from_arrays([cell("doc_ids").values, pa.array(cell("start").as_py() + starts), pa.array(sizes), made(parts)], names=["doc_id", "start", "n_tokens", column.split()[0]])

    blocks = spark.read.parquet(f"{folder}/blocks")
    doc = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    return blocks.mapInArrow(decode, f"doc_id {doc}, start long, n_tokens long, {column}")


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files."""
    crc = lambda parts: pa.array((zlib.crc32(p.astype("<u4").tobytes()) for p in parts), pa.int64())
    return _read(spark, folder, crc, "ids_crc32 long")


def query(spark, sf_dir: str) -> DataFrame:
    """op8: write every document's ids in the file format, read the files back, digest them."""
    common.small_batches(spark)
    folder = common.new_path(spark, "token-files")
    write(common.documents(spark, sf_dir), common.tokenizer_file(FILE), folder)
    return digests(spark, folder)
