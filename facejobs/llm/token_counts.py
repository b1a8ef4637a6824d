"""Token counts without ids: pieces counted once per distinct pre-token, then joined and summed.

Documents are read in blocks. A block keeps, per document, the frequencies of its pre-tokens
(as numbers into the block's own list) and asks for the piece counts of that list. Questions go
to buckets by a hash of the pre-token; a bucket counts each distinct pre-token once and answers
every block. Back at the block, the answers make a table, and a document's tokens are the sum
of frequency times table entry. A task takes its buckets one after the other, so it holds the
pre-tokens of one; there are more buckets where the session has more shuffle partitions. A block asks for a pre-token once, however often it has it, so
frequent words are no hot keys, and what is shuffled grows with distinct words, not with tokens.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facejobs.llm import common
from facejobs.llm.units import Units, units

FILE = "byte_bpe_50k.json"
LIMIT = 1024
BLOCK_BYTES = 16 << 20
#: Buckets for each shuffle partition of the session, and at least.
BUCKETS, LEAST_BUCKETS = 4, 256


def _squeeze(x: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers by byte planes, compressed."""
    return zstandard.compress(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _unsqueeze(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def n_buckets(spark: SparkSession) -> int:
    return max(LEAST_BUCKETS, BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions")))


def _pre_tokens(u: Units, cut: list[str]) -> tuple[dict[str, int], np.ndarray, np.ndarray]:
    """Numbers of the distinct pre-tokens, those of each unit in a row, and where each unit's begin."""
    number, flat, starts = {}, [], [0]
    for unit in cut:
        flat += [number.setdefault(x, len(number)) for x in u.pre_tokens(unit)]
        starts.append(len(flat))
    return number, np.array(flat, np.int64), np.array(starts, np.int64)


def blocks(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per block of about BLOCK_BYTES of text: each document's distinct pre-tokens as
    rising numbers into the block's list, their counts, and that list by bucket."""
    kinds = {"n_bytes": pa.list_(pa.int64()), "sizes": pa.list_(pa.int32()), "codes": pa.binary(), "counts": pa.binary(), "questions": pa.list_(pa.list_(pa.string()))}
    buckets = n_buckets(docs.sparkSession)

    def close(number: int, ids: pa.Array, n_bytes: list, bags: list[tuple], local: dict[str, int], u: Units) -> pa.RecordBatch:
        own, flat, starts = _pre_tokens(u, list(local))
        asked: list[list[str]] = [[] for _ in range(buckets)]
        for x in own:
            asked[zlib.crc32(x.encode()) % buckets].append(x)
        place = np.empty(len(own), np.int64)
        place[[own[x] for part in asked for x in part]] = np.arange(len(own))
        # (document, unit, count) of the block, then (document, pre-token, count), added up
        document = np.repeat(np.arange(len(bags)), [len(code) for code, _ in bags])
        unit, count = (np.concatenate([bag[k] for bag in bags]).astype(np.int64) for k in (0, 1))
        width = starts[unit + 1] - starts[unit]
        upto = np.cumsum(width)
        code = place[flat[np.repeat(starts[unit] - upto + width, width) + np.arange(width.sum())]]
        key, where = np.unique(np.repeat(document, width) << 40 | code, return_inverse=True)
        total = np.bincount(where, np.repeat(count, width), len(key)).astype(np.int64)
        document, code = key >> 40, key & ((1 << 40) - 1)
        step = np.diff(code, prepend=0)
        first = np.flatnonzero(np.diff(document, prepend=-1))
        step[first] = code[first]
        row = {"n_bytes": n_bytes, "sizes": np.bincount(document, minlength=len(bags)).tolist(), "codes": _squeeze(step), "counts": _squeeze(total), "questions": asked}
        columns = {"block": pa.array([number], pa.int64()), "doc_ids": pa.array([ids.to_pylist()], pa.list_(ids.type))}
        return pa.RecordBatch.from_pydict(columns | {k: pa.array([row[k]], t) for k, t in kinds.items()})

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, number, held = units(path), TaskContext.get().partitionId() << 32, 0
        ids, n_bytes, bags, local, kind = [], [], [], {}, None
        for batch in batches:
            kind = batch.column(0).type
            for doc, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                bag = Counter(u.cut(t or ""))
                code = np.fromiter((local.setdefault(x, len(local)) for x in bag), np.int64, len(bag))
                ids.append(doc)
                n_bytes.append(len((t or "").encode()))
                bags.append((code, np.fromiter(bag.values(), np.int64, len(bag))))
                held += n_bytes[-1]
                if held >= BLOCK_BYTES:
                    yield close(number, pa.array(ids, kind), n_bytes, bags, local, u)
                    number, held = number + 1, 0
                    ids, n_bytes, bags, local = [], [], [], {}
        if ids:
            yield close(number, pa.array(ids, kind), n_bytes, bags, local, u)

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(read, f"block long, doc_ids array<{common.type_of(rows, 'doc_id')}>, n_bytes array<long>, sizes array<int>, codes binary, counts binary, questions array<array<string>>")


def answers(stored: DataFrame, path: str) -> DataFrame:
    """(block, bucket, pieces): the piece counts of each block's questions, by bucket. All
    questions of a bucket meet in one task, which counts each distinct pre-token once."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, known, now = units(path), {}, None
        for batch in batches:
            rows = []
            for bucket, asked in zip(batch.column("bucket").to_pylist(), batch.column("asked").to_pylist()):
                if bucket != now:
                    known, now = {}, bucket
                new = [x for x in asked if x not in known]
                known.update(zip(new, u.count(new)))
                rows.append([known[x] for x in asked])
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("bucket"), pa.array(rows, pa.list_(pa.int32()))], names=["block", "bucket", "pieces"])

    asked = stored.select("block", F.posexplode("questions").alias("bucket", "asked")).where(F.size("asked") > 0)
    return asked.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(count, "block long, bucket int, pieces array<int>")


def counts(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_bytes, n_tokens) for each row of ``docs``; doc_id of any type, the others long.

    Null text counts as empty: 0 and 0. Repeated rows stay; an empty table gives no rows; other
    columns are left out whatever their names; a text longer than a block is a block of its own.
    """
    stored = common.stage(blocks(docs, path, text, doc_id), "token-blocks")
    table = answers(stored, path).groupBy("block").agg(F.array_sort(F.collect_list(F.struct("bucket", "pieces"))).alias("answers"))
    table = table.select("block", F.flatten(F.col("answers.pieces")).alias("pieces"))

    @F.arrow_udf("array<long>")
    def sums(sizes: pa.Array, codes: pa.Array, freqs: pa.Array, pieces: pa.Array) -> pa.Array:
        rows = []
        for k in range(len(sizes)):
            size = np.array(sizes[k].as_py(), np.int64)
            step, n = _unsqueeze(codes[k].as_py()), _unsqueeze(freqs[k].as_py())
            starts = np.concatenate([[0], np.cumsum(size)])
            total = np.concatenate([[0], np.cumsum(step)])
            code = total[1:] - np.repeat(total[starts[:-1]], size)
            each = np.concatenate([[0], np.cumsum(pieces[k].values.to_numpy()[code] * n)]) if len(code) else np.zeros(1, np.int64)
            rows.append(each[starts[1:]] - each[starts[:-1]])
        return pa.array(rows, pa.list_(pa.int64()))

    # left: a block of empty texts alone has asked nothing
    joined = stored.select("block", "doc_ids", "n_bytes", "sizes", "codes", "counts").join(table, "block", "left")
    summed = joined.select(F.arrays_zip("doc_ids", "n_bytes", sums("sizes", "codes", "counts", "pieces").alias("n_tokens")).alias("rows"))
    return summed.select(F.explode("rows").alias("row")).select(F.col("row.doc_ids").alias("doc_id"), "row.n_bytes", "row.n_tokens")


def query(spark, sf_dir: str) -> DataFrame:
    """op7: bytes and tokens of every document."""
    common.small_batches(spark)
    found = counts(common.documents(spark, sf_dir), common.tokenizer_file(FILE))
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
