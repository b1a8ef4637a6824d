"""SimHash near copies: fingerprints of word shingles, linked by multi-index hashing.

Fingerprints within Hamming distance d share one of s segments up to d // s bits. So each
distinct fingerprint probes, for each segment, the small Hamming ball around that segment's
value in a table of segment values; matches are verified over all 64 bits. Of two values that
differ, only the one without the lowest differing bit probes, which halves the balls.

Copies collapse before linking. A segment value that many distinct fingerprints share is keyed
more finely, so no bucket is compared pair by pair: the rest of the fingerprint is cut into
2 d parts, and two that differ in d bits at most agree on some d of those parts.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facejobs.llm import common, graph

BITS, SEED = 64, 42
WORDS, DISTANCE, SEGMENTS = 3, 3, 2
#: Distinct fingerprints that share a segment value; above, the value is keyed more finely.
CROWD = 256


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """XXH64 of each shingle in order, repeats included; a text of fewer words is one shingle."""
    found = text.encode().lower().split()
    if not found:
        return np.empty(0, np.uint64)
    line, ends, at = b" ".join(found), [], -1
    for w in found:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends[:-1])]
    n = max(1, len(found) - words + 1)
    digest = xxhash.xxh64_intdigest
    last = ends[min(words, len(found)) - 1 :]
    return np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts[:n], last)), np.uint64, n)


def print_of(hashes: np.ndarray) -> int:
    """Unsigned 64-bit number: a bit is set if it is in over half of the hashes."""
    n = len(hashes)
    votes = np.zeros(BITS, np.int64)
    for k in range(0, n, 1 << 15):
        part = hashes[k : k + (1 << 15)].astype(">u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > n).tobytes(), "big")


def fingerprint(text: str, words: int = WORDS) -> int:
    """The SimHash of a text's shingles."""
    return print_of(shingles(text, words))


def fingerprints(docs: DataFrame, text: str = "text", words: int = WORDS, out: str = common.RESULT) -> DataFrame:
    """Adds long ``out``: the fingerprint's bits. Null text counts as empty and gives 0, as does
    any text without words; texts of fewer than ``words`` words are one shingle."""

    @F.arrow_udf("long")
    def simhash(column: pa.Array) -> pa.Array:
        found = common.texts(column)
        return pa.array(np.fromiter((fingerprint(x, words) for x in found), np.uint64, len(found)).view(np.int64), pa.int64())

    return docs.withColumn(out, simhash(F.col(text)))


def _cut(value: Column, low: int, width: int) -> Column:
    return F.shiftrightunsigned(value, low).bitwiseAND((1 << width) - 1)


def links(distinct: DataFrame, distance: int = DISTANCE, segments: int = SEGMENTS, crowd: int = CROWD) -> DataFrame:
    """(u, v): all pairs u < v of the distinct longs in column ``fp`` within ``distance`` bits."""
    width, radius = BITS // segments, distance // segments
    balls = [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(width), r)]
    parts = 2 * distance

    def finer(segment: int, fp: Column) -> Column:
        """Keys of which fingerprints within ``distance`` outside the segment share one."""
        rest = BITS - width
        turned = fp if segment == segments - 1 else F.shiftrightunsigned(fp, (segment + 1) * width).bitwiseOR(F.shiftleft(fp, BITS - (segment + 1) * width))
        edges = [rest * k // parts for k in range(parts + 1)]
        masks = [((1 << edges[k + 1]) - 1) ^ ((1 << edges[k]) - 1) for k in range(parts)]
        return F.array(*(F.xxhash64(F.lit(n), turned.bitwiseAND(sum(masks[k] for k in chosen))) for n, chosen in enumerate(combinations(range(parts), parts - distance))))

    def per_segment() -> DataFrame:
        """A row for each fingerprint and segment: that segment's value."""
        return distinct.select("fp", F.explode(F.array(*(F.struct(F.lit(s).alias("s"), _cut(F.col("fp"), s * width, width).alias("value")) for s in range(segments)))).alias("x")).select("fp", "x.*")

    key = lambda s, value: F.shiftleft(s.cast("long"), width).bitwiseOR(value)
    table = per_segment().select("fp", "s", key(F.col("s"), F.col("value")).alias("key"))
    flips = F.filter(F.array(*map(lambda m: F.lit(m).cast("long"), balls)), lambda m: F.col("value").bitwiseAND(m.bitwiseAND(-m)) == 0)
    probes = per_segment().select("fp", "s", F.explode(flips).alias("flip"), "value").select("fp", "s", "flip", key(F.col("s"), F.col("value").bitwiseXOR(F.col("flip"))).alias("key"))
    hot = common.stage(table.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > crowd).select("key"), "crowds")

    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= distance
    once = (F.col("flip") != 0) | (F.col("u") < F.col("v"))
    fine = F.coalesce(*(F.when(F.col("s") == s, finer(s, F.col("fp"))) for s in range(segments)))
    found = [probes.join(hot, "key", "left_anti").select("key", "flip", F.col("fp").alias("u")).join(table.select("key", F.col("fp").alias("v")), "key").where(once & near)]
    if not hot.isEmpty():
        deep = lambda d, name, *more: d.join(hot, "key", "left_semi").select("key", *more, F.col("fp").alias(name), F.explode(fine).alias("finer"))
        found.append(deep(probes, "u", "flip").join(deep(table, "v"), ["key", "finer"]).where(once & near))
    pairs = found[0].select("u", "v")
    for more in found[1:]:
        pairs = pairs.unionAll(more.select("u", "v"))
    return pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def near_copies(prints: DataFrame, distance: int = DISTANCE, segments: int = SEGMENTS, crowd: int = CROWD, doc_id: str = "doc_id", fp: str = "fp") -> DataFrame:
    """(fp, component_id) for each distinct fingerprint of a stored table of (doc_id, fp).

    component_id is the smallest doc_id among all fingerprints reachable over links; null only
    where all those ids are null. An empty table gives no rows.
    """
    smallest = common.stage(prints.groupBy(F.col(fp).alias("fp")).agg(F.min(doc_id).alias("first")), "fingerprints")
    roots = graph.components(links(smallest.select("fp"), distance, segments, crowd))
    placed = smallest.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    ids = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    return placed.join(ids, "root").select("fp", "component_id")


def components(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, fp, component_id), a row for each row of ``docs``; repeated rows stay."""
    prints = common.stage(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))).select("doc_id", F.col(common.RESULT).alias("fp")), "simhash")
    return prints.join(near_copies(prints), "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row of each group of near copies, that of the smallest doc_id, columns as they were.

    Among rows that repeat this id any one stays; null ids come last. Texts without words form
    one group, as their fingerprints are equal.
    """
    row, fp = f"{common.RESULT}_row", f"{common.RESULT}_fp"
    held = common.stage(fingerprints(docs, text, out=fp).withColumn(row, F.monotonically_increasing_id()), "near-dedup")
    prints = held.select(F.col(row).alias("row"), F.col(doc_id).alias("doc_id"), F.col(fp).alias("fp"))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")).alias("best")
    smallest = prints.groupBy("fp").agg(best)
    groups = near_copies(prints.select(F.col("row").alias("doc_id"), "fp"))  # by row: ids may be null or repeat
    first = smallest.join(groups, "fp").groupBy("component_id").agg(F.min("best").alias("best")).select(F.col("best.row").alias(row))
    return held.join(first, row, "left_semi").drop(row, fp)


def query(spark, sf_dir: str) -> DataFrame:
    """op4: fingerprint and group of every document."""
    common.small_batches(spark)
    found = components(common.documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
