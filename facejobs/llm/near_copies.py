"""Near copies by SimHash, completed to exact Jaccard similarity of word shingle sets.

SimHash with multi-index hashing (:mod:`facejobs.llm.simhash`) over five-word shingles proposes
pairs, which are verified on their whole sets. Fingerprints within 3 bits reach only part of the
texts of similarity 0.8: those differ in some 10 of 64 bits, too many for small Hamming balls. So
the rest is found by prefix filtering: if two sets are similar enough, the first few of each in
any one order share a shingle: of a set of n, the first n - ceil(t n) + 1. The sets meet by the
shingles of these prefixes, and every pair that meets is verified too; none is missed. The order
puts shingles that are frequent in a sample last, which bears on speed only, never on the pairs
found.

Equal sets collapse first. Then each set is compared with the first of its fingerprint and of
each of its shingles, and once more with a leader drawn for each shingle that sets still apart
share; every such round is linear. Only sets that are not joined by this are paired with each
other. Of these, pairs that cannot be similar are never made: a set's
parity map has a bit for each residue of its hashes, set where an odd number of them fall. Two maps
differ in no more bits than the sets differ in shingles, so too many differing bits rule a pair out,
and no similar pair is lost. Sets of more than about 1,100 shingles fill the map; their pairs go on
to the comparison of whole sets. Sets, and the shingles of prefixes, are told apart by 64-bit
hashes; pairs are verified on 32 bits of each shingle's hash, which halves what is shuffled: two
sets of 500 shingles share a false one with a chance of 6 in 100,000. So pairs are found exactly up
to that chance, which bears on those whose similarity lies within one shingle of the limit.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from facejobs.llm import common, graph, simhash

WORDS = 5
#: Least similarity, as a fraction.
SIMILARITY = (4, 5)
#: Documents looked at for frequent shingles, and how many of these are ordered last at most.
LOOKED_AT, FREQUENT = 10_000, 1 << 16
#: Further rounds in which sets are compared with one leader of each of their shingles.
MORE_LEADERS = 1
#: 64-bit words of a set's parity map.
MAP_WORDS = 8


def _set(text: str, words: int) -> np.ndarray:
    return np.unique(simhash.shingles(text, words))


def parity(hashes: np.ndarray) -> np.ndarray:
    """The parity map of a set of distinct hashes."""
    bits = 64 * MAP_WORDS
    odd = np.bincount((hashes % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def frequent(docs: DataFrame, text: str = "text", words: int = WORDS) -> np.ndarray:
    """Shingles that several documents of a sample share, rarest first."""

    @F.arrow_udf("array<long>")
    def sets(column: pa.Array) -> pa.Array:
        return pa.array([_set(x, words).view(np.int64) for x in common.texts(column)], pa.list_(pa.int64()))

    fraction = min(1.0, LOOKED_AT / max(1, docs.count()))
    found = docs.select(F.col(text).alias("text")).sample(fraction, simhash.SEED).select(F.explode(sets("text")).alias("key"))
    rows = found.groupBy("key").agg(F.count("*").alias("n")).where("n > 2").orderBy(F.desc("n"), "key").limit(FREQUENT).select("key").collect()
    return np.array([r["key"] for r in reversed(rows)], np.int64).view(np.uint64)


def shingled(docs: DataFrame, last: np.ndarray, text: str = "text", words: int = WORDS, out: str = common.RESULT) -> DataFrame:
    """Adds ``out``: the set's id, size, prefix, SimHash and parity map. A text without words is the empty set, id 0."""
    over, under = SIMILARITY
    rank = np.argsort(last)
    ordered = last[rank]

    @F.arrow_udf("struct<id:long,n:int,prefix:array<long>,fp:long,map:array<long>>")
    def prefixes(column: pa.Array) -> pa.Array:
        ids, sizes, firsts, prints, maps = [], [], [], [], []
        for x in common.texts(column):
            hashes = simhash.shingles(x, words)
            prints.append(simhash.print_of(hashes))
            hashes = np.unique(hashes)
            n = len(hashes)
            maps.append(parity(hashes))
            ids.append(xxhash.xxh3_64_intdigest(hashes.tobytes()) if n else 0)
            if len(ordered) and n:
                at = np.minimum(np.searchsorted(ordered, hashes), len(ordered) - 1)
                late = ordered[at] == hashes
                hashes = np.concatenate([hashes[~late], last[np.sort(rank[at[late]])]])
            sizes.append(n)
            firsts.append(hashes[: n - -(-over * n // under) + 1 if n else 0].view(np.int64))
        return common.struct(id=pa.array(np.array(ids, np.uint64).view(np.int64)), n=pa.array(sizes, pa.int32()), prefix=pa.array(firsts, pa.list_(pa.int64())), fp=pa.array(np.array(prints, np.uint64).view(np.int64)), map=pa.array(maps, pa.list_(pa.int64())))

    return docs.withColumn(out, prefixes(F.col(text)))


def _enough(common_size: Column, a: Column, b: Column) -> Column:
    """Whether sets of sizes ``a`` and ``b`` that share so many are similar enough."""
    over, under = SIMILARITY
    return common_size * (over + under) >= (a + b) * over


def _may(a: str, b: str) -> Column:
    """What holds where a similar pair of structs (id, n, pos) meets by its first common shingle."""
    left = lambda x: F.col(f"{x}.n") - F.col(f"{x}.pos")
    return _enough(F.least(left(a), left(b)), F.col(f"{a}.n"), F.col(f"{b}.n"))


def _maps_allow(a: str, b: str) -> Column:
    """Whether structs (n, map) differ in few enough bits for their sets to be similar."""
    over, under = SIMILARITY
    x, y = F.col(f"{a}.map"), F.col(f"{b}.map")
    differ = sum((F.bit_count(x[k].bitwiseXOR(y[k])) for k in range(MAP_WORDS)), F.lit(0))
    return differ * (over + under) <= (F.col(f"{a}.n") + F.col(f"{b}.n")) * (under - over)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the (u, v) whose whole ``sets`` (id, shingles) are similar enough."""
    of = lambda name: sets.select(F.col("id").alias(name), F.col("shingles").alias(f"{name}_set"))
    both = F.size(F.array_intersect("u_set", "v_set"))
    return pairs.join(of("u"), "u").join(of("v"), "v").where(_enough(both, F.size("u_set"), F.size("v_set"))).select("u", "v")


def links(held: DataFrame, first_row: DataFrame, words: int = WORDS) -> DataFrame:
    """(u, v): ids of similar sets, enough of them to join all that similar pairs join.

    ``held`` has a row per text: row, id, n, prefix, fp, map, text; ``first_row`` one per set: id, row.
    No rows, and texts without words, give no links; rows that repeat a text are one set already.
    Texts are shingled again only for sets that meet another, so that whole sets are never stored
    for all; and where few do, their rows are broadcast and no text is shuffled.
    """

    @F.arrow_udf("array<int>")
    def whole(column: pa.Array) -> pa.Array:
        return pa.array([np.unique(_set(x, words).astype(np.uint32)).view(np.int32) for x in common.texts(column)], pa.list_(pa.int32()))

    def checked(pairs: DataFrame) -> DataFrame:
        pairs = common.stage(pairs.distinct(), "pairs")
        met = pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct().join(first_row, "id").select("row")
        met = common.stage(met, "met")
        sets = common.stage(held.select("row", "id", "text").join(common.sized(met), "row", "left_semi").select("id", whole("text").alias("shingles")), "met-sets")
        similar = common.stage(verified(pairs, sets), "similar")
        common.discard(pairs, met, sets)
        return similar

    pair = lambda a, b: (F.least(a, b).alias("u"), F.greatest(a, b).alias("v"))
    one = held.select("row", "id", "n", "prefix", "fp", "map").join(common.sized(first_row.select("row")), "row", "left_semi")
    prints = common.stage(one.select("id", "fp", "map"), "prints")
    first_of = common.stage(prints.groupBy("fp").agg(F.min("id").alias("first")), "first-of-print")
    same = prints.join(first_of, "fp").where(F.col("id") != F.col("first")).select(*pair("id", "first"))
    near = simhash.links(first_of.select("fp"))
    named = lambda name: first_of.select(F.col("fp").alias(name), F.col("first").alias(f"{name}_first"))
    by_print = same.unionAll(near.join(named("u"), "u").join(named("v"), "v").select(*pair("u_first", "v_first")))

    # one shuffle of narrow rows finds both the shingles that several sets share and their leaders
    entries = one.select("id", "n", F.posexplode("prefix").alias("pos", "key"))
    of_key = Window.partitionBy("key")
    many = entries.withColumn("many", F.count("*").over(of_key))
    for c in ("n", "id", "pos"):
        many = many.withColumn(f"leader_{c}", F.first(c).over(of_key.orderBy("n", "id")))
    set_of = lambda prefix="": F.struct(*(F.col(f"{prefix}{c}").alias(c) for c in ("n", "id", "pos")))
    shared = common.stage(many.where("many > 1").select("key", set_of().alias("x"), set_of("leader_").alias("leader")), "shared-shingles")
    to_leader = shared.where((F.col("x.id") != F.col("leader.id")) & _may("x", "leader")).select(*pair("x.id", "leader.id"))
    found = checked(by_print.unionAll(to_leader))

    left = _unjoined(shared.select("key", "x"), found, prints.select("id", "map"))
    common.discard(shared)
    for turn in range(MORE_LEADERS):
        leaders = left.groupBy("key").agg(F.min_by(F.struct("x", "root"), F.xxhash64(F.lit(turn), "x.id", "key")).alias("l")).select("key", "l.*").withColumnsRenamed({"x": "leader", "root": "leader_root"})
        tried = left.join(leaders, "key").where((F.col("root") != F.col("leader_root")) & _may("x", "leader") & _maps_allow("x", "leader"))
        found = common.stage(found.unionAll(checked(tried.select(*pair("x.id", "leader.id")))), "found")
        before, left = left, _unjoined(left.select("key", "x"), found)
        common.discard(before)
    a, b = left.select("key", F.col("x").alias("a"), F.col("root").alias("ra")), left.select("key", F.col("x").alias("b"), F.col("root").alias("rb"))
    rest = a.join(b, "key").where((F.col("ra") < F.col("rb")) & _may("a", "b") & _maps_allow("a", "b")).select(*pair("a.id", "b.id"))
    found = common.stage(found.unionAll(checked(rest)), "similar")
    common.discard(left, prints, first_of)
    return found


def _unjoined(shared: DataFrame, found: DataFrame, maps: DataFrame | None = None) -> DataFrame:
    """(key, x, root): those rows of ``shared`` (key, x) whose shingle is one of sets that ``found``
    has not all joined. ``maps`` (id, map) completes the structs x."""
    edges = common.stage(graph.components(found), "roots")
    roots = edges.select(F.col("node").alias("id"), F.col("root").alias("now"))
    rooted = shared.withColumn("id", F.col("x.id")).join(roots, "id", "left").select("key", "x", "id", F.coalesce("now", "id").alias("root"))
    mixed = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    kept = rooted.join(mixed, "key", "left_semi")
    if maps is not None:
        kept = kept.join(maps, "id").withColumn("x", F.struct("x.n", "x.id", "x.pos", "map"))
    left = common.stage(kept.select("key", "x", "root"), "unjoined")
    common.discard(edges)
    return left


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = WORDS) -> DataFrame:
    """One row of each group of near copies, that of the smallest doc_id, columns as they were.

    Groups are what pairs of similarity :data:`SIMILARITY` or more join. Among rows that repeat
    an id any one stays; null ids come last. Texts without words form one group.
    """
    row, found = f"{common.RESULT}_row", f"{common.RESULT}_set"
    held = common.stage(shingled(docs, frequent(docs, text, words), text, words, found).withColumn(row, F.monotonically_increasing_id()), "near-copies")
    best = F.min(F.struct(F.col(doc_id).isNull().alias("last"), F.col(doc_id).alias("doc_id"), F.col(row).alias("row"))).alias("best")
    smallest = common.stage(held.groupBy(F.col(f"{found}.id").alias("id")).agg(best), "sets")
    first_row = common.stage(smallest.select("id", F.col("best.row").alias("row")), "first-rows")
    roots = graph.components(links(held.select(F.col(row).alias("row"), f"{found}.*", F.col(text).alias("text")), first_row, words)).withColumnRenamed("node", "id")
    placed = smallest.select("id", "best").join(roots, "id", "left")
    first = placed.groupBy(F.coalesce("root", "id").alias("root")).agg(F.min("best").alias("best")).select(F.col("best.row").alias(row))
    kept = common.stage(first, "kept")
    common.discard(smallest, first_row)
    return held.drop(found).join(common.sized(kept), row, "left_semi").drop(row)
