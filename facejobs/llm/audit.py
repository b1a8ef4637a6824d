"""Filter interaction audit: what each of several filters removes, alone and in every order.

Each document becomes the set of filters that it fails, a bit mask; only counts per part and mask
are kept. A part's counts define a removal game: a coalition of filters
is worth the documents that at least one of its members removes. The Hart-Mas-Colell potential of
the game, computed recursively over the coalitions, gives each filter's Shapley value as the
grand potential less the potential without that filter, and differences between coalitions give
the steps of every order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facejobs.llm import common

LETTERS = "ABCDE"
#: Limits of the filters.
MIN_WORDS, MIN_DISTINCT_PCT, MAX_UPPER_PCT = 100, 80, 10
UPPER, SYMBOLS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|"

_COUNTS = ("docs", "good", "toxic")
OUT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def failures(text: str) -> int:
    """Bits 0 to 3: the filters A to D that a text fails. An empty one fails A alone."""
    raw = text.encode()
    words = raw.split()  # at the six bytes of ASCII white space
    upper, symbols = (len(raw) - len(raw.translate(None, gone)) for gone in (UPPER, SYMBOLS))
    failed = (len(words) < MIN_WORDS, 100 * len(set(words)) < MIN_DISTINCT_PCT * len(words), 100 * upper > MAX_UPPER_PCT * len(text), symbols > 0)
    return sum(bad << k for k, bad in enumerate(failed))


def masks(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", part: str = "lang") -> DataFrame:
    """(doc_id, part, mask) of each row; bit 4 (E) is set if a row of a smaller id has the same text.

    Texts are compared by SHA-256; only digests, ids and masks are shuffled. The smallest id of
    each text is found by partial aggregation, then rows meet it under their own id, so a text
    that a third of all rows hold is no hot key. Null texts are empty; rows that repeat an id do
    not fail E for each other; a null id is neither smaller nor larger than any other.
    """

    @F.arrow_udf("mask int, digest binary")
    def read(column: pa.Array) -> pa.Array:
        found = common.texts(column)
        return common.struct(mask=pa.array(map(failures, found), pa.int32()), digest=pa.array((hashlib.sha256(x.encode()).digest() for x in found), pa.binary()))

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), read(F.col(text)).alias("read"))
    rows = common.stage(rows.select("doc_id", "part", "read.*"), "masks")
    first = rows.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    repeated = F.col("doc_id").isNotNull() & F.col("first").isNull()
    return rows.join(first, ["doc_id", "digest"], "left").select("doc_id", "part", (F.col("mask") + F.when(repeated, 16).otherwise(0)).alias("mask"))


def counts(marked: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(part, mask, docs, good, toxic): documents of each part and mask, and those labelled of
    quality 1 and toxic 1. Of several labels of an id, a 1 decides; ids without label count as
    neither."""
    if labels is None:
        marked = marked.withColumns({"q": F.lit(False), "t": F.lit(False)})
    else:
        one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
        known = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(one("quality").alias("q"), one("toxic").alias("t"))
        marked = marked.join(known, "doc_id", "left")
    return marked.groupBy("part", "mask").agg(F.count("*").alias("docs"), F.count_if("q").alias("good"), F.count_if("t").alias("toxic"))


def worth(per_mask: np.ndarray) -> np.ndarray:
    """Of each coalition (a bit mask of filters), the documents that fail one of them at least."""
    n = len(per_mask)
    within = per_mask.copy()  # documents whose failures lie within the coalition: subset sums
    for bit in (1 << k for k in range(n.bit_length() - 1)):
        within.reshape(-1, 2, bit)[:, 1] += within.reshape(-1, 2, bit)[:, 0]
    return per_mask.sum() - within[::-1]


def potentials(value: np.ndarray) -> list[int]:
    """Hart-Mas-Colell potential of each coalition, times n! for n players, as whole numbers:
    P(S) is v(S) plus the potentials of S without each one of its members, over the size of S."""
    players = len(value).bit_length() - 1
    scale, found = factorial(players), [0]
    for s in range(1, len(value)):
        without = (found[s ^ 1 << k] for k in range(players) if s >> k & 1)
        found.append((scale * int(value[s]) + sum(without)) // s.bit_count())
    return found


def steps(by_mask: dict[str, np.ndarray], letters: str = LETTERS) -> Iterator[tuple]:
    """(order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of
    every step of every order, from the counts per mask: arrays ``docs``, ``good``, ``toxic``."""
    v, good, toxic = (worth(by_mask[k]) for k in _COUNTS)
    total, everyone, potential = int(by_mask["docs"].sum()), len(v) - 1, potentials(v)
    bit = {x: 1 << k for k, x in enumerate(letters)}
    shapley = {x: potential[everyone] - potential[everyone ^ b] for x, b in bit.items()}
    for order in permutations(letters):
        before = 0
        for k, x in enumerate(order, 1):
            now = before | bit[x]
            removed = int(v[now] - v[before])
            yield (
                "".join(order), k, total - int(v[now]), removed, int(v[bit[x]]) - removed, int(v[everyone] - v[everyone ^ bit[x]]),
                int(good[now] - good[before]), int(toxic[now] - toxic[before]), shapley[x],
            )
            before = now


def audit(docs: DataFrame, labels: DataFrame | None = None, text: str = "text", doc_id: str = "doc_id", part: str = "lang") -> DataFrame:
    """One row per part, order of the five filters and step, as :data:`OUT` says; ``shapley`` is
    the filter's removals summed over all orders.

    Null parts count as the empty one. Rows that repeat count as often as they occur, other
    columns are left out whatever their names, and an empty table gives no rows. A part takes 32
    rows of counts to its task, whatever its size.
    """

    def play(key: tuple, table: pa.Table) -> pa.Table:
        by_mask = {k: np.zeros(1 << len(LETTERS), np.int64) for k in _COUNTS}
        for k in _COUNTS:
            by_mask[k][table["mask"].to_numpy()] = table[k].to_numpy()
        columns = list(zip(*steps(by_mask)))
        names = [c.split()[0] for c in OUT.split(", ")]
        kinds = [pa.string(), pa.int32(), *[pa.int64()] * 7]
        arrays = [pa.array([key[0].as_py()] * len(columns[0]), pa.string()), *(pa.array(c, t) for c, t in zip(columns, kinds))]
        return pa.Table.from_arrays(arrays, names=names)

    return counts(masks(docs, text, doc_id, part), labels).groupBy("part").applyInArrow(play, OUT)


def query(spark, sf_dir: str) -> DataFrame:
    """op12: the audit of all documents by language, with their labels."""
    common.small_batches(spark)
    return audit(common.documents(spark, sf_dir), common.labels(spark, sf_dir))


def _sql(letters: Iterable[str] = LETTERS) -> str:
    """Every document is walked through every order; nothing is derived from coalitions."""
    orders = ", ".join(f"('{''.join(o)}')" for o in permutations(letters))
    fails = {"A": "len(w) < 100", "B": "100 * len(list_distinct(w)) < 80 * len(w)", "C": "100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * len(t)", "D": "regexp_matches(t, '[#$%&*|]')", "E": "coalesce(doc_id > first, false)"}
    failed = reduce(lambda s, x: f"{s} || CASE WHEN {fails[x]} THEN '{x}' ELSE '' END", letters, "''")
    return f"""
WITH lab AS (SELECT doc_id, coalesce(max((quality = 1)::INT), 0) AS q, coalesce(max((toxic = 1)::INT), 0) AS t1 FROM labels GROUP BY 1),
d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first FROM documents),
m AS (SELECT part, {failed} AS failed, coalesce(q, 0) AS q, coalesce(t1, 0) AS t1 FROM d LEFT JOIN lab USING (doc_id)),
g AS (SELECT part, failed, count(*) AS n, sum(q) AS q, sum(t1) AS t1 FROM m GROUP BY ALL),
o AS (SELECT col0 AS filter_order, unnest(range(1, {len(LETTERS) + 1}))::INT AS step FROM (VALUES {orders})),
s AS (SELECT filter_order, step, filter_order[step] AS x, filter_order[:step - 1] AS earlier FROM o),
r AS (SELECT part, filter_order, step, x, n, q, t1, length(failed) AS n_failed, contains(failed, x) AS fails, earlier <> '' AND failed <> '' AND regexp_matches(failed, '[' || CASE WHEN earlier = '' THEN '0' ELSE earlier END || ']') AS gone FROM g, s),
u AS (SELECT part, filter_order, step, x, coalesce(sum(n) FILTER (NOT gone AND NOT fails), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (fails AND NOT gone), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (fails AND gone), 0)::BIGINT AS redundant,
  coalesce(sum(n) FILTER (fails AND n_failed = 1), 0)::BIGINT AS unique_fails, coalesce(sum(q) FILTER (fails AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(t1) FILTER (fails AND NOT gone), 0)::BIGINT AS toxic_lost FROM r GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley FROM u"""


SQL = _sql()
