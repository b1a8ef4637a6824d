"""Bounded samples of labelled rows, and held-out marks by crc32 of the id's text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facejobs.llm import common


#: Longest text, in characters, that a sample takes: with the number of rows, a bound of what reaches the driver.
LONGEST = 1 << 16


@dataclass(frozen=True)
class Sample:
    texts: list[str]
    y: list[int]
    #: How many labelled rows one row of the sample of this label stands for.
    weight: dict[int, float]
    #: The further columns asked for, a tuple for each row.
    more: list[tuple]


def remainder(doc_id: str, modulus: int):
    """crc32 of the id as decimal text, modulo ``modulus``; a null id gives -1, so it is not held out."""
    return F.coalesce(common.crc_mod(doc_id, modulus), F.lit(-1)).cast("int")


def sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, per_class: dict[int, int], more: tuple[str, ...] = (), text: str = "text", doc_id: str = "doc_id") -> Sample:
    """At most ``per_class`` rows of each label, never of the held-out remainder, in the order of
    a hash of their id. Only ids and labels are sorted; the texts of the chosen few are joined,
    but for those longer than :data:`LONGEST`. ``labels`` has columns doc_id and ``label``.

    An id with several labels counts as 1 if any of them is 1, and of rows that repeat an id the
    smallest counts; null ids or labels are left out, and null texts are empty ones.
    """
    marked = labels.select(F.col("doc_id"), F.col(label).alias("y")).where("doc_id IS NOT NULL AND y IS NOT NULL").groupBy("doc_id").agg(F.max("y").alias("y"))
    usable = marked.where(remainder("doc_id", modulus) != held_out)
    total = {r["y"]: r["n"] for r in usable.groupBy("y").agg(F.count("*").alias("n")).collect()}
    chosen = [usable.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for y, n in per_class.items()]
    picked = chosen[0]
    for more_ids in chosen[1:]:
        picked = picked.unionAll(more_ids)
    # at most sum(per_class) ids: a proven bound for the broadcast
    held = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"), *more).where(F.char_length("text") <= LONGEST)
    rows = held.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "y").agg(F.min(F.struct("text", *more)).alias("row")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    have = {y: sum(r["y"] == y for r in rows) for y in per_class}
    return Sample([r["row"]["text"] for r in rows], [r["y"] for r in rows], {y: total.get(y, 0) / n for y, n in have.items() if n}, [tuple(r["row"][c] for c in more) for r in rows])
