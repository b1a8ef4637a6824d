"""Licence scans by a positional index of rare tokens, in DataFrame functions only.

Templates are short licence notices with mandatory key phrases. Each template is indexed by the
two words of its key phrase with the highest inverse document frequency. The postings of the
rarest meet the files that have it; a posting and the word's place give an alignment of the
template, which the second word must confirm at its relative position. So every place where a
key phrase stands is looked at, and no stop word is looked up but where a key phrase has nothing
else. An alignment counts if the key phrase stands whole at its place. Base phrases are found in
the same pass over the words.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from facejobs.llm import common
from facejobs.llm.quality_rules import LOWER, UPPER

SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A notice of this many words in place, or more, can score 1.
FULL = 8

#: Phrases whose places are counted, and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


@dataclass(frozen=True)
class Template:
    label: str
    notice: str
    #: Must stand word for word in the notice, and in the file at the same place.
    key: str


#: Usual notices of public licences, lower case, punctuation left out.
TEMPLATES = (
    Template("gpl", "this work is licensed under the gnu general public license", "gnu general public license"),
    Template("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gnu general public license"),
    Template("gpl-3", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    Template("gpl-2", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    Template("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", "gnu lesser general public license"),
    Template("agpl", "under the terms of the gnu affero general public license as published by the free software foundation", "gnu affero general public license"),
    Template("apache", "licensed under the apache license", "apache license"),
    Template("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    Template("mit", "released under the mit license", "mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "with or without fee is hereby granted"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license v 2 0"),
    Template("cc-by", "this work is licensed under cc by", "cc by"),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    Template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    Template("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution"),
    Template("cc0", "this work is dedicated to the public domain under cc0 1 0 universal", "cc0 1 0"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
)


class Index:
    """Postings of the templates: a word's number, and each template as packed (place, word)."""

    def __init__(self, templates: tuple[Template, ...] = TEMPLATES) -> None:
        self.templates = templates
        self.words = sorted({w for t in templates for w in t.notice.split()} | {w for p in BASE for w in p.split()})
        self.number = {w: k for k, w in enumerate(self.words)}
        if len(self.words) > 1 << 10:
            raise ValueError("a word's number must fit 10 bits")
        self.rows = []
        for n, t in enumerate(templates):
            words, key = t.notice.split(), t.key.split()
            at = next(i for i in range(len(words)) if words[i : i + len(key)] == key)
            self.rows += [(n, q, w, at <= q < at + len(key)) for q, w in enumerate(words)]
        #: A file without any of these has no key phrase and no base phrase.
        self.keys = sorted({max(t.key.split(), key=len) for t in templates} | {p.split()[0] for p in BASE})

    def packed(self, number: int, only_key: bool = False) -> list[int]:
        return [q << 10 | self.number[w] for n, q, w, key in self.rows if n == number and (key or not only_key)]


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATOR), "")


def hits(docs: DataFrame, index: Index, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """A row per row of ``docs``: doc_id, n_words, the licence words it has, and, where it has a
    key word, their places (place << 10 | word number) and the places of base phrases."""
    vocabulary, w, at = F.array(*map(F.lit, index.words)), F.col("w"), F.col("at")
    word = lambda i, k=0: F.get(w, i + F.lit(k))
    is_phrase = lambda i, p: _all([word(i, k) == x for k, x in enumerate(p.split())])
    places = F.when(F.arrays_overlap("present", F.array(*map(F.lit, index.keys))), F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: word(i).isin(*index.words)))
    return (
        docs.select(F.col(doc_id).alias("doc_id"), _words(F.col(text)).alias("w"))
        .withColumn("present", F.array_intersect(w, vocabulary))
        .withColumn("at", F.when(F.size("present") > 0, places))
        .select(
            "doc_id", F.size(w).cast("long").alias("n_words"), "present",
            F.coalesce(F.transform(at, lambda i: F.shiftleft(i.cast("long"), 10) + F.array_position(vocabulary, word(i)) - 1), F.array().cast("array<bigint>")).alias("hits"),
            *(F.coalesce(F.filter(at, _phrase(is_phrase, p)), F.array().cast("array<int>")).alias(f"base{k}") for k, p in enumerate(BASE)),
        )
    )


def _phrase(test, phrase: str):
    return lambda i: test(i, phrase)


def _all(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return F.coalesce(out, F.lit(False))


def scan(docs: DataFrame, index: Index | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """A row per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels,
    labels, score.

    score is the best share of a notice's words in place where its key phrase stands, scaled by
    how many they are (:data:`FULL`); 0 without one. Null and empty texts have no words: counts
    0, places null, labels empty. Repeated rows stay; an empty table gives no rows; columns of any
    names beside the two are left out. A long text is one row, its licence words an array; the
    work is linear in them. Labels of equal notices come once, and of equal scores the value is the same.
    """
    index = index or Index()
    spark = docs.sparkSession
    found = common.stage(hits(docs, index, text, doc_id).withColumn("row", F.monotonically_increasing_id()), "licence-words")

    frequency = found.select(F.explode("present").alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    # one row for each word of the templates at most: a fixed bound for these broadcasts
    numbered = spark.createDataFrame([(k, w) for w, k in index.number.items()], "number int, word string")
    ranks = numbered.join(F.broadcast(frequency), "word", "left").orderBy("df", "word").select("number").collect()
    rank = {r["number"]: k for k, r in enumerate(ranks)}

    number = lambda h: h.bitwiseAND(1023).cast("int")
    postings = []
    for n in range(len(index.templates)):
        (_, word, q), *more = sorted((rank[index.number[w]], index.number[w], q) for m, q, w, key in index.rows if m == n and key)
        _, second, at = more[0] if more else (0, word, q)
        postings.append((word, n, q, ((at - q) << 10) + second))
    anchors = {p[0] for p in postings}
    postings = F.broadcast(spark.createDataFrame(postings, "number int, template int, q int, confirms long"))
    # hits are in order of place, so as many as the longest notice has words, either way, hold all of it
    reach = max(len(t.notice.split()) for t in index.templates)
    near = F.slice("hits", F.greatest(F.col("i") + 1 - reach, F.lit(1)), F.lit(2 * reach + 1))
    aligned = (
        found.select("row", "hits", F.posexplode("hits").alias("i", "hit"))
        .where(number(F.col("hit")).isin(*anchors))
        .select("row", near.alias("near"), number(F.col("hit")).alias("number"), F.shiftright("hit", 10).alias("place"))
        .join(postings, "number")
        .where(F.array_contains("near", F.shiftleft("place", 10) + F.col("confirms")))
        .select("row", "near", "template", (F.col("place") - F.col("q")).alias("d"))
    )
    notices = F.broadcast(spark.createDataFrame([(n, t.label, index.packed(n), index.packed(n, True)) for n, t in enumerate(index.templates)], "template int, label string, notice array<bigint>, key array<bigint>"))
    moved = lambda x: F.transform(x, lambda p: p + F.shiftleft(F.col("d"), 10))
    around = F.filter("near", lambda h: F.shiftright(h, 10).between(F.col("d"), F.col("d") + F.size("notice")))
    verified = (
        aligned.join(notices, "template")
        .withColumn("around", around)
        .where(F.size(F.array_except(moved("key"), "around")) == 0)
        .withColumn("n", F.size(F.array_intersect(moved("notice"), "around")))
        .groupBy("row").agg(
            F.collect_set("label").alias("more"),
            F.max(F.col("n") / F.size("notice") * F.least(F.lit(1.0), F.col("n") / F.lit(FULL))).alias("score"),
        )
    )
    bases = [F.col(f"base{k}") for k in range(len(BASE))]
    places, labels = F.flatten(F.array(*bases)), F.array_compact(F.array(*(F.when(F.size(b) > 0, F.lit(x)) for b, x in zip(bases, BASE.values()))))
    joined = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    return (
        found.join(verified, "row", "left")
        .select(
            "doc_id", "n_words", F.size(places).cast("long").alias("n_base"), F.array_min(places).cast("long").alias("first_word"), F.array_max(places).cast("long").alias("last_word"),
            joined(labels).alias("base_labels"), joined(F.concat(labels, F.coalesce("more", F.array().cast("array<string>")))).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
        )
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: licence phrases and labels of every document."""
    return scan(common.documents(spark, sf_dir).select("doc_id", "text"))


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x).lower() for x in r) + ")" for r in rows)


def _sql() -> str:
    index = Index()
    phrases = [(k, p, x) for k, (p, x) in enumerate(BASE.items())]
    starts = " UNION ALL ".join(
        f"SELECT rid, i, '{label}' AS label FROM n WHERE " + " AND ".join(f"{'w' if k == 0 else f'w{k}'} = '{x}'" for k, x in enumerate(p.split())) for _, p, label in phrases
    )
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents
), t(template, q, w, is_key) AS (VALUES {_values(index.rows)}),
l(template, label) AS (VALUES {_values([(n, t.label) for n, t in enumerate(index.templates)])}),
u AS (SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS i FROM d),
n AS (SELECT rid, i, w, lead(w, 1) OVER p AS w1, lead(w, 2) OVER p AS w2, lead(w, 3) OVER p AS w3 FROM u WINDOW p AS (PARTITION BY rid ORDER BY i)),
b AS ({starts}),
bs AS (SELECT rid, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word FROM b GROUP BY rid),
h AS (SELECT rid, w, i FROM u WHERE w IN ({", ".join(f"'{w}'" for w in index.words)})),
a AS (SELECT DISTINCT rid, template, i - q AS d FROM h JOIN t USING (w) WHERE is_key),
m AS (
  SELECT a.rid, a.template, a.d, count(h.i) AS hit, count(*) AS size, count(*) FILTER (WHERE is_key AND h.i IS NULL) AS lacking
  FROM a JOIN t USING (template) LEFT JOIN h ON h.rid = a.rid AND h.i = a.d + t.q AND h.w = t.w GROUP BY ALL
),
v AS (SELECT rid, label, hit / size * least(1.0, hit / {FULL}.0::DOUBLE) AS score FROM m JOIN l USING (template) WHERE lacking = 0),
s AS (SELECT rid, max(score) AS score FROM v GROUP BY rid),
bl AS (SELECT rid, string_agg(label, ',' ORDER BY label) AS x FROM (SELECT DISTINCT rid, label FROM b) GROUP BY rid),
al AS (SELECT rid, string_agg(label, ',' ORDER BY label) AS x FROM (SELECT rid, label FROM b UNION SELECT rid, label FROM v) GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(bl.x, '') AS base_labels, coalesce(al.x, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN bs USING (rid) LEFT JOIN s USING (rid) LEFT JOIN bl USING (rid) LEFT JOIN al USING (rid)
"""


SQL = _sql()
