"""Quality rules: a table of thresholds compiled into Spark expressions; no user functions.

``measures`` adds counts of words, symbols, lines and repeated five-word windows; ``RULES``
compares them, in integers, with per-cent limits. Everything is a projection: no shuffle, and a
row's cost is linear in its text but for one sort of its window hashes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facejobs.llm import common

WHITE = r"[\x20\x09-\x0D]+"
WHITE_CHARS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WINDOW = 5
#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in a is that it for on with as was by this are be from at or an not "
    "der die und das den von zu mit ist im nicht ein eine für auf des dem auch sich "
    "le la les et des du en un une que est pour dans qui sur au pas ce il "
    "el los de y por con para las del se no una su es lo como más"
).split()


@dataclass(frozen=True)
class Rule:
    """A row fails if ``100 * part`` lies outside ``low * whole`` to ``high * whole``.

    Both are names of counts; ``low`` and ``high`` are per cent (None: open). The rule holds from
    ``least`` words on; below, it passes.
    """

    name: str
    part: str
    whole: str
    low: int | None = None
    high: int | None = None
    least: int = 0


#: Contract of the base checks; a text that fails one is never kept.
BASE = (
    Rule("few_words", "n_words", "one", low=1000),
    Rule("repeated_words", "n_repeat_words", "n_words", high=20),
)
#: The method's own table.
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", low=200, high=1500),
    Rule("symbols_per_word", "n_symbols", "n_words", high=20),
    Rule("capitals", "n_upper", "n_letters", high=60),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", high=60),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", high=90, least=20),
    Rule("stop_words", "n_stop_words", "n_words", low=1, least=100),
)


def _fails(rule: Rule, count) -> Column:
    part, whole = F.lit(100) * count(rule.part), count(rule.whole)
    out = F.lit(False)
    if rule.low is not None:
        out = out | (part < F.lit(rule.low) * whole)
    if rule.high is not None:
        out = out | (part > F.lit(rule.high) * whole)
    return out & (count("n_words") >= rule.least) if rule.least else out


def _removed(text: Column, chars: str) -> Column:
    """How many characters of ``text`` are among ``chars``."""
    return (F.char_length(text) - F.char_length(F.translate(text, chars, ""))).cast("long")


def measures(docs: DataFrame, text: str = "text", out: str = common.RESULT) -> DataFrame:
    """Adds struct ``out`` of counts (all long): ``n_words``, ``word_chars``, ``n_symbols``,
    ``n_lines`` (lines with a word), ``n_dup_lines``, ``n_bullet_lines``, ``n_stop_words``,
    ``n_upper``, ``n_letters`` (A-Z, a-z), ``n_repeat_words`` (words in five-word windows that
    occur twice or more in the text).

    Null text counts as empty: all counts zero. Other columns pass unchanged.
    """
    names = {k: f"{out}_{k}" for k in ("t", "w", "l", "b", "h", "s", "d")}
    t, w, lines, bits, hashes, ranked, starts = (F.col(f"`{x}`") for x in names.values())

    at = lambda i, k: F.get(w, i + F.lit(k))
    window = lambda i: F.xxhash64(*(at(i, k) for k in range(WINDOW)))
    # each window as (hash, start) in one long: its high bits the hash, its low bits the start
    packed = F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.call_function("shiftleft", window(i), bits).bitwiseOR(i.cast("long")))
    start = lambda x: x.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1).cast("int")

    def same(x: Column, y: Column) -> Column:
        """Two neighbours in hash order are the same window; the words decide, not the hashes."""
        words = lambda z: F.slice(w, start(z) + 1, WINDOW)
        return F.coalesce((F.call_function("shiftright", x.bitwiseXOR(y), bits) == 0) & (words(x) == words(y)), F.lit(False))

    many = F.size(w) > WINDOW
    twice = F.filter(ranked, lambda x, k: same(x, F.get(ranked, k - 1)) | same(x, F.get(ranked, k + 1)))
    covered = F.aggregate(
        F.sort_array(starts), F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n")),
        lambda a: a["n"],
    )
    bare = lambda x: F.trim(F.translate(x, WHITE_CHARS, "      "))
    steps = (
        docs.withColumn(names["t"], F.coalesce(F.col(text), F.lit("")))
        .withColumn(names["w"], F.array_remove(F.split(t, WHITE), ""))
        .withColumn(names["l"], F.filter(F.split(t, "\n"), lambda x: bare(x) != ""))
        .withColumn(names["b"], F.ceil(F.log2(F.size(w) + F.lit(2))).cast("int"))
        .withColumn(names["h"], F.when(many, packed).otherwise(F.array().cast("array<bigint>")))
        .withColumn(names["s"], F.sort_array(hashes))
        .withColumn(names["d"], F.transform(twice, start))
    )
    n = lambda x: x.cast("long")
    upper, lower = _removed(t, UPPER), _removed(t, LOWER)
    return steps.withColumn(out, F.struct(
        n(F.size(w)).alias("n_words"),
        n(F.char_length(F.translate(t, WHITE_CHARS, ""))).alias("word_chars"),
        _removed(t, SYMBOLS).alias("n_symbols"),
        n(F.size(lines)).alias("n_lines"),
        n(F.size(lines) - F.size(F.array_distinct(lines))).alias("n_dup_lines"),
        n(F.size(F.filter(lines, lambda x: F.substring(bare(x), 1, 1).isin("-", "*", "•")))).alias("n_bullet_lines"),
        n(F.size(F.filter(w, lambda x: F.lower(x).isin(*STOP_WORDS)))).alias("n_stop_words"),
        upper.alias("n_upper"),
        (upper + lower).alias("n_letters"),
        covered.alias("n_repeat_words"),
    )).drop(*names.values())


def judge(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, out: str = common.RESULT) -> DataFrame:
    """Adds struct ``out``: the counts of :func:`measures`, ``base_failed`` and ``kept`` boolean,
    and ``failed``, the names of the rules that the text fails, in table order.

    Null and empty texts fail the base check. Repeated rows are judged alike; an empty table
    stays empty.
    """
    counts = f"{out}_counts"
    count = lambda k: F.lit(1).cast("long") if k == "one" else F.col(f"`{counts}`.{k}")
    any_of = lambda table: F.array_compact(F.array(*(F.when(_fails(r, count), F.lit(r.name)) for r in table)))
    return (
        measures(docs, text, counts)
        .withColumn(f"{out}_base", any_of(BASE))
        .withColumn(f"{out}_own", any_of(rules))
        .withColumn(out, F.struct(
            f"`{counts}`.*",
            (F.size(F.col(f"`{out}_base`")) > 0).alias("base_failed"),
            (F.size(F.col(f"`{out}_base`")) + F.size(F.col(f"`{out}_own`")) == 0).alias("kept"),
            F.concat(F.col(f"`{out}_base`"), F.col(f"`{out}_own`")).alias("failed"),
        ))
        .drop(counts, f"{out}_base", f"{out}_own")
    )


def keep(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows that pass every rule, with their columns as they were."""
    judged = judge(docs, text, rules)
    # through a generator no filter is pushed down, which would compute every count again in its own terms
    held = judged.select(*(f"`{c}`" for c in docs.columns), F.explode(F.array(f"{common.RESULT}.kept")).alias(common.RESULT))
    return held.where(F.col(common.RESULT)).drop(common.RESULT)


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def query(spark, sf_dir: str) -> DataFrame:
    """op1: the base counts and the verdict for every document."""
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    return judge(docs).select("doc_id", *(f"{common.RESULT}.{c}" for c in COLUMNS))


def _sql_rule(rule: Rule) -> str:
    whole = "1" if rule.whole == "one" else rule.whole
    tests = [f"100 * {rule.part} {sign} {limit} * {whole}" for sign, limit in (("<", rule.low), (">", rule.high)) if limit is not None]
    return f"(n_words >= {rule.least} AND ({' OR '.join(tests)}))"


_CLASS = r"[^\x20\x09-\x0D]"
SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '{_CLASS}+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_CLASS}')) AS l
  FROM documents
), u AS (
  SELECT rid, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d
), g AS (
  SELECT rid, i, {" || ' ' || ".join(["x", *(f"lead(x, {k}) OVER p" for k in range(1, WINDOW))])} AS g
  FROM u WINDOW p AS (PARTITION BY rid ORDER BY i)
), m AS (
  SELECT rid, i, g IS NOT NULL AND count(*) OVER (PARTITION BY rid, g) > 1 AS twice FROM g
), c AS (
  SELECT rid, count(*) FILTER (WHERE hit) AS n FROM (
    SELECT rid, bool_or(twice) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) AS hit FROM m
  ) GROUP BY rid
), f AS (
  SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
         len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines,
         len(list_filter(l, lambda x: regexp_matches(x, '^[\\x20\\x09-\\x0D]*[-*•]'))) AS n_bullet_lines,
         len(list_filter(w, lambda x: lower(x) IN ({", ".join(f"'{x}'" for x in STOP_WORDS)}))) AS n_stop_words,
         len(regexp_extract_all(t, '[A-Z]')) AS n_upper, len(regexp_extract_all(t, '[A-Za-z]')) AS n_letters,
         coalesce(c.n, 0) AS n_repeat_words
  FROM d LEFT JOIN c USING (rid)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       {" OR ".join(map(_sql_rule, BASE))} AS base_failed,
       NOT ({" OR ".join(map(_sql_rule, BASE + RULES))}) AS kept
FROM f
"""
