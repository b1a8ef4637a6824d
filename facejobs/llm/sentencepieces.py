"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies with byte fallback.

A segment's symbols are merged from an agenda of adjacent pairs, best score first, leftmost
first among equals. Texts are cut where no piece of the vocabulary can cross: before a run of
spaces, around newlines, and between a letter and a mark that follows letters in no piece. Each worker keeps the ids of segments it has
met; in each Arrow batch, the new ones, one whole text, and every decoded text are checked
against the sentencepiece library.
"""

from __future__ import annotations

import heapq
import re
import string
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facejobs.llm import common

SPACE = "▁"
FILE = "piece_bpe_32k.model"
CACHE = 1_200_000
LETTER = "[A-Za-zÀ-ÖØ-öø-ÿ]"
#: Longest text, in characters, that is encoded whole as a check.
CHECKED = 20_000
#: Symbols up to which the agenda is a plain list.
SHORT = 48


class MismatchError(RuntimeError):
    """Ids differ from the library's."""


class Vocabulary:
    """Pieces and scores of a model file, and the ids and bytes made with them."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        special = [sp.is_control(k) or sp.is_unknown(k) or sp.is_byte(k) or sp.is_unused(k) for k in range(size)]
        pieces = [sp.id_to_piece(k) for k in range(size)]
        if any(sp.is_unused(k) for k in range(size)):
            raise ValueError("vocabularies with unused pieces are not supported")
        self.rank = {p: (-sp.get_score(k), k) for k, p in enumerate(pieces) if not special[k]}
        # places in the order of falling scores; equal scores share one, and the leftmost pair wins
        place = {x: k for k, x in enumerate(sorted({x for x, _ in self.rank.values()}))}
        self.order, self.none = {p: place[x] for p, (x, _) in self.rank.items()}, len(place)
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.rank):
            raise ValueError("a piece goes on after a word's end")
        if any("\n" in p for p in self.rank):
            raise ValueError("a piece holds a newline")
        # marks that follow no letter in any piece: texts can be cut between a letter and them
        joined = {p[i : i + 2] for p in self.rank for i in range(len(p) - 1)}
        marks = "".join(re.escape(c) for c in string.punctuation if not any(re.match(LETTER, x) and x[1] == c for x in joined))
        self.segment = re.compile(rf" *(?:[^ \n{marks}]+|(?<!{LETTER})[{marks}])+|[{marks}](?:[^ \n{marks}]+|(?<!{LETTER})[{marks}])*|\n| +")
        self.bytes_id = {int(pieces[k][3:5], 16): k for k in range(size) if sp.is_byte(k)}
        self.unknown = sp.unk_id()
        self.table = [b"" if sp.is_control(k) else " ⁇ ".encode() if sp.is_unknown(k) else bytes([int(p[3:5], 16)]) if sp.is_byte(k) else p.replace(SPACE, " ").encode() for k, p in enumerate(pieces)]
        self.known: dict[str, bytes] = {}

    def merge(self, segment: str) -> list[int]:
        """Ids of one segment (spaces as U+2581), by the agenda of adjacent pairs."""
        ids: list[int] = []
        for s in self._short(list(segment)) if len(segment) <= SHORT else self._long(list(segment)):
            if found := self.rank.get(s):
                ids.append(found[1])
            else:
                ids += [self.bytes_id[x] for x in s.encode()] if self.bytes_id else [self.unknown]
        return ids

    def _short(self, symbols: list[str]) -> list[str]:
        """The agenda as a list in text order, which for few symbols beats a heap."""
        get, none = self.order.get, self.none
        agenda = [get(a + b, none) for a, b in zip(symbols, symbols[1:])]
        while agenda and (best := min(agenda)) != none:
            k = agenda.index(best)
            pair = symbols[k] + symbols.pop(k + 1)
            symbols[k] = pair
            del agenda[k]
            if k:
                agenda[k - 1] = get(symbols[k - 1] + pair, none)
            if k < len(agenda):
                agenda[k] = get(pair + symbols[k + 1], none)
        return symbols

    def _long(self, symbols: list) -> list[str]:
        """The agenda as a heap; entries whose symbols have changed since are passed over."""
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda: list[tuple[float, int, int, str]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b < n and (order := self.order.get(pair := symbols[a] + symbols[b])) is not None:
                heapq.heappush(agenda, (order, a, b, pair))

        for a in range(n - 1):
            offer(a, a + 1)
        while agenda:
            _, a, b, pair = heapq.heappop(agenda)
            if symbols[a] is None or symbols[b] is None or after[a] != b or symbols[a] + symbols[b] != pair:
                continue
            symbols[a], symbols[b] = pair, None
            after[a] = after[b]
            if after[b] < n:
                before[after[b]] = a
            offer(before[a], a)
            offer(a, after[a])
        return [s for s in symbols if s is not None]

    def segments(self, text: str) -> list[str]:
        """The text with its leading space, cut where pieces cannot cross; none of an empty text."""
        return self.segment.findall(" " + text.replace(SPACE, " ")) if text else []

    def learn(self, segments: set[str]) -> None:
        """Encode segments not met before, and check them against the library."""
        new = list(segments.difference(self.known))
        ids = [self.merge(s.replace(" ", SPACE)) for s in new]
        # the library puts a space before what it is given; a segment without one, and spaces alone, go after a newline
        spaced = [s.startswith(" ") and bool(s.strip(" ")) for s in new]
        theirs = self.library.encode([s[1:] if f else "\n" + s for s, f in zip(new, spaced)], num_threads=1)
        skip = len(self.library.encode("\n")) if not all(spaced) else 0
        for s, mine, other, f in zip(new, ids, theirs, spaced):
            if mine != (other if f else other[skip:]):
                raise MismatchError(f"segment {s!r}: {mine}, library {other}")
            self.known[s] = np.array(mine, np.int32).tobytes()

    def encode(self, texts: list[str]) -> pa.ListArray:
        """Ids of each text."""
        cut = [self.segments(t) for t in texts]
        common.trim(self.known, CACHE)
        self.learn({s for c in cut for s in c})
        rows = [b"".join(map(self.known.__getitem__, c)) for c in cut]
        ends = np.concatenate([[0], np.cumsum([len(r) // 4 for r in rows])]).astype(np.int32)
        # the longest text of moderate length, so that the cuts are checked as well
        k = max((k for k, t in enumerate(texts) if len(t) <= CHECKED), key=lambda k: len(texts[k]), default=None)
        if k is not None and np.frombuffer(rows[k], np.int32).tolist() != self.library.encode(texts[k]):
            raise MismatchError(f"text {texts[k]!r}")
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(rows), np.int32)))

    def decode(self, ids: list[int]) -> str:
        """Text of ids: the pieces' bytes in order, less the leading space; bytes that are not
        UTF-8 become U+FFFD one by one."""
        raw = b"".join(map(self.table.__getitem__, ids))
        if next((k for k in ids if self.table[k]), None) != self.unknown:
            raw = raw.removeprefix(b" ")
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return re.sub("[\udc80-\udcff]", "�", raw.decode(errors="surrogateescape"))

    def decode_all(self, column: pa.ListArray) -> list[str]:
        """Texts of a column of ids, each as the library's decode gives it."""
        if column.null_count:
            rows = [x or [] for x in column.to_pylist()]
        else:
            flat, ends = column.values.to_numpy(zero_copy_only=False).tolist(), column.offsets.to_pylist()
            rows = [flat[a:b] for a, b in zip(ends, ends[1:])]
        found = [self.decode(x) for x in rows]
        for mine, theirs, x in zip(found, self.library.decode(rows, num_threads=1) if rows else [], rows):
            if mine != theirs:
                raise MismatchError(f"ids {x}")
        return found


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode(docs: DataFrame, path: str, text: str = "text", out: str = common.RESULT) -> DataFrame:
    """Adds array<int> ``out``: the ids of each whole text. Null and empty texts have none.

    Repeated rows stay, an empty table stays empty, a text of any length is encoded whole, and
    of equal scores the leftmost pair merges first. Other columns pass, unless one is called ``out``.
    """

    @F.arrow_udf("array<int>")
    def ids(column: pa.Array) -> pa.Array:
        return vocabulary(path).encode(common.texts(column))

    return docs.withColumn(out, ids(F.col(text)))


def decode(rows: DataFrame, path: str, ids: str, out: str) -> DataFrame:
    """Adds string ``out``: the text of each row's ids; null ids count as none. Repeated rows stay,
    an empty table stays empty, and other columns pass, unless one is called ``out``."""

    @F.arrow_udf("string")
    def text(column: pa.Array) -> pa.Array:
        return pa.array(vocabulary(path).decode_all(column), pa.string())

    return rows.withColumn(out, text(F.col(ids)))


def query(spark, sf_dir: str) -> DataFrame:
    """op6: ids of every document, decoded again."""
    common.small_batches(spark)
    path = common.tokenizer_file(FILE)
    ids, back = f"{common.RESULT}_ids", f"{common.RESULT}_text"
    rows = decode(encode(common.documents(spark, sf_dir).select("doc_id", "text"), path, out=ids), path, ids, back)
    return rows.select(
        "doc_id", F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col(ids).cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col(back).cast("binary"), 256).alias("decoded_sha256"),
    )
