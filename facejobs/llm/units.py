"""Texts cut into units that a tokenizer of the tokenizers library never merges across.

A unit is finer than a text and at least a pre-token: a word with the space before it, its
punctuation, or a run of white space, as the tokenizer's own rules cut there first. Ids of a
text are then the ids of its units in order, each encoded by the library once per worker. Of
each call one whole text is encoded by the library too, and a difference stops the job.

Columns of text for a byte-level vocabulary are cut by their bytes, all texts of a batch at once,
and finer: where a letter, a digit and a punctuation character of ASCII meet as well.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from facejobs.llm import common

#: The White_Space characters of Unicode, as the library's patterns understand \s.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Units of byte-level vocabularies keep white space; those of word vocabularies drop it.
BYTE_LEVEL = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
WORD_LEVEL = re.compile(f"[^{WHITE}]+")
#: Fixed value: the pattern that byte-level vocabularies cut by; a unit holds whole matches of it.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Kinds of bytes. WIDE are those of white space beyond ASCII; those of other longer characters,
#: and control characters, may be letters, digits or marks.
SPACE, BREAK, LETTER, DIGIT, MARK, QUOTE, ANY, WIDE = range(8)


def _kinds() -> np.ndarray:
    kinds = np.full(256, ANY, np.uint8)
    kinds[33:127] = MARK
    for some, kind in ((b"\t\n\x0b\x0c\r", BREAK), (b" ", SPACE), (b"'", QUOTE), (b"0123456789", DIGIT)):
        kinds[list(some)] = kind
    kinds[[b for b in range(128) if chr(b).isalpha()]] = LETTER
    return kinds


def _cuts() -> np.ndarray:
    """Whether a pre-token ends between bytes of two kinds (the first times 8, plus the second): 1
    if so, 2 if it does where no white space follows, 0 if not or if more than the two decide."""
    cuts = np.zeros(64, np.uint8)
    white, solid = (SPACE, BREAK, WIDE), (LETTER, DIGIT, MARK, QUOTE, ANY)
    for a in range(8):
        for b in range(8):
            if b in white:
                # in a run, WIDE stays with what follows, so that no character is cut
                cuts[8 * a + b] = 1 if a in solid else 0 if b == WIDE else 2
            elif a == BREAK:
                cuts[8 * a + b] = 1
            elif a in solid and ANY not in (a, b) and a != b and {a, b} != {MARK, QUOTE} and (a, b) != (QUOTE, LETTER):
                cuts[8 * a + b] = 1
    return cuts


KINDS, CUTS = _kinds(), _cuts()
#: White space beyond ASCII as three bytes in one number (of shorter characters two), and its first bytes.
LONG = np.array(sorted(int.from_bytes(c.encode(), "big") for c in map(chr, range(128, 0x3001)) if re.match(f"[{WHITE}]", c)))
LEADS = np.isin(np.arange(256), [0xC2, 0xE1, 0xE2, 0xE3])
#: How units start that do not run on from white space before them.
WORD = re.compile(r" ?\S").match
#: Units whose ids a worker keeps, at about 250 bytes each.
CACHE = 1_000_000
#: Stands between units that are encoded together: of word vocabularies, and of byte-level ones.
SPLIT, LINE = "\x00", "\n"
#: Units that one call encodes together: few enough for the library's own cache to stay near.
JOINED = 32
#: Longest text, in characters, that is encoded whole as a check.
CHECKED = 20_000


class MismatchError(RuntimeError):
    """Ids differ from the library's."""


class Units:
    """One tokenizer file: how it cuts texts, and the ids of units."""

    def __init__(self, path: str) -> None:
        import json

        from tokenizers import Tokenizer, normalizers

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        kind = rules["pre_tokenizer"]["type"]
        if kind == "ByteLevel" and rules["normalizer"] is None and rules["pre_tokenizer"]["use_regex"] and not rules["pre_tokenizer"]["add_prefix_space"]:
            self.pattern = BYTE_LEVEL
        elif kind == "Sequence" and rules["pre_tokenizer"]["pretokenizers"][0]["behavior"] == "Removed":
            self.pattern = WORD_LEVEL
        else:
            raise ValueError(f"no units known for {path}")
        special = [t["content"] for t in rules["added_tokens"]]
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.marks = special
        self.size = self.library.get_vocab_size()
        self.known: dict[str, bytes] = {}
        #: Encodes joined units: of word vocabularies without the normalizer, for what Python has lowered; see :meth:`_lowered`.
        self.plain, self.split = self.library, LINE
        if self.pattern is WORD_LEVEL:
            self.plain, self.split = Tokenizer.from_file(path), f" {SPLIT} "
            self.plain.normalizer = normalizers.Sequence([])
        self.split_id = self.plain.encode(self.split, add_special_tokens=False).ids

    def cut(self, text: str) -> list[str]:
        """Units of a text; strings of added tokens are units of their own."""
        if self.special and any(m in text for m in self.marks):
            return [u for k, part in enumerate(self.special.split(text)) for u in ([part] if k % 2 else self.pattern.findall(part))]
        return self.pattern.findall(text)

    def pre_tokens(self, unit: str) -> list[str]:
        """The unit cut as the tokenizer does before it merges; a word vocabulary's unit stays whole."""
        return [unit] if self.pattern is WORD_LEVEL or unit in self.marks else PATTERN.findall(unit)

    def encode_units(self, units: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(units, add_special_tokens=False)]

    def _lowered(self, text: str) -> str:
        """The text in lower case where that is all the normalizer of a word vocabulary does: up to
        U+00FF no characters compose, and each has one lower-case form. Other texts stay."""
        if self.pattern is BYTE_LEVEL:
            return text
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text
        low = text.lower()
        return text if any(m in low for m in self.marks) else low

    def _joins(self, unit: str) -> bool:
        """Whether units of this kind can be encoded in one text: of byte-level vocabularies no
        run of white space, of word vocabularies lowered, and no added token's string."""
        if self.pattern is BYTE_LEVEL:
            return not unit.isspace() and unit not in self.marks
        try:
            unit.encode("latin-1")
        except UnicodeEncodeError:
            return False
        return unit == unit.lower() and SPLIT not in unit and not any(m in unit for m in self.marks)

    def _learn(self, new: list[str]) -> None:
        """Ids of units not met before. Most go to the library joined by a text that is a
        pre-token and an id of its own."""
        simple, rest = [], []
        for u in new:
            (simple if self._joins(u) else rest).append(u)
        self._learn_joined(simple, rest)

    def _learn_joined(self, simple: list[str], rest: list[str]) -> None:
        """Ids of units that can be encoded in one text, and of the rest, each by itself."""
        if len(self.split_id) != 1:
            simple, rest = [], simple + rest
        fast = self.plain.encode_batch_fast
        for at in range(0, len(simple), 5_000):
            part, ids = simple[at : at + 5_000], []
            for k in range(0, len(part), JOINED):
                ids += fast([self.split.join(part[k : k + JOINED])], add_special_tokens=False)[0].ids
                ids += self.split_id
            found = np.array(ids, np.int32)
            ends = np.flatnonzero(found == self.split_id[0])
            if len(ends) != len(part):
                rest += part
                continue
            raw, ends = found.tobytes(), (4 * ends).tolist()
            self.known.update(zip(part, (raw[a:b] for a, b in zip([0, *(x + 4 for x in ends)], ends))))
        for u, ids in zip(rest, self.encode_units(rest)):
            self.known[u] = np.array(ids, np.int32).tobytes()

    def count(self, units: list[str]) -> list[int]:
        """How many ids each of these distinct units has; they are not kept."""
        held, self.known = self.known, {}
        self._learn(units)
        found, self.known = self.known, held
        return [len(found[x]) // 4 for x in units]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, as the library's encode with add_special_tokens=False gives them."""
        cut = [self.cut(self._lowered(t)) for t in texts]
        common.trim(self.known, CACHE)
        self._learn(list(set().union(*cut).difference(self.known)))
        get = self.known.__getitem__
        out = [np.frombuffer(b"".join(map(get, c)), np.int32) for c in cut]
        self._check(texts, out)
        return out

    def _check(self, texts: list[str], out: list[np.ndarray]) -> None:
        # the longest of moderate length, so that a check costs little in a batch of many texts
        k = max((k for k, t in enumerate(texts) if len(t) <= CHECKED), key=lambda k: len(texts[k]), default=None)
        if k is not None and out[k].tolist() != self.encode_units([texts[k]])[0]:
            raise MismatchError(f"ids of {texts[k]!r}")

    def cut_bytes(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Where units start in the bytes of texts that start at ``starts`` (those of empty texts
        included): at each text, and where a pre-token of a byte-level vocabulary surely ends."""
        if not len(data):
            return np.zeros(0, np.int64)
        kinds = KINDS[data]
        at = np.flatnonzero(LEADS[data])
        if len(at):
            two = data[at] == 0xC2
            last = len(data) - 1
            number = data[at].astype(np.int64) << 8 | data[np.minimum(at + 1, last)]
            number = np.where(two, number, number << 8 | data[np.minimum(at + 2, last)])
            wide = np.isin(number, LONG)
            at, two = at[wide], two[wide]
            for k in (at, at + 1, at[~two] + 2):
                kinds[k] = WIDE
        first = np.zeros(len(data) + 1, bool)
        first[starts] = True
        first[-1] = True
        cuts = np.zeros(len(data), np.uint8)
        cuts[1:] = CUTS[kinds[:-1] << 3 | kinds[1:]]
        # of a run of white space the last character stands alone if a word follows in the text
        runs = np.flatnonzero(cuts == 2)
        after = kinds[np.minimum(runs + 1, len(data) - 1)]
        cuts[runs] = (after > BREAK) & (after != WIDE) & ~first[runs + 1]
        cuts[first[:-1]] = 1
        return np.flatnonzero(cuts)

    def encode_column(self, column: pa.Array) -> list[np.ndarray]:
        """Ids of each text of a column of strings, as :meth:`encode` gives them; null is the empty text."""
        texts = pc.fill_null(column.cast(pa.large_string()), "")
        if self.pattern is WORD_LEVEL:
            return self.encode(texts.to_pylist())
        odd = pa.array(np.zeros(len(texts), bool))
        for mark in self.marks:
            odd = pc.or_(odd, pc.match_substring(texts, mark))
        other = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        if len(other):
            rest, texts = texts.filter(odd).to_pylist(), pc.if_else(odd, "", texts)
        places = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        places, low = places - places[0], int(places[0])
        data = np.frombuffer(texts.buffers()[2], np.uint8)[low : low + int(places[-1])] if places[-1] else np.zeros(0, np.uint8)
        starts = self.cut_bytes(data, places[:-1])
        units = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(data))), pa.py_buffer(data)).dictionary_encode()
        words = units.dictionary.to_numpy(zero_copy_only=False).tolist()
        common.trim(self.known, CACHE)
        known = list(map(self.known.get, words))
        new = [k for k, x in enumerate(known) if x is None]
        joins = [bool(WORD(words[k])) for k in new]
        self._learn_joined([words[k] for k, x in zip(new, joins) if x], [words[k] for k, x in zip(new, joins) if not x])
        for k in new:
            known[k] = self.known[words[k]]
        found = pa.array(known, pa.large_binary()).take(units.indices)
        ends = np.frombuffer(found.buffers()[1], np.int64)[: len(found) + 1] // 4 if len(found) else np.zeros(1, np.int64)
        ids = np.frombuffer(found.buffers()[2], np.int32) if ends[-1] else np.zeros(0, np.int32)
        bounds = ends[np.searchsorted(starts, places)].tolist()
        out = [ids[a:b] for a, b in zip(bounds, bounds[1:])]
        self._check(texts.to_pylist(), out)
        if len(other):
            for k, x in zip(other.tolist(), self.encode(rest)):
                out[k] = x
        return out


@lru_cache(maxsize=2)
def units(path: str) -> Units:
    return Units(path)
