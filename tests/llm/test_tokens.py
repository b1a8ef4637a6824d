"""SentencePiece, token counts, token files, packing, media."""

import hashlib
import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from facejobs.llm import common, huffman, media, packing, sentencepieces, token_counts, units

ALPHABET = [" ", "  ", "\n", "▁", "the", "Ab", "'s", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "<s>", "<0x0A>", "é", "é", "̸", "日本", "\x00", "😀", "\t", "12", "½", "ß", "İ", "Σς", "!?", "\x1c", "\x85", "\xa0", " ", " ", "　", "ing"]


def cases(n=1500):
    rng = random.Random(0)
    return ["", " ", "\n\n ", "a" * 3000, " " * 3000 + "b"] + ["".join(rng.choices(ALPHABET, k=rng.randint(1, 12))) for _ in range(n)]


def library(name):
    return Tokenizer.from_file(common.tokenizer_file(name))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_units_give_the_librarys_ids(name):
    texts = cases()
    got = units.Units(common.tokenizer_file(name)).encode(texts)
    tk = library(name)
    assert [x.tolist() for x in got] == [tk.encode(t, add_special_tokens=False).ids for t in texts]


def test_a_wrong_cut_stops_the_job():
    u = units.Units(common.tokenizer_file("byte_bpe_50k.json"))
    u.cut = lambda text: list(text)
    with pytest.raises(units.MismatchError):
        u.encode(["several letters"])


BYTES = [*" \t\n\r\x0b\x0c'.,-5", "  ", "a", "B", "7", "s", "re", "'ll", "'S", "''", "\x1c", "\x00", "\x7f", "é", "\u0301", "\u02bc", "½", "²", "\x85", "\xa0", "\u2003", "\u3000", "\u200b", "—", "<|endoftext|>", "<|end"]


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_columns_cut_by_bytes_give_the_librarys_ids(kind):
    rng = random.Random(1)
    texts = [None, "", *cases(300), *("".join(rng.choices(BYTES[: rng.choice([12, 22, len(BYTES)])], k=rng.randint(1, 9))) for _ in range(20_000)), "", None]
    column = pa.array(["left out", *texts, "too"], kind).slice(1, len(texts))
    u, tk = units.Units(common.tokenizer_file("byte_bpe_50k.json")), library("byte_bpe_50k.json")
    want = [e.ids for e in tk.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    for at in range(0, len(texts), 5000):  # the later ones with units known from the first
        assert [x.tolist() for x in u.encode_column(column.slice(at, 5000))] == want[at : at + 5000]
    assert u.encode_column(column.slice(0, 0)) == [] and [len(x) for x in u.encode_column(pa.array([None, ""], kind))] == [0, 0]


@pytest.mark.parametrize("white", ["\xa0", "\x85", "\u1680", "\u2003", "\u2028", "\u202f", "\u205f", "\u3000"])
def test_wide_white_space_is_cut_by_bytes(white):
    u, tk = units.Units(common.tokenizer_file("byte_bpe_50k.json")), library("byte_bpe_50k.json")
    u.encode = None  # no text takes the way by Python strings
    rng = random.Random(2)
    texts = [f"word x\n\n{white}y", f"x\n{white}y {white}z", *("".join(rng.choices([white, " ", "\n", "\t", "a", "é", "'s", ".", "5", "\u200b"], k=rng.randint(1, 9))) for _ in range(3000))]
    assert [x.tolist() for x in u.encode_column(pa.array(texts))] == [e.ids for e in tk.encode_batch(texts, add_special_tokens=False)]
    assert not [w for w in u.known if w[1:].isspace() and not w[0].isspace()]


def test_column_units_are_pre_tokens():
    u = units.Units(common.tokenizer_file("byte_bpe_50k.json"))
    u.encode_column(pa.array(["Here word, word. word; word7 (word)\n word's"]))
    assert set(u.known) == {"Here", " word", ",", ".", ";", "7", " (", "word", ")", "\n", "'s"}


def test_a_wrong_cut_of_bytes_stops_the_job():
    u = units.Units(common.tokenizer_file("byte_bpe_50k.json"))
    u.cut_bytes = lambda data, starts: np.arange(len(data))
    with pytest.raises(units.MismatchError):
        u.encode_column(pa.array(["several letters"]))


def test_sentencepiece_equals_the_library(spark, hard):
    v = sentencepieces.Vocabulary(common.tokenizer_file(sentencepieces.FILE))
    texts = cases()
    ids = v.encode(texts).to_pylist()
    assert ids == v.library.encode(texts) and [v.decode(x) for x in ids] == [v.library.decode(x) for x in ids]
    for t in texts[:400]:
        s = list(t[:60].replace(" ", "▁"))
        assert v._short(list(s)) == v._long(list(s))
    path = common.tokenizer_file(sentencepieces.FILE)
    rows = sentencepieces.decode(sentencepieces.encode(hard, path, out="ids"), path, "ids", "back").collect()
    assert all(r.ids == v.library.encode(r.text or "") and r.back == v.library.decode(r.ids) for r in rows)
    assert sentencepieces.encode(hard.limit(0), path).count() == 0


def test_token_counts(spark, hard, monkeypatch):
    monkeypatch.setattr(token_counts, "BLOCK_BYTES", 3000)
    tk, path = library(token_counts.FILE), common.tokenizer_file(token_counts.FILE)
    got = Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in token_counts.counts(hard, path).collect())
    assert got == Counter((r.doc_id, len((r.text or "").encode()), len(tk.encode(r.text or "", add_special_tokens=False).ids)) for r in hard.collect())
    assert token_counts.counts(hard.limit(0), path).count() == 0


@pytest.mark.parametrize("n", [1, 2, 7, 900])
def test_code_lengths_are_best_and_decode(n):
    rng = np.random.default_rng(n)
    counts = np.maximum(1, (rng.pareto(1.1, n) * 5).astype(np.int64))
    lengths = huffman.code_lengths(counts, 11)
    assert lengths.max() <= 11 and (2.0**-lengths).sum() <= 1
    symbols = np.sort(rng.choice(5000, n, replace=False))
    codes = huffman.Codes(symbols, lengths)
    for size in (0, 1, 255, 256, 257, 3000):
        ids = rng.choice(symbols, size)
        assert (codes.decode(*codes.encode(ids), size) == ids).all()


def test_codes_encoded_in_pieces_are_the_codes_in_a_row(monkeypatch):
    monkeypatch.setattr(huffman, "PIECE", huffman.STRIDE)
    rng = np.random.default_rng(0)
    symbols, counts = np.arange(60_000), np.maximum(1, (rng.pareto(1.1, 60_000) * 5).astype(np.int64))
    codes = huffman.Codes(symbols, huffman.code_lengths(counts, 17))
    order, at, text = np.lexsort((symbols, codes.bits)), 0, {}
    for k in order:
        text[int(symbols[k])] = format(at >> 17 - int(codes.bits[k]), f"0{codes.bits[k]}b")
        at += 1 << 17 - int(codes.bits[k])
    for size in (1, 255, 256, 257, 5000):
        ids = rng.choice(symbols, size)
        bits, checkpoints = codes.encode(ids)
        want = "".join(text[int(x)] for x in ids)
        assert bits == int(want.ljust(-(-len(want) // 8) * 8, "0"), 2).to_bytes(-(-len(want) // 8), "big")
        assert (codes.decode(bits, checkpoints, size) == ids).all()


def test_code_lengths_equal_exhaustive_search():
    from itertools import product

    counts = np.array([1, 1, 2, 5, 9])
    best = min(sum(c * x for c, x in zip(counts, xs)) for xs in product(range(1, 4), repeat=5) if sum(2.0**-x for x in xs) <= 1)
    assert (counts * huffman.code_lengths(counts, 3)).sum() == best


def test_token_files_round_trip(spark, hard, monkeypatch):
    monkeypatch.setattr(huffman, "BLOCK_IDS", 50)
    tk, path = library(huffman.FILE), common.tokenizer_file(huffman.FILE)
    folder = common.new_path(spark, "files")
    huffman.write(hard, path, folder)
    rows = sorted(huffman.read(spark, folder).collect(), key=lambda r: r.start)
    assert [-1 if r.doc_id is None else r.doc_id for r in rows] == sorted(-1 if r.doc_id is None else r.doc_id for r in hard.collect())
    assert Counter(tuple(r.ids) for r in rows) == Counter((*tk.encode(r.text or "", add_special_tokens=False).ids, 2) for r in hard.collect())
    at = 0
    for r, d in zip(rows, sorted(huffman.digests(spark, folder).collect(), key=lambda r: r.start)):
        assert r.start == at == d.start and d.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += len(r.ids)
    none = common.new_path(spark, "files")
    huffman.write(hard.limit(0), path, none)
    assert huffman.read(spark, none).count() == 0


def gapless(rows, capacity):
    by = defaultdict(list)
    for sequence, offset, length in rows:
        by[sequence].append((offset, length))
    for found in by.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


@pytest.mark.parametrize("low, high", [(1, 40), (1300, 2100), (1, 4097), (4096, 4097), (900, 1500)])
def test_plans_hold_every_piece_once(low, high):
    lengths = np.random.default_rng(low).integers(low, high, 3000)
    histogram = Counter(lengths.tolist())
    plan = packing.solve(dict(histogram))
    held = Counter()
    for filling, times in plan.fillings:
        for length, n in filling:
            held[length] += n * times
    assert held == histogram
    ranks = np.concatenate([np.arange(histogram[k]) for k in sorted(histogram)])
    sequence, offset = packing.Places(plan.fillings).find(np.sort(lengths), ranks)
    n = gapless(zip(sequence, offset, np.sort(lengths)), packing.CAPACITY)
    assert plan.bound <= n <= sum(t for _, t in packing._best_fit(dict(histogram), packing.CAPACITY))


def fewest(pieces, capacity):
    """The fewest sequences, by trying every open sequence for every piece."""
    pieces = sorted(pieces, reverse=True)
    best = len(pieces)

    def put(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(pieces):
            best = len(rooms)
            return
        for i, room in enumerate(rooms):
            if room >= pieces[k] and room not in rooms[:i]:
                put(k + 1, [*rooms[:i], room - pieces[k], *rooms[i + 1 :]])
        put(k + 1, [*rooms, capacity - pieces[k]])

    put(0, [])
    return best


def test_plans_against_the_optimum():
    rng = random.Random(4)
    more, program = 0, 0
    for _ in range(150):
        capacity = rng.choice([10, 17, 30])
        pieces = [rng.randint(1, capacity) for _ in range(rng.randint(1, 11))]
        plan, best = packing.solve(Counter(pieces), capacity), fewest(pieces, capacity)
        n = sum(times for _, times in plan.fillings)
        assert plan.bound <= best <= n <= best + 1
        more += n > best
        program += plan.bought > 0
    assert more <= 3 and program >= 100


def test_the_program_places_nine_tenths():
    rng = np.random.default_rng(2)
    lengths = np.minimum(packing.CAPACITY, np.ceil(rng.lognormal(6, 1.2, 8000))).astype(int).tolist()
    for times in (1, 50):
        histogram = {k: n * times for k, n in Counter(lengths).items()}
        plan = packing.solve(histogram)
        n = sum(t for _, t in plan.fillings)
        assert plan.bought >= 0.9 and n <= sum(t for _, t in packing._best_fit(histogram, packing.CAPACITY)) and n <= plan.bound + 1


def test_packing(spark, hard):
    tk = library(packing.FILE)
    got = packing.pack(hard, with_ids=True).collect()
    whole = defaultdict(list)
    for r in sorted(got, key=lambda r: r.piece):
        assert r.length == len(r.ids) and r.start == r.piece * packing.CAPACITY and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    long = next(r for r in hard.collect() if len(r.text or "") > 50_000)
    ids = [*tk.encode(long.text, add_special_tokens=False).ids, 1]
    assert [x for r in sorted((r for r in got if r.doc_id == long.doc_id), key=lambda r: r.piece) for x in r.ids] == ids
    assert whole == {} and sum(r.length for r in got) == sum(len(tk.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in hard.collect())
    gapless([(r.sequence_id, r.offset, r.length) for r in got], packing.CAPACITY)
    assert packing.pack(hard.limit(0)).count() == 0


def filtered(samples, kinds):
    """A PNG with given row filters, by the definitions, pixel by pixel."""
    x = np.frombuffer(samples, np.uint8).reshape(-1, media.WIDTH).astype(int)
    raw = b""
    for r, kind in enumerate(kinds):
        row = []
        for c in range(media.WIDTH):
            a = x[r, c - 1] if c else 0
            b = x[r - 1, c] if r else 0
            d = x[r - 1, c - 1] if r and c else 0
            p = a + b - d
            near = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - d) else b if abs(p - b) <= abs(p - d) else d
            row.append(int(x[r, c] - (0, a, b, (a + b) // 2, near)[kind]) & 255)
        raw += bytes([kind, *row])
    head = struct.pack(">IIBBBBB", media.WIDTH, len(kinds), 8, 0, 0, 0, 0)
    return media.SIGNATURE + media._chunk(b"IHDR", head) + media._chunk(b"IDAT", zlib.compress(raw)) + media._chunk(b"IEND", b"")


def test_png_filters_and_checksums():
    rng = np.random.default_rng(8)
    kinds = [0, 1, 2, 2, 3, 4, 4, 1, 0, 3]
    samples = rng.integers(0, 256, media.WIDTH * len(kinds), np.uint8).tobytes()
    assert media.decode_png(filtered(samples, kinds)).tobytes() == samples
    assert media.decode_png(media.encode_png(samples)).tobytes() == samples
    png = bytearray(media.encode_png(samples))
    for at in (0, 18, 60, len(png) - 3):
        bad = bytes(png[:at] + bytes([png[at] ^ 1]) + png[at + 1 :])
        with pytest.raises(media.PngError):
            media.decode_png(bad)
    with pytest.raises(media.PngError):
        media.decode_png(bytes(png[:-5]))


def test_media_columns(spark, hard):
    stored = media.store(hard).select("doc_id", "text", f"{common.RESULT}.*")
    rows = media.features(common.stage(stored, "media")).collect()
    assert len(rows) == hard.count()
    for r in rows:
        raw = (r.text or "").encode()
        padded = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        f = r[common.RESULT]
        assert (r.n_bytes, f.payload_bytes, f.payload_sha256, f.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert f.media_bytes == len(r.png) and f.media_sha256 == hashlib.sha256(r.png).hexdigest() and f.feature == f.feature_bytes.hex()
    assert media.store(hard.limit(0)).count() == 0
