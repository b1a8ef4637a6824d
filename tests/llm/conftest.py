import pytest

HARD = [
    None, "", " ", "\n\n", "word", "the the the", "a b c d e f g h a b c d e f g h", "Zeile\nZeile\nZeile", "licensed under the Apache License, Version 2.0.",
    "CC-BY", "<|endoftext|> x <|endoftext|>", "<s> ▁▁ <0x0A>", "日本語 テキスト", "\x00\x1f\x85 ", "é́İΣς", "x" * 5000, "long text with words " * 4000,
]


@pytest.fixture(scope="session")
def hard(spark):
    """Nulls in every column, repeated rows and ids, empty and long texts, clashing names."""
    rows = [(k, t, "en", "s", 1, k, "kept", 0.5) for k, t in enumerate(HARD)]
    rows += [rows[4], (None, "no id", None, None, None, None, None, None), (3, "other text of an id", None, "s", None, None, None, None)]
    columns = "doc_id long, text string, lang string, source string, n_chars long, n_words long, kept string, score double"
    return spark.createDataFrame(rows, columns)


@pytest.fixture(scope="session")
def labels(spark, hard):
    return spark.createDataFrame([(k, k % 2, (k + 1) % 2) for k in range(len(HARD))] + [(None, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int")
