"""Several notices in one file all give their labels."""

import time

import pytest

from facejobs.llm import licences


def test_all_notices_of_a_file(spark):
    common = ["licensed under the gnu general public license version 3", "licensed under the apache license version 2.0", "licensed under cc by nc 4.0"]
    bsd = "redistribution and use in source and binary forms with or without modification are permitted"
    rows = [(0, "\n".join([bsd, *common]))] + [(k, common[k % 3]) for k in range(1, 31)]
    got = {r.doc_id: r for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0].labels == "apache,apache-2.0,bsd,cc-by,cc-by-nc,gpl,gpl-3"
    assert got[0].score == 1.0 and len(got) == 31


def test_every_template_in_one_file(spark):
    notices = [t.notice for t in licences.TEMPLATES]
    filler = " in the of and or to it any " * 200
    rows = [(0, "\n".join(notices)), (1, filler.join(notices)), (2, filler)]
    got = {r.doc_id: r for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    every = ",".join(sorted({t.label for t in licences.TEMPLATES}))
    assert got[0].labels == got[1].labels == every and got[2].labels == ""


def test_a_long_text_of_licence_words_alone_is_linear(spark):
    """1.3 MB in which every word is one of a notice's."""
    n = 100_000
    docs = spark.createDataFrame([(1, "cc by nc 4.0 " * n), (2, "cc by nc 4.0"), (3, "licensed under cc by nc 4.0")], "doc_id long, text string")
    began = time.time()
    got = {r.doc_id: r for r in licences.scan(docs).collect()}
    assert time.time() - began < 60
    assert (got[1].n_words, got[1].n_base, got[1].first_word, got[1].last_word) == (5 * n, n, 0, 5 * n - 5)
    assert got[1].labels == got[2].labels == got[3].labels and "cc-by" in got[1].labels


def test_words_beyond_ten_bits_are_refused():
    from facejobs.llm.licences import Index, Template

    many = " ".join(f"w{k}" for k in range(2000))
    with pytest.raises(ValueError):
        Index((Template("x", many, "w0 w1"),))
