"""Encoding of a corpus equals direct encoding, whatever the texts."""

import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from loomgrid.llm import tokens
from loomgrid.llm.tokens import encode_corpus, encoding


def encoded(spark, rows):
    return sorted((r.doc_id or 0, list(r.ids)) for r in encode_corpus(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def test_repeated_ids_stay_rows(spark):
    """Each row comes out with the ids of its own text, whatever its doc_id."""
    text = " ".join(f"word{i}" for i in range(2000))
    rows = [(1, text), (1, text), (1, "other text"), (2, text), (None, "no id")]
    assert encoded(spark, rows) == sorted((d or 0, encoding().encode_ordinary(t)) for d, t in rows)


def test_awkward_texts(spark):
    """No blanks to cut at, one word of 30,000 letters, control characters, special tokens, entities of all planes."""
    rng = random.Random(4)
    texts = ["", None, "漢字" * 9000, "x" * 30_000, "\x00\x01 \t\r\n" * 300, "<|endoftext|> " * 200, "".join(chr(rng.choice([9, 32, 65, 233, 0x4E2D, 0x1F600, 0x300])) for _ in range(20_000)), "a " * 12_000, "é" * 9000 + " don't " * 3000]
    assert encoded(spark, list(enumerate(texts))) == [(i, encoding().encode_ordinary(t) if t else []) for i, t in enumerate(texts)]


def test_joins_are_repaired():
    """Chunks cut anywhere come out as the whole text's ids."""
    e, rng = encoding(), random.Random(9)
    for text in ("漢字かな交じり文" * 40, "aaaaaaaaab" * 60, "don't won't 12345 " * 30, "x" * 500):
        for _ in range(5):
            at = sorted(rng.sample(range(1, len(text)), 3))
            parts = [e.encode_ordinary(text[a:z]) for a, z in zip([0, *at], [*at, len(text)])]
            assert tokens.repaired(parts, [False, False, False, True], e) == e.encode_ordinary(text)


@settings(max_examples=60, deadline=None, suppress_health_check=[HealthCheck.too_slow])
@given(st.text(max_size=300), st.integers(0, 300), st.integers(0, 300))
def test_any_cut_is_repaired(text, a, b):
    e, (a, b) = encoding(), sorted((min(a, len(text)), min(b, len(text))))
    parts = [e.encode_ordinary(text[i:j]) for i, j in ((0, a), (a, b), (b, len(text)))]
    assert e.decode(tokens.repaired(parts, [False, False, True], e)) == text


def test_bytes_that_are_no_text(spark):
    rows = spark.sql("SELECT 1L AS doc_id, cast(X'41FF42' AS string) AS text")
    assert list(encode_corpus(rows).first().ids) == encoding().encode_ordinary("A�B")
    assert tokens.count_tokens(rows).first().tokens == len(encoding().encode_ordinary("A�B"))


def test_empty_table(spark):
    assert encode_corpus(spark.createDataFrame([], "doc_id long, text string")).count() == 0
