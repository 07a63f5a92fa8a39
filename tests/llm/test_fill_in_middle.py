"""Fill-in-the-middle against a plain version."""

import hashlib
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tremolith.llm import fill_in_middle as fim

ALPHABET = "aB <>PSM\né漢\U0001f600é"


def plain_version(key, text):
    """The contract, with slices of the text alone."""
    t = text or ""
    seed = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(seed[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(t)
    if not t or "<P>" in t or "<S>" in t or "<M>" in t or h3 % 100 >= 90:
        return n, "plain", None, None, t
    a, b = min(h1 % (n + 1), h2 % (n + 1)), max(h1 % (n + 1), h2 % (n + 1))
    parts = t[:a], t[a:b], t[b:]
    out = f"<S>{parts[2]}<P>{parts[0]}<M>{parts[1]}" if h4 % 100 < 20 else f"<P>{parts[0]}<S>{parts[2]}<M>{parts[1]}"
    return n, "spm" if h4 % 100 < 20 else "psm", a, b - a, out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(12)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.choice((1, 2, 5, 30, 300)))) for _ in range(150)]
    texts += ["", None, "<P>", "x<M>y", "a" * 257, "long é " * 40_000]
    return [*enumerate(texts), (None, "lost"), (None, None), (3, "twice"), (3, "twice"), (4, "another with the id 4")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, form string, n int")


def test_equals_the_plain_version(spark, rows):
    got = fim.fill_in_middle(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    key = lambda x: tuple((v is None, v) for v in x)
    mine = sorted(((r.row.doc_id, r.row.text, r.n, r["form"], r.prefix_chars, r.middle_chars, r.output) for r in got), key=key)
    assert mine == sorted(((i, t, *plain_version(i, t)) for i, t in rows), key=key)
    assert {r.row["form"] for r in got} == {"x"}  # a column of the same name is kept
    assert {m[3] for m in mine} == {"plain", "psm", "spm"}


def test_digests_are_those_of_the_texts(spark, rows):
    made = fim.fill_in_middle(frame(spark, rows), digests=True)
    assert all(r.restored_sha256 == hashlib.sha256((r.row.text or "").encode()).hexdigest() for r in made.collect())
    whole = fim.fill_in_middle(frame(spark, rows)).select("output", F.sha2("output", 256).alias("d")).collect()
    assert sorted(r.d for r in whole) == sorted(r.output_sha256 for r in made.collect())


def test_the_inverse_as_a_column(spark, rows):
    made = fim.fill_in_middle(frame(spark, rows)).select("row.text", fim.restored_column(F.col("output"), F.col("form")).alias("back"))
    assert all((r.text or "") == r.back for r in made.collect())


@given(st.text(ALPHABET, min_size=1, max_size=30).filter(lambda t: not any(m in t for m in ("<P>", "<S>", "<M>"))), st.integers())
def test_round_trip(text, key):
    unit = fim.unit_pattern()
    for spm in (0, 100):
        n, form, a, b, out = fim.cut(text, key, unit, cut_percent=100, spm_percent=spm)
        assert n == len(text) and form == ("spm" if spm else "psm")
        assert fim.restored(out, form) == text


def test_other_units():
    text = "one two\n three  four"
    assert list(fim.unit_ends(text, fim.unit_pattern("word"))) == [3, 7, 14, 20]
    assert list(fim.unit_ends("a\n\nb", fim.unit_pattern("line"))) == [2, 3, 4]
    assert list(fim.unit_ends("éx", fim.unit_pattern(r"\X"))) == [2, 3]
    for key in range(20):
        n, form, a, b, out = fim.cut(text, key, fim.unit_pattern("word"))
        assert n == 4 and fim.restored(out, form) == text
        assert form == "plain" or a in (0, 3, 7, 14, 20)


def test_empty_table(spark):
    assert fim.fill_in_middle(frame(spark, [])).count() == 0
