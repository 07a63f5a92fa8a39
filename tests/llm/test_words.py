import numpy as np
import pyarrow as pa

from tremolith.llm import words as w
from tremolith.llm.words import shingle_hashes, shingle_set, shingle_sets, text_words


def test_words_split_on_ascii_white_space_and_fold_ascii_case():
    a, b = text_words("Ab\tCD"), text_words("ab cd")
    assert len(a) == 2 and np.array_equal(a, b)
    accented = text_words("\u00c4b\u00a0x \u00e4b")
    assert len(accented) == 2 and accented[0] != accented[1]
    assert len(text_words(None)) == len(text_words("")) == len(text_words(" \n")) == 0


def test_long_texts_are_cut_between_words(monkeypatch):
    text = " ".join(f"word{i}" for i in range(500)) + " " + "x" * 300
    whole = text_words(text)
    monkeypatch.setattr(w, "_PART", 64)
    assert np.array_equal(text_words(text), whole)


def test_crafted_words_do_not_collide():
    morse = "a"
    while len(morse) < 2048:
        morse += morse.translate(str.maketrans("ab", "ba"))
    assert text_words(morse)[0] != text_words(morse.translate(str.maketrans("ab", "ba")))[0]


def test_shingles_match_tuples():
    rng = np.random.default_rng(0)
    texts = [" ".join(rng.choice(list("abc"), n)) for n in (0, 1, 3, 4, 5, 6, 40, 200)]
    for t, s in zip(texts, shingle_sets(pa.array(texts)), strict=True):
        w = t.split()
        assert len(s) == len({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else ())
    assert len(shingle_hashes(np.array([1, 2], np.uint64))) == 1
    assert np.array_equal(shingle_set("a b c d e f"), shingle_set("A B  C\nd e f"))
