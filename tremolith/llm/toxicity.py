"""Toxicity by compression distance between toxic and ordinary text.

Three pairs of zstandard dictionaries give differences for each 128-byte window:

* a dictionary trained on windows of toxic texts against one trained on windows
  of ordinary texts;
* the ordinary one with frequent toxic words before it (words of toxic texts
  whose beginnings are far more frequent there) against the same with filler that
  matches nothing, so that only toxic words make a difference;
* likewise with the rare toxic words, of four texts or more.

Toxic texts are ordinary but for a few words, so the trained pair alone hardly
tells them apart.  A text's largest differences by each pair are calibrated
together to a score by a logistic regression on labelled rows that no dictionary
saw, which weighs the pairs.

Only rows whose crc32(doc_id) mod 3 is not 1 are learnt from, at most
``compression.TRAINING_ROWS`` a class.

Defined results: a null or empty text scores as one without any difference; a
null doc_id is not held out; repeated rows score alike; without labelled rows of
both classes every score is the toxic share of the labels; an empty table gives
an empty result; further columns are ignored or, in :func:`remove_toxic`, kept.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from . import compression
from .storage import table

THRESHOLD = 0.7
WINDOW, STEP = 128, 112
COMMON_BYTES, TOXIC_BYTES = 32768, 8192
#: A word's beginning is toxic if at least 1/RARE of the toxic texts have it and
#: its share among them is OFTEN times its share among ordinary texts.
RARE, OFTEN = 60, 30
#: A rare one is in at least this many; SMOOTH is added to its ordinary count.
LEAST, SMOOTH = 4, 0.1
SHORTEST, LONGEST = 4, 12
_WORD_ENDS = bytes(c if 48 <= c < 58 or 97 <= c < 123 or c >= 128 or c == 39 else 32 for c in range(256))


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().translate(_WORD_ENDS).split()


def _beginnings(text: str) -> set[bytes]:
    out = set()
    for w in set(words(text)):
        out.update(w[:k] for k in range(SHORTEST, min(len(w), LONGEST) + 1))
        if len(w) < SHORTEST:
            out.add(w + b" ")
    return out


def toxic_words(toxic: list[str], ordinary: list[str], rare: bool = False) -> list[bytes]:
    """Words of toxic texts with a toxic beginning, the most frequent last."""
    there, here = Counter(), Counter()
    for t in toxic:
        there.update(_beginnings(t))
    for t in ordinary:
        here.update(_beginnings(t))
    least, smooth = (LEAST, SMOOTH) if rare else (max(3, len(toxic) // RARE), 0.5)
    chosen = {p for p, n in there.items() if n >= least and n / len(toxic) >= OFTEN * (here[p] + smooth) / max(1, len(ordinary))}
    found = Counter()
    for t in toxic:
        found.update(w for w in words(t) if w + b" " in chosen or any(w[:k] in chosen for k in range(SHORTEST, min(len(w), LONGEST) + 1)))
    return [w for w, _ in sorted(found.items(), key=lambda wn: (wn[1], wn[0]))]


def windows(texts: list[str]) -> list[bytes]:
    out = []
    for t in texts:
        b = t.encode("utf-8", "surrogatepass").lower()
        out += [b[i : i + 96] for i in range(0, len(b), max(96, len(b) * len(texts) // compression.TRAINING_WINDOWS))]
    return out


def with_words(common: bytes, chosen: list[bytes]) -> tuple[bytes, bytes]:
    """The common dictionary after filler and after the chosen words."""
    lead = (b" " + b" ".join(chosen))[-TOXIC_BYTES:] + b" "
    return b"\x01" * len(lead) + common, lead + common


def train(rows: list[tuple[str, int]], counts: dict[int, int]) -> compression.Model:
    learn, tune = [r for k, r in enumerate(rows) if k % 5 < 3], [r for k, r in enumerate(rows) if k % 5 >= 3]
    toxic, ordinary = [t for t, y in learn if y == 1], [t for t, y in learn if y == 0]
    common, trained = (compression.trained_dictionary(COMMON_BYTES, windows(texts)) for texts in (ordinary, toxic))
    frequent = toxic_words(toxic, ordinary) if toxic else []
    rare = set(frequent)
    rare = [w for w in toxic_words(toxic, ordinary, True) if w not in rare] if toxic else []
    size = min(len(common), len(trained))
    (filler, words_first), further = with_words(common, frequent), with_words(common, rare)
    model = compression.Model(
        filler, words_first, WINDOW, STEP, compression.STRATEGIES["fine"], True, "peaks", np.zeros(0), np.zeros(0), np.zeros(0),
        more=((common[-size:], trained[-size:]), further),
    )
    return compression.calibrate(model, tune, counts)


def trained_model(docs: DataFrame, labels: DataFrame) -> compression.Model:
    return compression.fitted(docs, labels, "toxic", train)


def remove_toxic(docs: DataFrame, model: compression.Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    return compression.keep_below(docs, model, text_col, threshold)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = trained_model(docs, table(spark, sf_dir, "labels"))
    return compression.score_rows(docs, model, "doc_id", "text", THRESHOLD)
