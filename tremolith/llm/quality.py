"""Quality by compression: zstandard dictionaries of good and of bad text.

One dictionary is trained on windows of texts labelled good, one on windows of
texts labelled bad, each with its entropy tables.  A text's windows are
compressed with both; the difference in size over the text's length, and nothing
else, is calibrated to a score by a logistic regression on labelled rows that
neither dictionary saw.

Only rows whose crc32(doc_id) mod 3 is not 1 are learnt from, at most
``compression.TRAINING_ROWS`` a class.

Defined results: a null or empty text scores as one of no windows; a null doc_id
is not held out; repeated rows score alike; without labelled rows of both
classes every score is the share of good labels; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from . import compression
from .storage import table

THRESHOLD = 0.5
WINDOW, STEP = 1024, 1024
DICTIONARY_BYTES = 49152


def train(rows: list[tuple[str, int]], counts: dict[int, int]) -> compression.Model:
    learn, tune = [r for k, r in enumerate(rows) if k % 5 < 3], [r for k, r in enumerate(rows) if k % 5 >= 3]
    found = {}
    for y in (0, 1):
        windows = []
        mine = [t.encode("utf-8", "surrogatepass") for t, label in learn if label == y]
        for b in mine:
            windows += [b[i : i + WINDOW] for i in range(0, len(b), max(WINDOW, len(b) * len(mine) // compression.TRAINING_WINDOWS))]
        found[y] = compression.trained_dictionary(DICTIONARY_BYTES, windows, full=True)
    none = np.zeros(0)
    model = compression.Model(found[0], found[1], WINDOW, STEP, compression.STRATEGIES["level 3"], False, "difference", none, none, none, full=True)
    return compression.calibrate(model, tune, counts)


def trained_model(docs: DataFrame, labels: DataFrame) -> compression.Model:
    return compression.fitted(docs, labels, "quality", train)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = trained_model(docs, table(spark, sf_dir, "labels"))
    return compression.score_rows(docs, model, "doc_id", "text", THRESHOLD)
