"""Classification of texts by how well two zstandard dictionaries compress them.

A text is cut into windows; each is compressed with two dictionaries of equal
length, and the differences in compressed size, summed up in a few numbers a
text, go through a logistic calibration fitted on other labelled rows than the
dictionaries.  Whole texts are scored, in batches inside zstandard.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .words import row_slices

#: Labelled rows of a class that training may see: the first in the order of a
#: hash of doc_id, so the same rows wherever and however the tables are stored.
TRAINING_ROWS = 2000
#: And the bytes of their texts: rows beyond, in the same order, are not seen.
TRAINING_BYTES = 64 << 20
#: Windows that go to the dictionary builder.
TRAINING_WINDOWS = 30_000
#: Characters whose windows are compressed together.
BATCH = 1 << 18


@dataclass
class Model:
    first: bytes  # dictionaries; differences are size by first minus by second
    second: bytes
    window: int
    step: int
    strategy: dict
    fold_case: bool
    summary: str
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # the last is the intercept
    more: tuple[tuple[bytes, bytes], ...] = ()  # further pairs, each summed up by itself
    full: bool = False  # whether the dictionaries' entropy tables are used too


STRATEGIES = {
    "fine": {"window_log": 17, "hash_log": 16, "chain_log": 15, "search_log": 3, "min_match": 4, "target_length": 16, "strategy": zstandard.STRATEGY_LAZY},
    "level 3": {"window_log": 21, "hash_log": 17, "chain_log": 16, "search_log": 1, "min_match": 5, "target_length": 0, "strategy": zstandard.STRATEGY_DFAST},
}


def compressor(dictionary: bytes, strategy: dict, full: bool = False) -> zstandard.ZstdCompressor:
    content = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_AUTO if full else zstandard.DICT_TYPE_RAWCONTENT)
    params = zstandard.ZstdCompressionParameters(**strategy, write_content_size=False, write_checksum=False, write_dict_id=False)
    content.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=content, compression_params=params)


def window_segments(length: int, window: int, step: int) -> np.ndarray:
    """(start, size) of the windows that cover a text; none for an empty one."""
    if length == 0:
        return np.zeros((0, 2), np.uint64)
    start = np.arange(0, max(1, length - (window - step)), step, dtype=np.uint64)
    return np.stack([start, np.minimum(np.uint64(window), np.uint64(length) - start)], axis=1)


def sizes(with_: zstandard.ZstdCompressor, data: bytes, segments: np.ndarray) -> np.ndarray:
    found = []
    for a in range(0, len(segments), 1 << 15):
        some = segments[a : a + (1 << 15)].astype(np.uint64)
        out = with_.multi_compress_to_buffer(zstandard.BufferWithSegments(data, some.tobytes()), threads=1)
        found.append(np.fromiter((len(out[i]) for i in range(len(out))), np.int64, len(out)))
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def peaks(raw: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The largest differences of a text, and how many windows they are among."""
    d = np.sort(a - b)[::-1].astype(float)
    top = np.zeros(3)
    top[: min(3, len(d))] = d[:3]
    n = np.log1p(len(d))
    return np.array([top[0], top[1], top[2], top[0] ** 2, np.maximum(d - 2, 0).sum() / np.sqrt(max(1, len(d))), n, n * top[0]])


def difference(raw: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The normalised difference in compressed size over the whole text."""
    return np.array([(a.sum() - b.sum()) / raw.sum() if len(raw) else 0.0])


SUMMARIES: dict[str, Callable] = {"peaks": peaks, "difference": difference}


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.pairs = [(compressor(a, model.strategy, model.full), compressor(b, model.strategy, model.full)) for a, b in ((model.first, model.second), *model.more)]

    def features(self, texts: list[str | None]) -> np.ndarray:
        m = self.model
        blobs = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        blobs = [b.lower() for b in blobs] if m.fold_case else blobs
        parts, base = [], 0
        for b in blobs:
            seg = window_segments(len(b), m.window, m.step)
            seg[:, 0] += np.uint64(base)
            parts.append(seg)
            base += len(b)
        every, data = np.concatenate(parts), b"".join(blobs)
        raw = every[:, 1].astype(np.int64)
        ends = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
        summary = SUMMARIES[m.summary]
        found = []
        for first, second in self.pairs:
            a, b_ = (sizes(first, data, every), sizes(second, data, every)) if len(every) else (np.zeros(0, np.int64),) * 2
            found.append(np.array([summary(raw[i:j], a[i:j], b_[i:j]) for i, j in zip(ends[:-1], ends[1:], strict=True)]))
        return np.concatenate(found, axis=1)

    def batches(self, texts: list[str | None]) -> Iterator[list[str | None]]:
        """Some texts at a time, about BATCH characters, a longer one alone."""
        a, held = 0, 0
        for b, t in enumerate(texts):
            held += len(t or "")
            if b > a and held > BATCH:
                yield texts[a:b]
                a, held = b, len(t or "")
        if a < len(texts):
            yield texts[a:]

    def scores(self, texts: list[str | None]) -> np.ndarray:
        x = [self.features(some) for some in self.batches(texts)]
        x = (np.concatenate(x) - self.model.mean) / self.model.scale if x else np.zeros((0, len(self.model.mean)))
        z = x @ self.model.weights[:-1] + self.model.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def trained_dictionary(size: int, samples: list[bytes], full: bool = False) -> bytes:
    """A dictionary out of samples, with entropy tables if ``full`` (its content
    alone otherwise); of few samples their own bytes."""
    samples = [s for s in samples if len(s) >= 8]
    total = sum(map(len, samples))
    if len(samples) >= 64 and total >= 4 * size:
        found = zstandard.train_dictionary(size, samples).as_bytes()
        return found if full else found[-size:]
    return b" ".join(samples)[-size:] or b" "


def fit_logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weighted ridge logistic regression: mean, scale, weights (intercept last)."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    x = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = w / w.sum() * len(w)
    beta, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge * len(x) / 100)
    penalty[-1] = 1e-6
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -35, 35)))
        g = x.T @ (w * (p - y)) + penalty * beta
        h = (x * (w * p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(h, g)
        beta -= step * min(1.0, 4 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, beta


def training_rows(docs: DataFrame, labels: DataFrame, label: str, rows: int = TRAINING_ROWS) -> tuple[DataFrame, dict[int, int]]:
    """``i, text, y`` of at most ``rows`` labelled rows a class that are not held
    out, of TRAINING_BYTES a class, and how many rows a class has."""
    ids = labels.select(F.col("doc_id").cast("long").alias("i"), F.col(label).alias("y")).filter("i IS NOT NULL AND y IN (0, 1)")
    ids = ids.filter(~held_out(F.col("i")))
    counts = {r[0]: r[1] for r in ids.groupBy("y").count().collect()}
    some = None
    for y in (0, 1):
        part = ids.filter(F.col("y") == y).orderBy(F.xxhash64("i"), "i").limit(rows)
        some = part if some is None else some.unionAll(part)
    # At most 2 * rows ids.
    found = docs.select(F.col("doc_id").cast("long").alias("i"), "text").join(F.broadcast(some.dropDuplicates(["i"])), "i").filter("text IS NOT NULL AND text != ''")
    # A window over at most ``rows`` rows.
    along = Window.partitionBy("y").orderBy(F.xxhash64("i"), "i", F.xxhash64("text")).rowsBetween(Window.unboundedPreceding, 0)
    return found.withColumn("bytes", F.sum(F.octet_length("text").cast("long")).over(along)).filter(F.col("bytes") <= TRAINING_BYTES).select("i", "text", "y"), counts


def fitted(docs: DataFrame, labels: DataFrame, label: str, train: Callable[[list[tuple[str, int]], dict[int, int]], Model]) -> Model:
    """The model that ``train`` makes of the training rows, (text, label) in hash
    order, and of the classes' counts.  One task on an executor fits it on the
    bounded sample; the driver sees the model alone."""
    found, counts = training_rows(docs, labels, label)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        seen: dict[str, int] = {}
        for _, text, y in sorted(got, key=lambda r: (zlib.crc32(str(r[0]).encode()) * 2654435761 % 2**32, r[0])):
            seen.setdefault(text, y)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(list(seen.items()), counts))], pa.binary())], names=["model"])

    made = found.repartition(1).mapInArrow(fit, "model binary").collect()
    return pickle.loads(made[0]["model"]) if made else train([], counts)


def held_out(id_column) -> F.Column:
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def calibrate(model: Model, rows: list[tuple[str, int]], counts: dict[int, int]) -> Model:
    """The model with mean, scale and weights fitted on ``rows``, weighted to the
    classes' true shares."""
    y = np.array([y for _, y in rows], float)
    if len(set(y.tolist())) < 2:
        n = len(SUMMARIES[model.summary](np.zeros(0), np.zeros(0), np.zeros(0))) * (1 + len(model.more))
        share = (counts.get(1, 0) + 0.5) / (sum(counts.values()) + 1)
        model.mean, model.scale, model.weights = np.zeros(n), np.ones(n), np.append(np.zeros(n), np.log(share / (1 - share)))
        return model
    scorer = Scorer(model)
    x = np.concatenate([scorer.features(some) for some in scorer.batches([t for t, _ in rows])])
    shares = {k: counts.get(k, 1) / max(1, (y == k).sum()) for k in (0, 1)}
    model.mean, model.scale, model.weights = fit_logistic(x, y, np.where(y == 1, shares[1], shares[0]))
    return model


def score_rows(df: DataFrame, model: Model, id_col: str, text_col: str, threshold: float) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for whole in batches:
            for batch in row_slices(whole):
                s = scorer.scores(batch.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"]
                )

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(work, "doc_id bigint, held_out boolean, score double, predicted int")


def keep_below(df: DataFrame, model: Model, text_col: str, threshold: float) -> DataFrame:
    """The rows that score under ``threshold``, with all their columns.  Only the
    texts go through the workers."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def below(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(shared.value)
        for texts in batches:
            yield pd.Series(scorer.scores(texts.tolist()) < threshold, dtype=bool)

    return df.filter(below(F.col(text_col)))
