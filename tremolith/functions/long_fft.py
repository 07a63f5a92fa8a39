"""Spectra of channels of any length by the four-step transform.

n samples are laid out as n1 rows of n2, near square.  The columns are transformed,
each a task's small array; twiddle factors follow; one shuffle transposes, in blocks
of rows; the rows are transformed.  No task holds more than a block of about BLOCK
values.  Lengths without a fitting divisor go by Bluestein's chirp convolution with
the next power of two, three transforms of the same kind.

Frames are long: signal_id, channel, n, i, re, im, with dense i below n.  Null
samples count as zero; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from ..model import KEYS
from ..operators.long import centred, with_length
from ..shared import written

#: Values that a block of rows holds, and the longest row that is transformed at once.
BLOCK, LONGEST = 1 << 20, 1 << 22
_ID = [*KEYS, "n", "n1"]
_SCHEMA = "signal_id string, channel int, n bigint, n1 bigint"


def rows_for(n: int) -> int:
    """The largest divisor of n up to its root; 0 if the other is too long."""
    best, rest, found = 1, n, {1}
    p = 2
    while p * p <= rest:
        while rest % p == 0:
            found |= {d * p for d in found}
            rest //= p
        p += 1
    found |= {d * rest for d in found}
    best = max(d for d in found if d * d <= max(n, 1))
    return best if n // max(best, 1) <= LONGEST else 0


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _columns_transformed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = [_column(batch, c) for c in _ID]
        for k, held in enumerate(_column(batch, "held")):
            n, n1, c = ids[2][k].as_py(), ids[3][k].as_py(), _column(batch, "c")[k].as_py()
            n2 = n // n1
            z = np.fft.fft(held.values.field("re").to_numpy() + 1j * held.values.field("im").to_numpy())
            turn = np.arange(n1, dtype=np.int64) * c % n
            z *= np.exp(-2j * np.pi * (turn / n))
            width = max(1, BLOCK // n2)
            starts = range(0, n1, width)
            kind = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays(
                [
                    *(pa.repeat(i[k], len(starts)) for i in ids), pa.array([a // width for a in starts], pa.int64()), pa.array([c] * len(starts), pa.int64()),
                    pa.array([z.real[a : a + width] for a in starts], kind), pa.array([z.imag[a : a + width] for a in starts], kind),
                ],
                names=[*_ID, "block", "c", "re", "im"],
            )


def _rows_transformed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = [_column(batch, c) for c in _ID]
        for k, held in enumerate(_column(batch, "held")):
            n, n1 = ids[2][k].as_py(), ids[3][k].as_py()
            n2, first = n // n1, _column(batch, "block")[k].as_py() * max(1, BLOCK // (n // n1))
            part = lambda name, held=held, n2=n2: held.values.field(name).flatten().to_numpy().reshape(n2, -1)
            z = np.fft.fft(part("re") + 1j * part("im"), axis=0)
            rows, kind = z.shape[1], pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays(
                [*(pa.repeat(i[k], rows) for i in ids), pa.array(np.arange(first, first + rows)), pa.array(list(z.real.T.copy()), kind), pa.array(list(z.imag.T.copy()), kind)],
                names=[*_ID, "row", "re", "im"],
            )


def _four_step(frame: DataFrame) -> DataFrame:
    """A frame with ``n1`` to its transform."""
    n2 = F.expr("n div n1")
    at = F.struct(F.expr("i div (n div n1)").alias("r"), "re", "im")
    columns = frame.groupBy(*_ID, F.pmod("i", n2).alias("c")).agg(F.array_sort(F.collect_list(at)).alias("held"))
    blocks = columns.mapInArrow(_columns_transformed, f"{_SCHEMA}, block bigint, c bigint, re array<double>, im array<double>")
    rows = blocks.groupBy(*_ID, "block").agg(F.array_sort(F.collect_list(F.struct("c", "re", "im"))).alias("held"))
    found = rows.mapInArrow(_rows_transformed, f"{_SCHEMA}, row bigint, re array<double>, im array<double>")
    each = found.select(*KEYS, "n", "n1", "row", F.posexplode(F.arrays_zip("re", "im")).alias("k", "z"))
    return each.select(*KEYS, "n", (F.col("row") + F.col("n1") * F.col("k")).alias("i"), "z.re", "z.im")


def _with_rows(frame: DataFrame) -> DataFrame:
    known = frame.select("n").distinct()
    rows = F.udf(rows_for, IntegerType(), useArrow=False)  # once a length
    return frame.join(known.withColumn("n1", rows("n").cast("long")), "n")


def _product(a: DataFrame, b: DataFrame) -> DataFrame:
    met = a.join(b.select(*KEYS, "i", F.col("re").alias("x"), F.col("im").alias("y")), [*KEYS, "i"])
    return met.select(*KEYS, "n", "i", (F.col("re") * F.col("x") - F.col("im") * F.col("y")).alias("re"), (F.col("re") * F.col("y") + F.col("im") * F.col("x")).alias("im"))


def _turned(frame: DataFrame, sign: int) -> DataFrame:
    """Times exp(sign pi j i^2 / n); the square is taken modulo 2 n."""
    angle = math.pi * (F.col("i") % (2 * F.col("n")) * (F.col("i") % (2 * F.col("n"))) % (2 * F.col("n"))).cast("double") / F.col("n")
    c, s = F.cos(angle), sign * F.sin(angle)
    return frame.withColumns({"re": F.col("re") * c - F.col("im") * s, "im": F.col("re") * s + F.col("im") * c})


def _bluestein(frame: DataFrame) -> DataFrame:
    size = F.pow(F.lit(2.0), F.ceil(F.log2(2.0 * F.col("n") - 1))).cast("long")
    lengths = frame.select(*KEYS, "n").distinct().withColumn("m", size)

    def padded(values: DataFrame) -> DataFrame:
        every = lengths.select(*KEYS, "m", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("i"))
        return every.join(values.select(*KEYS, "i", "re", "im"), [*KEYS, "i"], "left").select(*KEYS, F.col("m").alias("n"), "i", F.coalesce("re", F.lit(0.0)).alias("re"), F.coalesce("im", F.lit(0.0)).alias("im"))

    ones = lengths.select(*KEYS, "n", "m", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i")).withColumns({"re": F.lit(1.0), "im": F.lit(0.0)})
    chirp = _turned(ones, 1)
    chirp = chirp.withColumn("i", F.explode(F.when(F.col("i") == 0, F.array("i")).otherwise(F.array("i", F.col("m") - F.col("i")))))
    spread = _product(transformed(padded(_turned(frame, -1))), transformed(padded(chirp)))
    back = inverse(spread).withColumnRenamed("n", "m").join(lengths.drop("m"), list(KEYS)).filter(F.col("i") < F.col("n"))
    return _turned(back.select(*KEYS, "n", "i", "re", "im"), -1)


def transformed(frame: DataFrame) -> DataFrame:
    """The discrete Fourier transform of every channel."""
    frame = _with_rows(frame)
    lengths = frame.select(F.col("n1") > 0).distinct().collect()  # two rows at most
    out = _four_step(frame.filter("n1 > 0"))
    return out if all(r[0] for r in lengths) else out.unionByName(_bluestein(frame.filter("n1 = 0").drop("n1")))


def inverse(frame: DataFrame) -> DataFrame:
    found = transformed(frame.withColumn("im", -F.col("im")))
    return found.withColumns({"re": F.col("re") / F.col("n"), "im": -F.col("im") / F.col("n")})


def complex_frame(samples: DataFrame) -> DataFrame:
    """The long form of signals as a frame."""
    return with_length(samples).select(*KEYS, "n", "i", F.coalesce("value", F.lit(0.0)).alias("re"), F.lit(0.0).alias("im"))


def spectrum(samples: DataFrame, sample_rate: float = 1.0) -> DataFrame:
    """``signal_id, channel, k, f, s``: magnitudes from 0 Hz to half the rate."""
    found = transformed(complex_frame(samples)).filter(F.col("i") <= F.col("n") / 2)
    size = F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im"))
    return found.select(*KEYS, F.col("i").alias("k"), (F.col("i") * sample_rate / F.col("n")).alias("f"), size.alias("s"))


def envelope(samples: DataFrame) -> DataFrame:
    """The size of the analytic signal, as samples."""
    found = transformed(complex_frame(samples))
    i, n = F.col("i"), F.col("n")
    weight = F.when((i == 0) | (2 * i == n), 1.0).when(2 * i < n, 2.0).otherwise(0.0)
    found = inverse(found.withColumns({"re": F.col("re") * weight, "im": F.col("im") * weight}))
    return found.select(*KEYS, "i", F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("value"))


def envelope_spectrum(samples: DataFrame, sample_rate: float = 1.0) -> DataFrame:
    """The spectrum of the envelope less its mean."""
    return spectrum(centred(written(envelope(samples), "envelope")), sample_rate)
