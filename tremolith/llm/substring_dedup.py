"""Substring deduplication by content-defined chunking.

A gear rolling hash (h = 2h + G[byte], of which bits are tested that depend on
the last 16 bytes) cuts each text where its content says so, every 16 bytes on
average; after an insertion the cuts fall into step again within a few bytes.
The unit that is compared is a run of three chunks, about 48 bytes, known by its
128-bit xxh3 digest: small enough to follow a passage to near its ends, long enough
not to recur by chance.  Overlapping and adjoining repeated units merge; a
repeated passage of at least ``MIN_WORDS`` words is reported in every document
that has it; a word counts once for every LONG_WORD bytes of it, so that scripts
without spaces have words too.  The document with the smallest (doc_id, text digest) keeps it.

Units end up to a chunk short of a passage's true ends.  Where that decides (the
words that units cover are too few, those up to the next cuts are enough), the
bytes around the run are compared with those around the same unit in its first
holder, the first holder's with its last, and the run is taken to its true ends, whole
words only.

Pass one counts in how many rows each half digest occurs and keeps the repeated
ones as a bitmap of fixed size (8 MB, the only thing that goes by the driver); pass two cuts the texts again and ships only units whose bit is set.
The bitmap saves shuffling and decides nothing.  The shipped units are written by
TURNS ranges of their digests and worked on one range after the other, each one's
shuffle files dropped before the next, so that disk holds a share of them at once.
Units are counted with partial aggregation and met by a join that adaptive execution may
split, so a passage in a third of all documents burdens no single task.

Defined results: null and empty texts have no units; rows that repeat both
doc_id and text are one document; a passage repeated only within one document
is left alone; an empty table gives an empty result; further columns are ignored
by :func:`repeats` and kept, whatever their names, by :func:`remove_repeats`.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bitmaps import bitmap_of, hits, marked, unpacked
from .storage import materialise, materialise_parts, release, table, tidy
from .words import list_column, mix, row_slices

MIN_WORDS, LONG_WORD = 25, 30
UNIT = 3
#: Ranges of digests, a power of two, and units of a turn while that takes fewer turns.
TURNS, TURN_ROWS = 8, 1_000_000
#: A cut where CUT_BITS bits of the hash, from SHIFT up, are zero; chunks of at
#: least LEAST bytes, and cut anyway after MOST.
CUT_BITS, SHIFT, LEAST, MOST = 4, 12, 4, 256
#: Bytes that a cut depends on, and some.
_TESTED = 24
_GEAR = (mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)


def cuts(codes: np.ndarray) -> np.ndarray:
    """Where chunks of a text start, and its length at the end."""
    n = len(codes)
    h = _GEAR[codes]
    for w in (1, 2, 4, 8):  # the hash of 2w bytes out of two of w
        h[w:] = h[w:] + (h[:-w] << np.uint32(w))
    ok = (h >> np.uint32(SHIFT)) & np.uint32((1 << CUT_BITS) - 1) == 0
    ok[1:] &= ~ok[:-1]  # of touching cuts the first
    ok[:-1] &= codes[1:] & 0xC0 != 0x80  # never inside a character
    at = np.flatnonzero(ok) + 1
    at = at[(at > LEAST) & (at <= n - LEAST)]
    if len(at) > 1:
        at = at[np.concatenate(([True], np.diff(at) >= LEAST))]
    at = np.concatenate(([0], at, [n]))
    gaps = np.diff(at)
    if gaps.max() > MOST:
        more = [np.arange(a + MOST, b, MOST) for a, b in zip(at[:-1][gaps > MOST].tolist(), at[1:][gaps > MOST].tolist(), strict=True)]
        more = np.concatenate(more)
        at = np.sort(np.concatenate((at, more[codes[more] & 0xC0 != 0x80])))
    return at


def _spaces(codes: np.ndarray) -> np.ndarray:
    return (codes == 32) | ((codes >= 9) & (codes <= 13))


def word_starts(codes: np.ndarray) -> np.ndarray:
    """Where words begin, and every LONG_WORD bytes on in them."""
    space, place = _spaces(codes), np.arange(len(codes))
    since = place - np.maximum.accumulate(np.where(space, place, -1))  # from 1 on in a word
    return ~space & (since % LONG_WORD == 1)


def _digests(raw: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    found = b"".join([xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip(start.tolist(), end.tolist(), strict=True)])
    return np.frombuffer(found, ">u8").astype(np.uint64).reshape(-1, 2).T


def unit_keys(text: str | None) -> np.ndarray:
    """The distinct low halves of the digests of a text's units."""
    raw = text.encode("utf-8", "surrogatepass") if text else b""
    if not raw:
        return np.zeros(0, np.uint64)
    at = cuts(np.frombuffer(raw, np.uint8))
    return np.unique(_digests(raw, at[: max(1, len(at) - UNIT)], at[min(UNIT, len(at) - 1) :])[1])


def units(text: str | None) -> tuple[np.ndarray, ...]:
    """For each unit of a text the halves of its digest, the bytes it starts and
    ends at, the words before either, and the words before the cut ahead of it and
    before the one behind it."""
    raw = text.encode("utf-8", "surrogatepass") if text else b""
    if not raw:
        return tuple(np.zeros(0, k) for k in (np.uint64, np.uint64, *[np.int64] * 6))
    codes = np.frombuffer(raw, np.uint8)
    at = cuts(codes)
    start, end = at[: max(1, len(at) - UNIT)], at[min(UNIT, len(at) - 1) :]
    high, low = _digests(raw, start, end)
    seen = np.concatenate(([0], np.cumsum(word_starts(codes))))
    # The first cuts of a passage may differ: they test bytes ahead of it.
    ahead, behind = np.maximum(at[np.maximum(np.arange(len(start)) - 1, 0)] - _TESTED, 0), at[np.minimum(np.arange(len(end)) + min(UNIT, len(at) - 1) + 1, len(at) - 1)]
    return low, high, start, end, seen[start], seen[end], seen[ahead], seen[behind]


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in row_slices(whole)):
        found = [unit_keys(t) for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([list_column(found, pa.int64())], names=["keys"])


def _bitmap(docs: DataFrame) -> bytes:
    """Bits of the digests that more than one row has."""
    keys = docs.select("text").mapInArrow(_keys, "keys array<bigint>").select(F.explode("keys").alias("key"))
    bits = bitmap_of(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    tidy(docs.sparkSession)
    return bits


_UNITS = "id bigint, th bigint, key bigint, check bigint, start int, end int, before int, after int, ahead int, behind int"


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``id, th, start, end, n_words, first_id, removed``: one row per stretch of
    a passage that other documents have too.  start and end are byte offsets in
    the UTF-8 text, n_words counts the whole passage, th is the text's digest."""
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(_bitmap(docs))

    def ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = unpacked(shared.value)
        for batch in (part for whole in batches for part in row_slices(whole)):
            columns: list[list[np.ndarray]] = [[] for _ in range(9)]
            ids, counts = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = units(text)
                keep = hits(bits, found[0])
                n = int(keep.sum())
                if not n:
                    continue
                ids.append(doc)
                counts.append(n)
                th = xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))
                columns[0].append(np.full(n, th, np.uint64))
                for c, values in zip(columns[1:], found, strict=True):
                    c.append(values[keep])
            if ids:
                at = pa.array(np.repeat(np.arange(len(ids)), counts))
                out = [pa.array(ids, pa.int64()).take(at)]
                out += [pa.array(np.concatenate(c).view(np.int64)) for c in columns[:3]]
                out += [pa.array(np.concatenate(c).astype(np.int32)) for c in columns[3:]]
                yield pa.RecordBatch.from_arrays(out, names=["id", "th", "key", "check", "start", "end", "before", "after", "ahead", "behind"])

    turn = F.col("key").bitwiseAND(F.lit(TURNS - 1)).cast("int")
    parts = materialise_parts(docs.mapInArrow(ship, _UNITS).withColumn("turn", turn), "units", "turn", TURN_ROWS)
    shared.destroy()  # written: no task asks for it again
    again = not docs.groupBy("id").count().filter("count > 1").isEmpty()
    tables = []
    for part in parts:
        tables.append(materialise(_met(part.distinct() if again else part), "met"))
        release(part)
        tidy(docs.sparkSession)
    runs = _runs(reduce(DataFrame.unionAll, tables), min_words)
    runs = materialise(runs, "runs")
    for part in tables:
        release(part)
    tidy(docs.sparkSession)
    done = runs.filter(F.col("n_words") >= min_words)
    out = ["id", "th", "start", "end", "n_words", "first_id", "removed"]
    short = runs.filter(F.col("n_words") < min_words)
    return done.select(out) if short.isEmpty() else done.select(out).unionAll(_extended(docs, short, again).filter(F.col("n_words") >= min_words).select(out))


def _met(found: DataFrame) -> DataFrame:
    """The units that several documents have; ``own``: in their first holder; with
    another holder's place, the first one's or, in the first, the last one's."""
    place = F.struct("id", "th", "start")
    holders = found.groupBy("key", "check").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("NOT (first.id <=> last.id AND first.th = last.th)")
    met = found.join(holders, ["key", "check"]).withColumn("own", F.struct("first.id", "first.th").eqNullSafe(F.struct("id", "th")))
    other = F.when(F.col("own"), F.col("last")).otherwise(F.col("first"))
    names = ["id", "th", "start", "end", "before", "after", "ahead", "behind", "own"]
    return met.select(*names, other["id"].alias("other_id"), other["th"].alias("other_th"), other["start"].alias("other_start"))


def _runs(met: DataFrame, min_words: int) -> DataFrame:
    """Units that touch as runs, in parts by whether the document is the first holder;
    those that may reach ``min_words`` between the cuts around them."""
    along = Window.partitionBy("id", "th").orderBy("start", "end")
    apart = F.coalesce(F.col("start") > F.lag("end").over(along), F.lit(True))
    turned = apart | F.coalesce(F.col("own") != F.lag("own").over(along), F.lit(True))
    met = met.withColumn("apart", apart.cast("int")).withColumn("turned", turned.cast("int"))
    met = met.withColumn("run", F.sum("apart").over(along)).withColumn("part", F.sum("turned").over(along))
    other = lambda at: [F.col("other_id").alias("id"), F.col("other_th").alias("th"), at.alias("at")]
    runs = met.groupBy("id", "th", "run", "part").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.min(F.when(F.col("own"), F.col("id")).otherwise(F.col("other_id"))).alias("first_id"), (~F.first("own")).alias("removed"),
        F.min(F.struct("start", *other(F.col("other_start")))).alias("left"), F.max(F.struct("end", *other(F.col("other_start") + F.col("end") - F.col("start")))).alias("right"),
        F.min("before").alias("before"), F.max("after").alias("after"), F.min("ahead").alias("ahead"), F.max("behind").alias("behind"),
    )
    run = Window.partitionBy("id", "th", "run")
    runs = runs.withColumn("n_words", F.max("after").over(run) - F.min("before").over(run)).withColumn("most", F.max("behind").over(run) - F.min("ahead").over(run))
    return runs.filter(F.col("most") >= min_words).drop("before", "after", "ahead", "behind", "most")


#: Bytes around a run that may belong to its passage: a chunk is no longer.
_AROUND = MOST + 4


def _texts_digest(text: pd.Series) -> pd.Series:
    h = [xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) if t else 0 for t in text]
    return pd.Series(np.array(h, np.uint64).view(np.int64))


def _contexts(docs: DataFrame, wanted: DataFrame, again: bool) -> DataFrame:
    """``id, th, at, around`` of places (id, th, at): the bytes ahead and behind.  Texts
    stay out of Python unless ids occur ``again``, with which a digest tells them apart."""
    places = wanted.distinct().groupBy("id", "th").agg(F.collect_list("at").alias("places"))  # a text's own runs
    near = marked(docs, F.xxhash64("id"), places.select(F.xxhash64("id").alias("key"))).filter("near AND text IS NOT NULL")
    same = F.col("id").eqNullSafe(F.col("i"))
    if again:
        texts = near.select(F.col("id").alias("i"), F.pandas_udf(_texts_digest, "bigint")("text").alias("t"), "text")
        met = places.join(texts, same & (F.col("th") == F.col("t"))).dropDuplicates(["id", "th"])
    else:
        met = places.join(near.select(F.col("id").alias("i"), "text"), same)
    part = lambda a, n: F.substring(F.col("text").cast("binary"), a, n)
    around = lambda p: F.struct(p.alias("at"), part(F.greatest(p - _AROUND, F.lit(0)) + 1, F.least(p, F.lit(_AROUND))).alias("ahead"), part(p + 1, F.lit(_AROUND)).alias("behind"))
    return met.select("id", "th", F.explode(F.transform("places", around)).alias("x")).select("id", "th", "x.at", F.struct("x.ahead", "x.behind").alias("around"))


def _common(a: bytes, b: bytes, forward: bool, glued: bool = False) -> tuple[int, int]:
    """The bytes next to a place that a text shares with another, whole words only,
    and the words that begin in them.  ``a`` and ``b`` lie behind the place, or ahead
    of it; ``glued``: the byte ahead belongs to a word, which has been counted and goes
    if it isn't shared to its end."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if not forward:
        x, y = x[::-1], y[::-1]
    n = min(len(x), len(y))
    other = np.flatnonzero(x[:n] != y[:n])
    n = int(other[0]) if len(other) else n
    ends = lambda z: n == len(z) or bool(_spaces(z[n : n + 1])[0])
    if not (ends(x) and ends(y)):
        gaps = np.flatnonzero(_spaces(x[:n]))
        if not len(gaps):
            return 0, -1 if forward and glued else 0
        n = int(gaps[-1]) + 1
    part = x[:n] if forward else x[:n][::-1]
    if forward and glued:
        return n, int(word_starts(np.concatenate(([65], part)).astype(np.uint8)).sum()) - 1
    return n, int(word_starts(part).sum())


def _extended(docs: DataFrame, short: DataFrame, again: bool) -> DataFrame:
    """Runs taken to their passage's true ends, with its words."""
    edge = short.groupBy("id", "th", "run").agg(F.min("left").alias("left"), F.max("right").alias("right"))
    edge = materialise(edge, "edges")
    sides = {"left": "start", "right": "end"}
    asked = None
    for side, at in sides.items():
        for part in (edge.select("id", "th", F.col(f"{side}.{at}").alias("at")), edge.select(F.col(f"{side}.id").alias("id"), F.col(f"{side}.th").alias("th"), F.col(f"{side}.at").alias("at"))):
            asked = part if asked is None else asked.unionAll(part)
    around = materialise(_contexts(docs, asked, again), "around")

    @F.pandas_udf("struct<bytes: int, words: int>")
    def common(mine: pd.DataFrame, theirs: pd.DataFrame, forward: pd.Series) -> pd.DataFrame:
        rows = []
        for before, behind, b0, b1, f in zip(mine["ahead"], mine["behind"], theirs["ahead"], theirs["behind"], forward, strict=True):
            glued = bool(before) and not _spaces(np.frombuffer(before[-1:], np.uint8))[0]
            rows.append(_common(behind, b1, True, glued) if f else _common(before, b0, False))
        return pd.DataFrame(rows, columns=["bytes", "words"]).astype("int32")

    for side, at in sides.items():
        forward = side == "right"
        for name, i, t, p in (("mine", "id", "th", f"{side}.{at}"), ("theirs", f"{side}.id", f"{side}.th", f"{side}.at")):
            other = around.select(F.col("id").alias("_i"), F.col("th").alias("_t"), F.col("at").alias("_p"), F.col("around").alias(name))
            edge = edge.join(other, F.col(i).eqNullSafe(F.col("_i")) & (F.col(t) == F.col("_t")) & (F.col(p) == F.col("_p"))).drop("_i", "_t", "_p")
        edge = edge.withColumn(f"{side}_more", common("mine", "theirs", F.lit(forward))).drop("mine", "theirs")
    edge = edge.select(
        "id", "th", "run", (F.col("left.start") - F.col("left_more.bytes")).alias("true_start"), (F.col("right.end") + F.col("right_more.bytes")).alias("true_end"),
        F.col("left.start").alias("run_start"), F.col("right.end").alias("run_end"), (F.col("left_more.words") + F.col("right_more.words")).alias("more"),
    )
    edge = edge.select(*[F.col(c).alias(f"_{c}") for c in edge.columns])
    met = short.join(edge, F.col("id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")) & (F.col("run") == F.col("_run")))
    return met.withColumns(
        {
            "start": F.when(F.col("start") == F.col("_run_start"), F.col("_true_start")).otherwise(F.col("start")).cast("int"),
            "end": F.when(F.col("end") == F.col("_run_end"), F.col("_true_end")).otherwise(F.col("end")).cast("int"), "n_words": F.col("n_words") + F.col("_more"),
        }
    )


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the repeated stretches cut out of all texts but their first
    holder's."""
    found = repeats(docs, id_col, text_col, min_words).filter("removed").groupBy("id", "th").agg(F.collect_list(F.struct("start", "end")).alias("spans"))

    digest = F.pandas_udf(_texts_digest, "bigint")

    @F.pandas_udf("string")
    def cut(text: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([_cut(t, s) for t, s in zip(text, spans, strict=True)])

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).cast("long").alias("i"), digest(F.col(text_col)).alias("t"), F.col(text_col).alias("text"))
    met = rows.join(found, F.col("i").eqNullSafe(F.col("id")) & (F.col("t") == F.col("th")), "left")
    changed = met.filter("spans IS NOT NULL").withColumn("text", cut("text", "spans"))
    met = met.filter("spans IS NULL").unionByName(changed)
    return met.select(*[F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns])


def _cut(text: str, spans) -> str:
    raw, keep, at = text.encode("utf-8", "surrogatepass"), [], 0
    for start, end in sorted((s["start"], s["end"]) for s in spans):
        keep.append(raw[at : max(at, start)])
        at = max(at, end)
    return b"".join([*keep, raw[at:]]).decode("utf-8", "surrogatepass")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), F.col("start").alias("start_byte"), F.col("end").alias("end_byte"), "n_words", F.col("first_id").alias("first_doc_id"), "removed"
    )
