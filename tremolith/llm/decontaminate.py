"""Benchmark decontamination: size-partitioned MinHash containment search.

A test item is contained in a document if the document has at least 75 percent
of the item's distinct five-word shingles, wherever they stand.  Items are
short, documents long, so similarity of the two sets says nothing; containment
is searched instead, over items partitioned by size.

The sketch of an item with n shingles is its bottom-m MinHash: the m smallest
values of a random hash of them.  A document that contains the item lacks at
most floor(n/4) of its shingles, so of any m it holds at least m - floor(n/4).
Each size partition (sizes from 2**p up to 2**(p+1)) is a table of its own, with
m = floor(n/4) plus the partition's number of wanted hits for each item, so no
contained item is ever missed, and larger items must hit more often before they
are verified.  A document skips the partitions whose smallest item asks for more
shingles than it has.  Candidates are verified by exact containment over the
whole shingle sets.

The item tables (sketches and sets, 8 bytes a shingle) are sent to the workers
while they take at most ``max_table_bytes``, which is checked; a larger
benchmark is joined with the documents' shingles through a shuffle instead, with
the same result.

Defined results: null and empty texts have no shingles: such items are in no
document and such documents contain none.  Items or documents with fewer than
five words have their whole sequence as one shingle, so an item of one to four
words is only found in documents that consist of it.  Repeated documents give a
row each and repeated items count as the items they are; empty tables give empty
results; other columns, whatever their names, are passed through by
:func:`decontaminate`, which judges each row by its text, and ignored by
:func:`contained_items`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import duck
from .storage import materialise, table
from .words import list_column, mix, row_slices, shingle_set, shingle_sets

#: Contained: at least NEEDED of every OF shingles.
NEEDED, OF = 3, 4
MAX_TABLE_BYTES = 64 << 20
_SETS = "item_id bigint, n int, shingles array<bigint>"
_FOUND = "doc_id bigint, item_id bigint, n_item int, n_common int"


def _sets(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array([len(s) for s in sets], pa.int32()), list_column(sets, pa.int64())],
                names=["item_id", "n", "shingles"],
            )

    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(build, _SETS).filter("n > 0")


def wanted_hits(n: np.ndarray) -> np.ndarray:
    """How many sketch values of an item of n shingles a document must hold: by
    size partition, 1 below 8, then one more for each doubling."""
    return np.maximum(1, np.floor(np.log2(np.maximum(n, 1))).astype(np.int64) - 1)


def sketch(shingles: np.ndarray) -> tuple[np.ndarray, int]:
    """The bottom-m MinHash of an item and the hits a container must have."""
    n = len(shingles)
    spare = n - -(-n * NEEDED // OF)
    hits = min(int(wanted_hits(np.array([n]))[0]), n - spare)
    order = np.argsort(mix(shingles ^ np.uint64(0xA5A5A5A55A5A5A5A)), kind="stable")
    return shingles[order[: spare + hits]], hits


class _Partition:
    """The sketches of the items of one size partition as one sorted array."""

    def __init__(self, items: np.ndarray, sets: list[np.ndarray]):
        sketches, hits = zip(*(sketch(sets[i]) for i in items), strict=True)
        self.items, self.hits = items, np.array(hits, np.int64)
        #: Shingles that a container of the smallest item must have.
        self.least = min(-(-len(sets[i]) * NEEDED // OF) for i in items)
        owner = np.repeat(np.arange(len(items)), [len(s) for s in sketches])
        keys = np.concatenate(sketches)
        order = np.argsort(keys, kind="stable")
        self.keys, self.owner = keys[order], owner[order]

    def candidates(self, shingles: np.ndarray) -> np.ndarray:
        if len(self.keys) <= 8 * len(shingles):
            at = np.searchsorted(shingles, self.keys)
            at[at == len(shingles)] = 0
            hit = self.owner[shingles[at] == self.keys]
        else:
            low = np.searchsorted(self.keys, shingles, "left")
            high = np.searchsorted(self.keys, shingles, "right")
            hit = [self.owner[a:b] for a, b in zip(low[high > low].tolist(), high[high > low].tolist(), strict=True)]
            hit = np.concatenate(hit) if hit else np.zeros(0, np.int64)
        held = np.bincount(hit, minlength=len(self.items))
        return self.items[held >= self.hits]


class ItemTables:
    """A table of sketches for each size partition, and the sets to verify by."""

    def __init__(self, ids: list[int], sets: list[np.ndarray]):
        self.ids, self.sets = np.array(ids, np.int64), sets
        sizes = np.array([len(s).bit_length() for s in sets], np.int64)
        self.partitions = [_Partition(np.flatnonzero(sizes == p), sets) for p in np.unique(sizes).tolist()]

    def contained(self, shingles: np.ndarray) -> list[tuple[int, int]]:
        """(item, shingles in common) of each item that a sorted set contains."""
        found = []
        for part in self.partitions:
            if len(shingles) < max(1, part.least):
                continue
            for item in part.candidates(shingles).tolist():
                mine = self.sets[item]
                at = np.searchsorted(shingles, mine)
                at[at == len(shingles)] = 0
                common = int((shingles[at] == mine).sum())
                if common * OF >= len(mine) * NEEDED:
                    found.append((item, common))
        return found


def contained_items(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", max_table_bytes: int = MAX_TABLE_BYTES
) -> DataFrame:
    """``doc_id, item_id, n_item, n_common`` of each item in each document."""
    sets, small = _items(items, item_col, item_text, max_table_bytes)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return _search(docs, sets) if small else _search_by_join(docs, sets).drop("th")


def _items(items: DataFrame, item_col: str, item_text: str, max_table_bytes: int) -> tuple[DataFrame, bool]:
    sets = materialise(_sets(items, item_col, item_text), "items")
    size = sets.agg(F.coalesce(F.sum(F.lit(40) + 16 * F.col("n")), F.lit(0))).first()[0]
    return sets, size <= max_table_bytes


def _shared(sets: DataFrame):
    rows = sets.toArrow()  # at most max_table_bytes
    arrays = [np.array(s, np.int64).view(np.uint64) for s in rows["shingles"].to_pylist()]
    return sets.sparkSession.sparkContext.broadcast((rows["item_id"].to_pylist(), arrays))


def _search(docs: DataFrame, sets: DataFrame) -> DataFrame:
    shared = _shared(sets)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = ItemTables(*shared.value)
        for batch in (part for whole in batches for part in row_slices(whole)):
            found = []
            for doc, shingles in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1)), strict=True):
                found += [(doc, int(tables.ids[i]), len(tables.sets[i]), common) for i, common in tables.contained(shingles)]
            columns = list(zip(*found, strict=True)) or [[], [], [], []]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "item_id", "n_item", "n_common"])

    return docs.mapInArrow(probe, _FOUND)


def _search_by_join(docs: DataFrame, sets: DataFrame) -> DataFrame:
    """The same search when the items do not fit a broadcast: documents' shingles
    meet the sketches by a join, and only candidates meet whole sets.  A document
    is told apart from others of its id by the digest of its text."""

    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [sketch(np.array(s, np.int64).view(np.uint64)) for s in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([h for _, h in out], pa.int32()), list_column([k for k, _ in out], pa.int64())],
                names=["item_id", "n", "hits", "keys"],
            )

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = shingle_sets(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), list_column(found, pa.int64())], names=["doc_id", "th", "shingles"])

    rows = docs.withColumn("th", _text_digest(F.col("text")))
    copies = rows.groupBy("doc_id", "th").count()
    rows = rows.dropDuplicates(["doc_id", "th"]).select("doc_id", "text", "th")
    shingles = rows.mapInArrow(explode, "doc_id bigint, th string, shingles array<bigint>").withColumn("s", F.explode("shingles")).drop("shingles")
    # Items alike share a row number, not an id.
    numbered = materialise(sets.withColumn("item", F.monotonically_increasing_id()), "numbered-items")
    keys = numbered.select("item", "n", "shingles").mapInArrow(sketches, "item_id bigint, n int, hits int, keys array<bigint>")
    keys = keys.select(F.col("item_id").alias("item"), "hits", F.explode("keys").alias("s"))
    near = shingles.join(keys, "s").groupBy("doc_id", "th", "item", "hits").count().filter(F.col("count") >= F.col("hits"))
    wanted = near.select("doc_id", "th", "item").join(numbered.select("item", "item_id", "n", F.explode("shingles").alias("s")), "item")
    common = wanted.join(shingles, (wanted.doc_id.eqNullSafe(shingles.doc_id)) & (wanted.th == shingles.th) & (wanted.s == shingles.s)).groupBy(
        wanted.doc_id, wanted.th, "item", "item_id", "n"
    )
    found = common.agg(F.count(F.lit(1)).cast("int").alias("n_common")).filter(F.col("n_common") * OF >= F.col("n") * NEEDED)
    copies = copies.withColumnsRenamed({"doc_id": "d", "th": "t"})
    every = found.join(copies, found.doc_id.eqNullSafe(copies.d) & (found.th == copies.t)).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("count"))))
    return every.select("doc_id", "item_id", F.col("n").alias("n_item"), "n_common", "th")


def decontaminate(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", max_table_bytes: int = MAX_TABLE_BYTES
) -> DataFrame:
    """The documents whose text contains no item, with all their columns."""
    sets, small = _items(items, item_col, item_text, max_table_bytes)
    if small:
        shared = _shared(sets)

        @F.pandas_udf("boolean")
        def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            tables = ItemTables(*shared.value)
            for texts in batches:
                yield pd.Series([not tables.contained(shingle_set(t)) for t in texts], dtype=bool)

        return docs.filter(clean(F.col(text_col)))
    # The same text contains the same items, whatever the row.
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _text_digest(F.col(text_col)).alias("th"))
    found = _search_by_join(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), sets)
    return packed.join(found.select("th").distinct(), "th", "left_anti").select("row.*")


def _text_digest(text) -> F.Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumn("containment", F.col("n_common") / F.col("n_item"))


ORACLE = f"""
WITH {duck.shingles("d", "documents", "doc_id")}, {duck.shingles("b", "benchmark", "item_id")},
n AS (SELECT item_id, count(*) AS n_item FROM b GROUP BY item_id),
c AS (SELECT doc_id, item_id, count(*) AS n_common FROM d JOIN b USING (s) GROUP BY ALL)
SELECT doc_id, item_id, n_item::INT AS n_item, n_common::INT AS n_common, n_common / n_item AS containment
FROM c JOIN n USING (item_id) WHERE 4 * n_common >= 3 * n_item
"""
