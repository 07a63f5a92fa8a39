"""Exact deduplication by distributed MSD radix partitioning.

Texts are split on successive pieces of their bytes, first piece first, each
kind of end apart.  After a round a text is alone with its bytes so far (done),
or its group has ended (all its bytes read: equal texts, done), or it goes on to
the next, wider piece.  Rows compare by their bytes alone; no digest decides
equality.

The first round moves no texts: it counts (first bytes, length) and keeps of the
groups over one row a bitmap of fixed size over a hash of that pair.  A row whose
bit is unset is alone and needs no shuffle at all; only the others' texts move.
The bitmap saves work and decides nothing: a false hit is settled by the bytes.
Groups are counted with map-side partial aggregation, so one that holds a third
of all rows is a single small row, and the rows meet that row in a join that
adaptive execution may split; no task ever gathers a group.

Defined results: a null text counts as empty; empty texts are one group; of
equal texts the row with the largest doc_id stays (null is the smallest); rows
that repeat both text and doc_id all count and one of them stays; an empty table
gives an empty result; further columns are carried along untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import materialise, release, table

#: Bytes that the first round compares, those of the second, and their growth.
FIRST_BYTES, NEXT_BYTES, GROWTH = 64, 4096, 16
#: log2 of the bits of the bitmap (8 MB), and of those in one row of it.
BITS, ROW_BITS = 26, 15


def _bit(rows: DataFrame, first_bytes: int) -> DataFrame:
    """Adds ``head, size`` and, from their hash, the bitmap's ``word`` and ``bit``."""
    text = F.col("text").cast("binary")
    rows = rows.withColumn("head", F.substring(text, 1, first_bytes)).withColumn("size", F.octet_length("text"))
    h = F.shiftrightunsigned(F.xxhash64("head", "size"), 64 - BITS)
    return rows.withColumn("word", F.shiftright(h, ROW_BITS)).withColumn("bit", h.bitwiseAND(F.lit((1 << ROW_BITS) - 1)))


def radix_groups(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", first_bytes: int = FIRST_BYTES, next_bytes: int = NEXT_BYTES, carry: list[str] | None = None
) -> DataFrame:
    """Every row with its group: ``id, text_sha256, row`` (the columns ``carry`` of
    the input, all if None) and, of its group of equal texts, ``keep_id``,
    ``group_size`` and whether it is ``kept``."""
    carry = df.columns if carry is None else carry
    rows = df.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in carry]).alias("row"),
    )
    marked = _bit(rows, first_bytes)
    shared = marked.groupBy("head", "size").agg(F.count(F.lit(1)).alias("n"), F.first("word").alias("word"), F.first("bit").alias("bit")).filter("n > 1")
    bitmap = materialise(shared.groupBy(F.col("word").alias("w")).agg(F.bitmap_construct_agg("bit").alias("bits")), "radix-bitmap")
    # At most 2 ** (BITS - ROW_BITS) rows of 4 KB, whatever the input.
    met = marked.join(F.broadcast(bitmap), F.col("word") == F.col("w"), "left").withColumn(
        "near", F.expr("coalesce(getbit(cast(conv(hex(substring(bits, cast(bit div 8 as int) + 1, 1)), 16, 10) as int), cast(bit % 8 as int)) = 1, false)")
    )
    digest = F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256")
    alone = met.filter("NOT near").select("id", digest, "row", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    active = materialise(met.filter("near").select("id", digest, "row", "text", F.lit(0).cast("long").alias("gid")), "radix-rows")
    done, width = [alone], next_bytes
    while not active.isEmpty():
        split = _round(active, width)
        done += [_finished(split)]
        rest = split.filter("next IS NOT NULL AND NOT over")
        active = rest.select("id", "text_sha256", "row", "text", F.col("next").alias("gid"))
        width *= GROWTH
    out = done[0]
    for part in done[1:]:
        out = out.unionAll(part)
    return out


def _round(active: DataFrame, width: int) -> DataFrame:
    """One split: rows with ``over`` (ended within the piece), their group's
    ``group_size, keep_id`` and id ``next`` (null if alone); ``text`` is what is left."""
    text = F.col("text").cast("binary") if dict(active.dtypes)["text"] == "string" else F.col("text")
    active = active.withColumn("text", text)
    keyed = active.withColumn("piece", F.substring("text", 1, width)).withColumn("over", F.octet_length("text") <= width)
    keyed = keyed.withColumn("text", F.expr(f"CASE WHEN over THEN CAST('' AS BINARY) ELSE substring(text, {width + 1}) END"))
    groups = keyed.groupBy("gid", "piece", "over").agg(F.count(F.lit(1)).alias("group_size"), F.max("id").alias("keep_id")).filter("group_size > 1")
    groups = groups.withColumnsRenamed({"gid": "g", "piece": "p", "over": "o"}).withColumn("next", F.monotonically_increasing_id())
    groups = materialise(groups, "radix-groups")
    same = (F.col("gid") == F.col("g")) & (F.col("piece") == F.col("p")) & (F.col("over") == F.col("o"))
    split = keyed.join(groups, same, "left").select("id", "text_sha256", "row", "text", "over", "group_size", "keep_id", "next")
    split = materialise(split, "radix-rows")
    release(groups)
    return split


def _finished(split: DataFrame) -> DataFrame:
    alone = split.filter("next IS NULL").select(
        "id", "text_sha256", "row", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept")
    )
    # Equal texts; only rows that repeat a doc_id share a partition here.
    same = Window.partitionBy("next", "id").orderBy(F.lit(1))
    equal = split.filter("next IS NOT NULL AND over").withColumn("turn", F.row_number().over(same))
    kept = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("turn") == 1)
    return alone.unionAll(equal.select("id", "text_sha256", "row", "keep_id", "group_size", kept.alias("kept")))


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with the columns of ``df``."""
    return radix_groups(df, id_col, text_col).filter("kept").select(*[F.col("row").getField(c).alias(c) for c in df.columns])


def dedup_report(df: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    groups = radix_groups(df, carry=[])
    return groups.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_report(table(spark, sf_dir, "documents"))


ORACLE = """
SELECT doc_id,
       max(doc_id) OVER g AS keep_id,
       count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
