"""Lines that many documents share, dropped from all of them.

A line's key is the line without ASCII white space at its ends and with A-Z in
lower case, as a 128-bit xxh3 digest.  One pass over the texts sends each
document's distinct keys to a partial aggregation, so a line that a third of all
documents holds is one row a task, and no text is shuffled.  The keys that at least
``indexed_from`` documents have (as many as a line needs to be dropped, if not
said) go into a sharded minimal perfect hash, which indexes a fingerprint array
and a count array; see :mod:`perfect_hash`.  A second pass over the texts probes
these arrays, one batch of lines at a time: lines are joined with nothing and
documents are not shuffled.

All distinct lines of a corpus would not fit beside an executor at 100 TB, and a line
of few documents decides nothing; so only repeated ones are indexed, at about 13
bytes each, in files mapped into memory.  A line that is not in the index is told
by its fingerprint, the digest's other 64 bits; its place depends on all 128.

Defined results: null and empty texts are one empty line; keys under ``least_chars``
code points never go; a document counts once for a key, however often it has it,
and each of rows that repeat an id counts as a document; a text that loses all
its lines is empty; an empty table gives an empty result; further columns are
kept, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .perfect_hash import SHARD_KEYS, SHARD_SCHEMA, Index, lay_out, shard_rows
from .storage import materialise, release, table
from .words import row_slices

#: Documents that a line must be in, and code points that its key must have.
MIN_DOCUMENTS, LEAST_CHARS = 10, 1


def line_key(line: bytes) -> bytes:
    return line.strip(b"\x20\x09\x0a\x0b\x0c\x0d").lower()


def _lines(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split(b"\n")


def digests(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The two 64-bit halves of each key's digest."""
    raw = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), ">u8").astype(np.uint64)
    return raw[0::2], raw[1::2]


def _long_enough(keys: list[bytes], least_chars: int) -> np.ndarray:
    chars = [len(k) if k.isascii() else len(k.decode("utf-8", "surrogatepass")) for k in keys]
    return np.array(chars, np.int64) >= least_chars


def line_counts(docs: DataFrame, text_col: str = "text", least_chars: int = LEAST_CHARS) -> DataFrame:
    """``lead, print, documents``: each distinct key's digest and the documents that
    have it."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in row_slices(whole)):
            own: list[bytes] = []
            for text in batch.column(0).to_pylist():
                own += {line_key(x) for x in _lines(text)}
            keep = np.flatnonzero(_long_enough(own, least_chars)).tolist()
            lead, prints = digests([own[i] for i in keep])
            yield pa.RecordBatch.from_arrays([pa.array(lead.view(np.int64)), pa.array(prints.view(np.int64))], names=["lead", "print"])

    found = docs.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(keys, "lead bigint, print bigint")
    return found.groupBy("lead", "print").agg(F.count(F.lit(1)).alias("documents"))


class LineIndex:
    """Arrays of the keys that at least ``indexed_from`` documents have, written to the
    shared folder and fetched by the executors when they first ask for them."""

    def __init__(self, docs: DataFrame, text_col: str = "text", indexed_from: int = MIN_DOCUMENTS, least_chars: int = LEAST_CHARS, shard_keys: int = SHARD_KEYS):
        spark = docs.sparkSession
        self.least_chars, self.indexed_from = least_chars, indexed_from
        common = materialise(line_counts(docs, text_col, least_chars).filter(F.col("documents") >= indexed_from), "lines")
        self.keys = common.count()
        self.shards = max(1, math.ceil(self.keys / shard_keys))
        # shard_of, said in SQL
        shard = F.shiftright(F.shiftrightunsigned("lead", 32) * self.shards, 32).cast("int").alias("shard")
        rows = common.select(shard, "lead", "print", "documents")
        # A shard is bounded: distinct keys, evenly hashed.
        built = rows.repartition("shard").mapInArrow(shard_rows, SHARD_SCHEMA)
        self.table = materialise(built, "line-index")
        release(common)
        files = self.table.inputFiles()  # one at most for each partition of shards
        self.names = [f.rsplit("/", 1)[1] for f in files]
        for f in files:
            spark.sparkContext.addFile(f)


def drop_lines(docs: DataFrame, index: LineIndex, text_col: str = "text", min_documents: int = MIN_DOCUMENTS, carry: list[str] | None = None) -> DataFrame:
    """``row`` (the columns ``carry`` of the input, all if None) and ``kept_text,
    n_lines, n_dropped``: each text without the lines of at least ``min_documents``
    documents."""
    if min_documents < index.indexed_from:
        raise ValueError(f"the index has no lines of under {index.indexed_from} documents")
    names, shards, least_chars = index.names, index.shards, index.least_chars

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Index(lay_out([SparkFiles.get(n) for n in names]), shards)
        for batch in (part for whole in batches for part in row_slices(whole)):
            lines = [_lines(t) for t in batch.column(0).to_pylist()]
            ends = np.concatenate(([0], np.cumsum([len(x) for x in lines])))
            keys = [line_key(x) for own in lines for x in own]
            drop = (found.find(*digests(keys)) >= min_documents) & _long_enough(keys, least_chars)
            texts, dropped = [], []
            for own, a, b in zip(lines, ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                gone = drop[a:b]
                texts.append(b"\n".join(x for x, d in zip(own, gone.tolist(), strict=True) if not d).decode("utf-8", "surrogatepass"))
                dropped.append(int(gone.sum()))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(texts, pa.string()), pa.array(np.diff(ends)), pa.array(dropped, pa.int64())], names=["row", "kept_text", "n_lines", "n_dropped"])

    row = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in (docs.columns if carry is None else carry)]).alias("row")
    given = docs.select(F.col(f"`{text_col}`").alias("text"), row)
    out = StructType([given.schema["row"], StructField("kept_text", StringType()), StructField("n_lines", LongType()), StructField("n_dropped", LongType())])
    return given.mapInArrow(probe, out)


def dedup_lines(docs: DataFrame, text_col: str = "text", min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """The documents with all their columns, the text without its common lines."""
    kept = drop_lines(docs, LineIndex(docs, text_col, min_documents), text_col, min_documents)
    return kept.select(*[F.col("kept_text").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns])


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = drop_lines(docs, LineIndex(docs), carry=["doc_id"])
    return kept.select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
ORACLE = f"""
WITH cut AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
each AS (
  SELECT doc_id, i, lines[i] AS line,
         translate(trim(lines[i], {_BLANK}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM cut)),
common AS (SELECT k FROM each WHERE length(k) >= {LEAST_CHARS} GROUP BY k HAVING count(DISTINCT doc_id) >= {MIN_DOCUMENTS})
SELECT doc_id, count(*) AS n_lines, count(c.k) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE c.k IS NULL), '')) AS kept_sha256
FROM each LEFT JOIN common c USING (k) GROUP BY doc_id
"""
