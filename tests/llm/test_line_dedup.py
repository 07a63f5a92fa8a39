"""Line dedup and its perfect hash against plain versions."""

import collections
import random

import numpy as np
import pyarrow as pa
import pytest

from tremolith.llm import line_dedup, perfect_hash


def plain_version(texts, least, least_chars=1):
    """(n_lines, n_dropped, kept) of each text."""
    key = lambda line: line.strip(" \t\n\r\x0b\x0c").translate({c: c + 32 for c in range(65, 91)})
    split = [(t or "").split("\n") for t in texts]
    seen = collections.Counter(k for lines in split for k in {key(x) for x in lines})
    drop = lambda x: len(key(x)) >= least_chars and seen[key(x)] >= least
    return [(len(x), sum(map(drop, x)), "\n".join(y for y in x if not drop(y))) for x in split]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    common = ["Read  more", "\tread  MORE ", "é é", "É É", "x", " x ", "漢字", "", "  ", "ÀB", "Àb"] + [f"line {i}" for i in range(40)]
    texts = ["\n".join(rng.choice(common) if rng.random() < 0.6 else f"own {rng.random()}" for _ in range(rng.randrange(9))) for _ in range(120)]
    texts += [None, "", "\n", "x", "x\r\nx\r", "same\nsame\nsame", "\n".join(f"l{i}" for i in range(5000))]
    return [*enumerate(texts), (None, "x"), (3, "twice"), (3, "twice")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 7, "print") for i, t in rows], "doc_id long, text string, n_lines int, lead string")


@pytest.mark.parametrize(("least", "shard_keys", "least_chars"), [(10, 1 << 16, 1), (2, 8, 1), (3, 5, 2), (10**6, 4, 1), (1, 64, 0)])
def test_equals_the_plain_version(spark, rows, least, shard_keys, least_chars):
    docs = frame(spark, rows)
    index = line_dedup.LineIndex(docs, indexed_from=least, least_chars=least_chars, shard_keys=shard_keys)
    got = line_dedup.drop_lines(docs, index, min_documents=least).collect()
    want = plain_version([t for _, t in rows], least, least_chars)
    order = lambda x: tuple((v is None, v) for v in x)
    assert sorted(((r.row.doc_id, r.row.text, r.n_lines, r.n_dropped, r.kept_text) for r in got), key=order) == sorted(((i, t, *w) for (i, t), w in zip(rows, want, strict=True)), key=order)


def test_whole_rows(spark, rows):
    docs = frame(spark, rows)
    got = line_dedup.dedup_lines(docs)
    assert got.schema == docs.schema
    assert sorted(r.text for r in got.collect()) == sorted(w[2] for w in plain_version([t for _, t in rows], 10))
    with pytest.raises(ValueError):
        line_dedup.drop_lines(docs, line_dedup.LineIndex(docs), min_documents=2)


def test_empty_table(spark):
    assert line_dedup.dedup_lines(frame(spark, [])).count() == 0
    assert line_dedup.dedup_lines(frame(spark, [(1, None)])).collect()[0].text == ""


@pytest.mark.parametrize("n", [1, 2, 63, 3000])
def test_places_are_minimal_and_perfect(n):
    rng = np.random.default_rng(n)
    lead, prints = rng.integers(0, 2**64, n, np.uint64), rng.integers(0, 2**64, n, np.uint64)
    lead[: n // 2] = lead[0]  # keys with equal halves are still apart
    sizes, bits, place = perfect_hash.build(lead, prints)
    assert sorted(place.tolist()) == list(range(n))
    assert sum(sizes) == 64 * len(bits) < 8 * n + 64 * len(sizes)


def test_index_answers_counts_and_knows_strangers(tmp_path):
    rng = np.random.default_rng(3)
    n, shards = 5000, 7
    lead, prints, counts = rng.integers(0, 2**64, n, np.uint64), rng.integers(0, 2**64, n, np.uint64), rng.integers(1, 9, n)
    counts[:3] = 70_000, 300, 2**40  # shards with wider counts
    lead[:20] >>= np.uint64(40)  # some low ones: shard 0
    shard = perfect_hash.shard_of(lead, shards)
    import pyarrow.parquet as pq

    whole = pa.RecordBatch.from_arrays([pa.array(shard), pa.array(lead.view(np.int64)), pa.array(prints.view(np.int64)), pa.array(counts)], names=["shard", "lead", "print", "documents"])
    (tmp_path / "index").mkdir()
    for k, batch in enumerate(perfect_hash.shard_rows(iter([whole]))):
        if batch.column(0)[0].as_py() != 4:  # a shard is missing: its keys are strangers
            pq.write_table(pa.Table.from_batches([batch]), tmp_path / "index" / f"part-{k}.parquet")
    parts = [str(p) for p in (tmp_path / "index").iterdir()]
    folder = perfect_hash.lay_out(parts)
    assert folder == perfect_hash.lay_out(parts[::-1])
    index = perfect_hash.Index(folder, shards)
    assert np.array_equal(index.find(lead, prints), np.where(shard == 4, 0, counts))
    assert not index.find(lead, prints ^ np.uint64(1)).any()
    assert not index.find(rng.integers(0, 2**64, n, np.uint64), rng.integers(0, 2**64, n, np.uint64)).any()
