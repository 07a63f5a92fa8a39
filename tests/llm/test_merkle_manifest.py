"""The Merkle manifest against a plain tree."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tremolith.llm import merkle_manifest as merkle

FIELDS = ["doc_id", "lang", "text"]


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(values):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(nodes):
    """The last node, and of each first node its siblings, as lists a level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            a = i // 8 * 8
            paths[k].append((nodes[a:i], nodes[i + 1 : a + 8]))
            at[k] = i // 8
        nodes = [h(*nodes[a : a + 8]) for a in range(0, len(nodes), 8)]
    return nodes[0], paths


def plain_version(rows):
    """(id, leaf, subroot, root, siblings) of each row (id, lang, text)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r[0], plain_leaf(r)))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[g] = plain_tree([x[1] for x in groups[g]])
    root, above = plain_tree([trees[g][0] for g in order])
    out = []
    for g, up in zip(order, above, strict=True):
        for (i, own), path in zip(groups[g], trees[g][1], strict=True):
            out.append((i, own, trees[g][0], root, [s for left, right in path + up for s in left + right]))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, lang string, text string, node string, at int")


def compare(spark, rows):
    found = merkle.manifest(frame(spark, rows), FIELDS, "lang", "doc_id", ["doc_id", "text"])
    found = found.withColumn("proof", merkle.proof(F.col("path"))).withColumn("again", merkle.folded(F.col("leaf"), F.col("path")))
    got = found.withColumn("forged", merkle.folded(F.lit("0" * 64), F.col("path"))).collect()
    key = lambda x: (x[0] is not None, x[0] or 0, x[1:])
    assert sorted(((r.row.doc_id, r.leaf, r.subroot, r.root, r.proof) for r in got), key=key) == sorted(plain_version(rows), key=key)
    assert all(r.again == r.root != r.forged for r in got)


@pytest.mark.parametrize("sizes", [[1], [8, 1], [9, 64, 65], [513, 1, 7], [4097, 512, 520]])
def test_sizes(spark, sizes):
    rng = random.Random(13)
    rows = [(rng.randrange(10**9), f"g{g}", f"t{rng.random()}é") for g, n in enumerate(sizes) for _ in range(n)]
    compare(spark, rows)


def test_nulls_ties_and_many_groups(spark):
    rng = random.Random(14)
    rows = [(i, rng.choice([None, "", "-", "=", "de", "é", "z", "Z", "\U0001f600"]), rng.choice([None, "", "-", "a"])) for i in range(70)]
    rows += [(None, "de", "x"), (None, "de", "x"), (None, None, None), (3, "de", "tie"), (3, "de", "tie b"), (3, "de", "tie"), (-5, "de", "below")]
    rows += [(i, f"group {i}", "x") for i in range(600)]  # a forest of two rounds
    compare(spark, rows)


def test_whole_rows_and_empty_table(spark):
    found = merkle.manifest(frame(spark, [(1, "de", None)]), FIELDS, "lang", "doc_id").collect()
    assert found[0].row.node == "x" and found[0].row.at == 1 and found[0].path == []
    assert found[0].leaf == found[0].subroot == found[0].root == plain_leaf((1, "de", None))
    assert merkle.manifest(frame(spark, []), FIELDS, "lang", "doc_id").count() == 0


def test_query_finds_what_was_tampered_with(spark, tmp_path):
    import zlib

    rows = [(i, "s", "de" if i % 3 else None, 3, ["Ab", "ab", None][i % 3]) for i in range(100)]
    spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in merkle.op13_merkle_manifest(spark, str(tmp_path)).collect()}
    assert len(got) == 100
    for i, *_, t in rows:
        changed = zlib.crc32(str(i).encode()) % 3 == 0 and t == "Ab"
        assert got[i].verified == (not changed) and (got[i].folded_root == got[i].root) == got[i].verified
