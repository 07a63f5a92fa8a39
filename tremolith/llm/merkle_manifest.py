"""A Merkle manifest of a dataset: one digest for all rows, and each row's proof.

H is the lowercase hex sha256 of its inputs put together.  A row's leaf is H of its
fields; the leaves of a group ascend by an order column, and while a group has
several nodes, every ARITY consecutive ones become their H.  What remains is the
group's subroot; the subroots, ordered by group (null first, then by bytes), give
the root by the same rule.

All of it is SQL.  Rows are dealt by range and numbered by their partition's
count, so a group with a third of all rows lies over many tasks.  A block holds
ARITY ** HEIGHT consecutive nodes as one ordered array; sequence, transform, slice
and aggregate collapse its levels in place, and blocks' roots are the nodes of the
next round, until every group has one block.  On the way back each block's
path (the runs that its root and those above it lie in) goes down to its nodes,
and the leaves, still in their blocks, get theirs without another shuffle of rows.
A block is bounded, so no array, task or group grows with the data; the rounds are
log(rows) / log(512), and the driver sees one number.

Defined results: a null field is written ``-``, which no value is; null groups are
one group, before all others; a null in the order column is the least; ties in it
go by the leaf, and rows that tie in both are equal and interchangeable (each has
a place of its own); an empty table has no rows and no root; further columns
change nothing and are kept if asked for, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import materialise, release, table

#: Nodes of a run, and the levels that one block collapses.
ARITY, HEIGHT = 8, 3
BLOCK = ARITY**HEIGHT

_PATH = "array<struct<run: array<string>, at: int>>"
#: The H of each run of an array x.
_NEXT = f"transform(sequence(0, (size(x) - 1) div {ARITY}), i -> sha2(array_join(slice(x, int(i) * {ARITY} + 1, {ARITY}), ''), 256))"
#: The levels above an array ``nodes``, with it: HEIGHT of them if its group has
#: further blocks, else as many as leave one node.
_DEPTH = f"CASE WHEN total > {BLOCK} THEN {HEIGHT} " + " ".join(f"WHEN size(nodes) <= {ARITY**k} THEN {k}" for k in range(HEIGHT + 1)) + " END"
_LEVELS = f"aggregate(slice(sequence(1, {HEIGHT}), 1, {_DEPTH}), array(nodes), (up, _) -> concat(up, transform(slice(up, -1, 1), x -> {_NEXT})))"
#: The runs that node ``k.at`` of a block lies in, lowest first.
_STEPS = (
    f"transform(slice(sequence(0, {HEIGHT}), 1, size(levels) - 1), l -> named_struct("
    f"'run', slice(levels[l], int((k.at % {BLOCK}) div bigint(pow({ARITY}, l + 1))) * {ARITY} + 1, {ARITY}), "
    f"'at', int((k.at % {BLOCK}) div bigint(pow({ARITY}, l)) % {ARITY})))"
)


def leaf(columns: list[Column]) -> Column:
    """H of some fields: each ``-`` if null, else UTF-8 byte count, colon, value."""
    text = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in text]), 256)


def proof(path: Column) -> Column:
    """All siblings on a path, level by level, left to right."""
    return F.flatten(F.transform(path, lambda s: F.concat(F.slice(s.run, 1, s.at), F.slice(s.run, s.at + 2, F.lit(ARITY)))))


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, start, lambda h, s: F.sha2(F.concat(F.array_join(F.slice(s.run, 1, s.at), ""), h, F.array_join(F.slice(s.run, s.at + 2, F.lit(ARITY)), "")), 256))


def _numbered(nodes: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``at``, each row's place within its group ``g``, and ``total``, the rows of
    the group."""
    # Written: a second reading of a range shuffle may cut its ranges elsewhere.
    dealt = materialise(nodes.repartitionByRange("g", *order).sortWithinPartitions("g", *order).withColumn("at", F.monotonically_increasing_id()), "dealt")
    part = F.shiftright("at", 33)
    parts = dealt.groupBy("g", part.alias("part")).agg(F.min("at").alias("low"), F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy("g")  # one row for each partition that the group lies in
    before = own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("g").alias("pg"), "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("low")).alias("shift"), F.sum("n").over(own).alias("total"))
    met = dealt.withColumn("p", part).join(parts, (F.col("g") == F.col("pg")) & (F.col("p") == F.col("part")))
    return met.withColumn("at", F.col("at") + F.col("shift")).drop("pg", "part", "p", "shift")


def _blocks(nodes: DataFrame) -> DataFrame:
    """``g, block, total, kids, levels`` of nodes (g, at, total, node and others)."""
    kid = F.struct("at", *[c for c in nodes.columns if c not in ("g", "at", "total")])
    held = nodes.groupBy("g", F.floor(F.col("at") / BLOCK).alias("block")).agg(F.max("total").alias("total"), F.sort_array(F.collect_list(kid)).alias("kids"))
    return materialise(held.withColumn("nodes", F.expr("transform(kids, k -> k.node)")).withColumn("levels", F.expr(_LEVELS)).drop("nodes"), "merkle-blocks")


def _collapsed(nodes: DataFrame) -> list[DataFrame]:
    """The blocks of each round, the last one with one block for each group."""
    rounds = [_blocks(nodes)]
    most = rounds[0].agg(F.max("total")).first()[0] or 0
    while most > BLOCK:
        above = rounds[-1].select("g", F.col("block").alias("at"), F.ceil(F.col("total") / BLOCK).alias("total"), F.expr("element_at(levels, -1)[0]").alias("node"))
        rounds.append(_blocks(above))
        most = -(-most // BLOCK)
    return rounds


def _down(blocks: DataFrame, paths: DataFrame) -> DataFrame:
    """The nodes of blocks, as structs ``k`` (with ``at``), with their whole paths;
    ``paths`` has the path of each block's root and what else goes down."""
    met = blocks.join(paths.withColumnsRenamed({"g": "pg", "at": "pat", "path": "above"}), (F.col("g") == F.col("pg")) & (F.col("block") == F.col("pat")))
    more = [c for c in paths.columns if c not in ("g", "at", "path")]
    # The paths are made within the array: a row to be exploded holds one array, not all levels.
    each = F.expr(f"transform(kids, k -> named_struct('k', k, 'path', concat({_STEPS}, above)))")
    return met.select("g", F.explode(each).alias("x"), *more).select("g", "x.k", "x.path", *more)


def _paths(rounds: list[DataFrame], tops: DataFrame) -> DataFrame:
    """From the paths of the groups' last nodes to those of the nodes of the first round."""
    for blocks in reversed(rounds[1:]):
        found = _down(blocks, tops)
        tops = found.select("g", F.col("k.at").alias("at"), "path", *[c for c in tops.columns if c not in ("g", "at", "path")])
    return _down(rounds[0], tops)


def manifest(docs: DataFrame, columns: list[str], group_col: str, order_col: str, carry: list[str] | None = None) -> DataFrame:
    """``row`` (the columns ``carry`` of the input, all if None), ``leaf, path, subroot,
    root`` of every row; :func:`proof` and :func:`folded` work on the path."""
    group = F.col(f"`{group_col}`").cast("string")
    leaves = docs.select(
        F.coalesce(F.concat(F.lit("="), group), F.lit("-")).alias("g"),  # "-" comes before "="
        F.col(f"`{order_col}`").alias("o"),
        leaf([F.col(f"`{c}`") for c in columns]).alias("node"),
        F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in (docs.columns if carry is None else carry)]).alias("row"),
    )
    leaves = materialise(leaves, "leaves")  # texts are hashed once, ranges are sampled from digests
    rounds = _collapsed(_numbered(leaves, ["o", "node"]).drop("o"))
    release(leaves)
    last = F.expr("element_at(levels, -1)[0]")
    subroots = materialise(rounds[-1].select(F.col("g").alias("name"), last.alias("node")), "subroots")
    whole = _collapsed(_numbered(subroots.withColumn("g", F.lit("")), ["name"]))
    tops = whole[-1].select("g", F.lit(0).cast("long").alias("at"), F.expr(f"cast(array() as {_PATH})").alias("path"), last.alias("root"))
    tops = _paths(whole, tops).select(F.col("k.name").alias("g"), F.lit(0).cast("long").alias("at"), "path", F.col("k.node").alias("subroot"), "root")
    return _paths(rounds, tops).select("k.row", F.col("k.node").alias("leaf"), "path", "subroot", "root")


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    forged = leaf([F.translate("text", _UPPER, _LOWER) if c == "text" else F.col(c) for c in FIELDS])
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    found = manifest(docs.withColumn("forged", F.when(tampered, forged)), FIELDS, "lang", "doc_id", ["doc_id", "forged"])
    found = found.select(
        "row.doc_id", "leaf", "subroot", "root",
        F.sha2(F.array_join(proof(F.col("path")), ""), 256).alias("proof_sha256"),
        folded(F.coalesce("row.forged", "leaf"), F.col("path")).alias("folded_root"),
    )
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def _field(c: str) -> str:
    return f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"


_LOWERED = f"translate(text, '{_UPPER}', '{_LOWER}')"
#: crc32: each byte is met by xor, then eight shifts.
_CRC = """xor(4294967295, list_reduce(list_concat([4294967295], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
  lambda ch: [CAST(ascii(ch) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END))"""
ORACLE = f"""
WITH RECURSIVE leaves AS (
  SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST) AS r, doc_id, lang, sha256({" || ".join(map(_field, FIELDS))}) AS leaf,
         sha256({" || ".join(_field(_LOWERED if c == "text" else c) for c in FIELDS)}) AS forged,
         coalesce({_CRC} % 3 = 0, false) AS tampered
  FROM documents),
numbered AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM leaves),
nodes AS (
  SELECT 0 AS lvl, lang, i, leaf AS h, count(*) OVER (PARTITION BY lang) AS c FROM numbered
  UNION ALL
  SELECT lvl + 1, lang, i // {ARITY}, sha256(string_agg(h, '' ORDER BY i)), (any_value(c) + {ARITY - 1}) // {ARITY} FROM nodes WHERE c > 1 GROUP BY lvl, lang, i // {ARITY}),
subroots AS (SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i FROM nodes WHERE c = 1),
tops AS (
  SELECT 0 AS lvl, i, h, count(*) OVER () AS c FROM subroots
  UNION ALL
  SELECT lvl + 1, i // {ARITY}, sha256(string_agg(h, '' ORDER BY i)), (any_value(c) + {ARITY - 1}) // {ARITY} FROM tops WHERE c > 1 GROUP BY lvl, i // {ARITY}),
runs AS (
  SELECT lvl, coalesce('=' || lang, '-') AS g, i // {ARITY} AS p, list(h ORDER BY i) AS kids FROM nodes WHERE c > 1 GROUP BY lvl, lang, i // {ARITY}),
heights AS (SELECT coalesce('=' || n.lang, '-') AS g, max(n.lvl) AS high, any_value(s.i) AS place, any_value(s.h) AS subroot FROM nodes n JOIN subroots s ON n.lang IS NOT DISTINCT FROM s.lang GROUP BY n.lang),
all_runs AS (
  SELECT g, lvl, p, kids FROM runs
  UNION ALL
  SELECT 'top', lvl, i // {ARITY}, list(h ORDER BY i) FROM tops WHERE c > 1 GROUP BY lvl, i // {ARITY}),
walk AS (
  SELECT r, g, 0 AS lvl, i, place, false AS top, high, CASE WHEN tampered THEN forged ELSE leaf END AS h, '' AS sib FROM numbered JOIN heights ON g = coalesce('=' || lang, '-')
  UNION ALL
  SELECT r, CASE WHEN up THEN 'top' ELSE w.g END, CASE WHEN up THEN 0 ELSE w.lvl + 1 END, CASE WHEN up THEN place ELSE w.i // {ARITY} END, place, top OR up, high,
         CASE WHEN up THEN h ELSE sha256(array_to_string(kids[1:(w.i % {ARITY})], '') || h || array_to_string(kids[(w.i % {ARITY}) + 2:], '')) END,
         CASE WHEN up THEN sib ELSE sib || array_to_string(kids[1:(w.i % {ARITY})], '') || array_to_string(kids[(w.i % {ARITY}) + 2:], '') END
  FROM (SELECT *, NOT top AND lvl = high AS up FROM walk) w LEFT JOIN all_runs a ON NOT up AND a.g = w.g AND a.lvl = w.lvl AND a.p = w.i // {ARITY}
  WHERE up OR a.kids IS NOT NULL),
ends AS (SELECT r, arg_max(h, lvl) AS h, arg_max(sib, lvl) AS sib FROM walk WHERE top GROUP BY r)
SELECT doc_id, leaf, subroot, (SELECT h FROM tops WHERE c = 1) AS root, sha256(sib) AS proof_sha256, e.h AS folded_root, e.h = (SELECT h FROM tops WHERE c = 1) AS verified
FROM numbered n JOIN ends e USING (r) JOIN heights ON g = coalesce('=' || n.lang, '-')
"""
