"""Exact, near and substring duplicates against brute force."""

import collections
import hashlib
import os
import random

import pytest

from tremolith.llm import exact_dedup, ngram_join, substring_dedup
from tremolith.llm.components import connected_components

WORDS = [f"w{i}" for i in range(400)]


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def mutated(rng, t, k):
    w = t.split()
    for _ in range(k):
        w[rng.randrange(len(w))] = rng.choice(WORDS)
    return " ".join(w)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    base = text(rng, 120)
    out = [base] * 5 + [mutated(rng, base, rng.randrange(1, 6)) for _ in range(60)]
    out += [text(rng, n) for n in (0, 0, 1, 3, 4, 5, 9, 700)] + [None, "", " ", "a b", "A  b", "a b c d e f g", "a b c d e f g"]
    shared = text(rng, 60)
    out += [text(rng, 40) + " " + shared + " " + text(rng, 40) for _ in range(6)] + [text(rng, 150) for _ in range(20)]
    return list(enumerate(out))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", len(t or ""), i) for i, t in rows], "doc_id long, text string, keep_id string, n int, id long")


def test_exact_groups(spark, rows):
    rows = [*rows, (None, "lost"), (None, "lost"), (3, "twice"), (3, "twice"), (9001, "x" * 70), (9002, "x" * 70), (9003, "x" * 71), (9004, "x" * 69 + "y"), (9005, "\u00e9" * 5000), (9006, "\u00e9" * 4999 + "e"), (9007, "\u00e9" * 5000)]
    got = exact_dedup.radix_groups(frame(spark, rows), first_bytes=8, next_bytes=16).collect()
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    assert len(got) == len(rows)
    kept = collections.Counter()
    for r in got:
        t = r["row"]["text"] or ""
        known = [i for i in groups[t] if i is not None]
        assert r["keep_id"] == (max(known) if known else None) and r["group_size"] == len(groups[t])
        assert r["text_sha256"] == hashlib.sha256(t.encode()).hexdigest()
        kept[t] += r["kept"]
        assert not r["kept"] or r["id"] == r["keep_id"]
    assert set(kept.values()) == {1}
    out = exact_dedup.exact_dedup(frame(spark, rows))
    assert out.columns == frame(spark, rows).columns and out.count() == len(groups)


def test_exact_on_nothing(spark, rows):
    assert exact_dedup.dedup_report(frame(spark, rows).limit(0)).count() == 0


def components(rows):
    def shingles(t):
        w = "".join(c.lower() if c.isascii() else c for c in t or "").split()
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets = {k: shingles(t) for k, (_, t) in enumerate(rows)}
    comp = {k: {k} for k in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                both = comp[a] | comp[b]
                for k in both:
                    comp[k] = both
    return sets, comp


def test_near_components(spark, rows):
    sets, comp = components(rows)
    got = {r["id"]: r for r in ngram_join.document_components(frame(spark, rows)).collect()}
    for k, (i, _) in enumerate(rows):
        assert got[i]["n_shingles"] == len(sets[k])
        assert got[i]["component_id"] == min(rows[j][0] for j in comp[k]), i
    kept = {r["doc_id"] for r in ngram_join.deduplicate(frame(spark, rows)).collect()}
    assert kept == {r["component_id"] for r in got.values()}


def test_near_without_stars_and_in_small_blocks(spark, rows, monkeypatch):
    """The trees alone find all links, also block part by block part."""
    monkeypatch.setattr(ngram_join, "BLOCK", 7)
    monkeypatch.setattr(ngram_join, "HOT", 4)  # shingles of more prefixes come last
    monkeypatch.setattr(ngram_join, "PART_TOKENS", 2000)
    monkeypatch.setattr(ngram_join, "CHUNK", 500)
    monkeypatch.setattr(ngram_join, "SINGLE_PAIRS", 3)
    real = ngram_join._Classes.verified
    monkeypatch.setattr(ngram_join._Classes, "verified", lambda self, pairs: real(self, pairs.limit(0)))
    monkeypatch.setattr(ngram_join, "_one_block_each", lambda mixed: mixed.select("key", "cid").limit(0))
    sets, comp = components(rows)
    got = {r["id"]: r["component_id"] for r in ngram_join.document_components(frame(spark, rows)).collect()}
    assert got == {i: min(rows[j][0] for j in comp[k]) for k, (i, _) in enumerate(rows)}


def stretches(rng, words, least, most, count):
    """Pairs of a passage's stretches that link: with and without the first word."""
    out = []
    for _ in range(count):
        n = rng.randrange(least, most)
        a = rng.randrange(len(words) - n)
        out += [" ".join(words[a : a + n]), " ".join(words[a + 1 : a + n])]
    return out


def test_one_order_when_further_shingles_turn_hot(spark, monkeypatch):
    """Passages that many documents share: their shingles turn hot one turn after
    the other, and stretches of them must still meet (many seeds in one table)."""
    monkeypatch.setattr(ngram_join, "HOT", 6)
    rows = []
    for seed in range(24):
        rng = random.Random(seed)
        words = [f"p{seed}x{i}" for i in range(rng.randrange(30, 130))]
        own = lambda n, rng=rng: [f"o{rng.random()}" for _ in range(n)]
        rows += [" ".join(own(rng.randrange(20, 60)) + words + own(rng.randrange(20, 60))) for _ in range(10)]
        rows += stretches(rng, words, 9, 25, 6)
    rows = list(enumerate(rows))
    found = ngram_join._Classes(spark.createDataFrame([(i, None, t) for i, t in rows], "id long, th binary, text string"))
    prefixes, _ = ngram_join._prefixes(found)
    held = {r["least"]: set(r["prefix"]) for r in prefixes.join(found.names, "cid").collect()}
    sets, comp = components(rows)
    pairs = 0
    for a in sets:
        for b in range(a + 1, min(len(rows), a + 40)):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and a in held and b in held:
                pairs += 1
                assert held[a] & held[b], (a, b)
    assert pairs > 90
    got = {r["id"]: r["component_id"] for r in ngram_join.document_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: min(comp[i]) for i, _ in rows}


def test_stretches_of_a_passage_of_many_documents(spark):
    rng = random.Random(1)
    words = [f"p{i}" for i in range(120)]
    rows = [(k, " ".join(words + [f"o{rng.random()}" for _ in range(124)])) for k in range(1300)]
    rows += [(5000, " ".join(words[72:88])), (5001, " ".join(words[73:88])), (5002, " ".join(words[19:29])), (5003, " ".join(words[20:29]))]
    got = {r["id"]: r["component_id"] for r in ngram_join.document_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[k] for k in range(5000, 5004)] == [5000, 5000, 5002, 5002]
    assert all(got[k] == k for k in range(1300))


def test_prefixes_of_linked_sets_meet_in_any_order():
    import numpy as np

    rng = np.random.default_rng(3)
    hot = rng.integers(0, 256, 1 << 23).astype(np.uint8)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64) << np.uint64(1))
        b = np.unique(np.concatenate([rng.choice(a, len(a) - len(a) // 8, replace=False), rng.integers(0, 2**63, len(a) // 9).astype(np.uint64)]))
        if 4 * len(np.intersect1d(a, b)) >= 3 * len(np.union1d(a, b)):
            for order in (None, hot):
                assert len(np.intersect1d(ngram_join.prefix(a, order), ngram_join.prefix(b, order)))


def test_many_near_copies_that_no_star_joins(spark, monkeypatch):
    """A long chain of texts, each near the next few only, in one block."""
    words = [f"c{i}" for i in range(3000)]
    chain = [(k, " ".join(["same"] * 6 + words[2 * k : 2 * k + 60])) for k in range(1200)]
    monkeypatch.setattr(ngram_join, "BLOCK", 300)
    got = {r["id"]: r["component_id"] for r in ngram_join.document_components(spark.createDataFrame(chain, "doc_id long, text string")).collect()}
    assert set(got.values()) == {0}


def test_deduplicate_goes_by_row(spark):
    t, u = text(random.Random(1), 60), text(random.Random(2), 60)
    rows = [(1, t), (2, t + " x"), (2, u), (3, u + " q"), (5, t + " y"), (5, t + " z"), (7, None), (7, ""), (None, u + " r"), (2, u), (2, u)]
    df = spark.createDataFrame([(i, s, k, 0, "a") for k, (i, s) in enumerate(rows)], "doc_id long, text string, _gone int, component int, th string")
    out = ngram_join.deduplicate(df)
    assert out.columns == df.columns
    kept = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
    assert kept == sorted([(1, t), (2, u), (7, None), (7, "")], key=str)
    lost = spark.createDataFrame([(None, t), (None, t), (None, t + " x")], "doc_id long, text string")
    assert ngram_join.deduplicate(lost).count() == 1


def test_near_on_nothing_and_without_ids(spark, rows):
    assert ngram_join.document_components(frame(spark, rows).limit(0)).count() == 0
    some = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (7, "a b c d e f"), (8, None)], "doc_id long, text string")
    got = sorted(((r["id"], r["component_id"]) for r in ngram_join.document_components(some).collect()), key=str)
    assert got == sorted([(None, 7), (None, 7), (7, 7), (8, 8)], key=str)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101), (5, 5)], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def test_signature_trees_drop_no_link():
    import numpy as np

    from tremolith.llm import signature_tree as st

    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 90).astype(np.uint64)
    sets = []
    for k in range(150):
        s = np.concatenate([rng.choice(base, rng.integers(40, 90), replace=False), rng.integers(0, 2**63, rng.integers(0, 40)).astype(np.uint64)])
        sets.append(np.unique(s))
    sizes = np.array([len(s) for s in sets])
    maps = [st.bitmap(s, st.bits_for(len(s))) for s in sets]
    found = set()
    for x, y in st.join_sets(sizes, maps, np.arange(150), np.arange(0, 150), np.arange(0, 150)):
        found.update(map(frozenset, zip(x.tolist(), y.tolist(), strict=True)))
        assert all(st.near((sizes[i], sizes[j]), (maps[i], maps[j])) for i, j in zip(x.tolist(), y.tolist(), strict=True))
    true = {frozenset((a, b)) for a in range(150) for b in range(a) if 4 * len(np.intersect1d(sets[a], sets[b])) >= 3 * len(np.union1d(sets[a], sets[b]))}
    assert true and true <= found and len(found) < 150 * 149 / 4


def test_repeats(spark, rows):
    got = substring_dedup.repeats(frame(spark, rows)).collect()
    grams = collections.defaultdict(set)
    for k, (_, t) in enumerate(rows):
        w = (t or "").split()
        for i in range(len(w) - 50):
            grams[tuple(w[i : i + 51])].add(k)
    have = {k for s in grams.values() if len(s) > 1 for k in s}
    found = {r["id"] for r in got}
    assert {rows[k][0] for k in have} <= found
    clean = {i for k, (i, _) in enumerate(rows) if k >= len(rows) - 20}
    assert not clean & found
    texts = dict(rows)
    for r in got:
        raw = texts[r["id"]].encode()
        other = [t or "" for i, t in rows if i != r["id"]]
        _, _, start, end, *_ = substring_dedup.units(texts[r["id"]])
        inside = [raw[a:b].decode() for a, b in zip(start.tolist(), end.tolist(), strict=True) if r["start"] <= a and b <= r["end"]]
        assert r["n_words"] >= 25 and inside and all(any(u in t for t in other) for u in inside)
        assert r["removed"] == (r["first_id"] != r["id"])


def test_short_passages_to_their_true_ends(spark):
    """Recall at, above and just under the least number of words; clean texts stay."""
    rng = random.Random(81)
    sizes = [15, 20, 23, 24, 25, 26, 28, 30, 40]
    rows, planted = [], {}
    for n in sizes:
        for _ in range(60):
            words = [f"{rng.choice(WORDS)}{rng.randrange(9999)}" for _ in range(n)]
            for _ in range(2):
                own = [["".join(rng.choices("abcdefghijklm", k=7)) for _ in range(rng.randrange(20, 60))] for _ in range(2)]
                planted[len(rows)] = (n, " ".join(words))
                rows.append((len(rows), " ".join([*own[0], *words, *own[1]])))
    clean = range(len(rows), len(rows) + 100)
    rows += [(k, " ".join(f"u{rng.random()}"[:8] for _ in range(90))) for k in clean]
    got = {r["id"]: r for r in substring_dedup.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not set(clean) & got.keys()
    for n in sizes:
        share = sum(i in got for i, p in planted.items() if p[0] == n) / 120
        assert (share >= 0.95 if n >= 25 else share == 0), (n, share)
    for i, r in got.items():
        text = rows[i][1].encode()
        n, passage = planted[i]
        words = text[r["start"] : r["end"]].decode().split()
        assert 25 <= r["n_words"] <= n + 1 and set(words[1:-1]) <= set(passage.split())
        if n == 25:  # taken to its ends
            assert passage in text[r["start"] : r["end"]].decode() and len(words) <= n + 1
        assert r["removed"] == (r["first_id"] != i)


def test_removing_repeats_keeps_one_holder(spark, rows):
    df = frame(spark, rows)
    out = {r["doc_id"]: r["text"] for r in substring_dedup.remove_repeats(df).select("doc_id", "text").collect()}
    before = dict(rows)
    assert out.keys() == before.keys()
    assert out[0] == before[0] and len(out[4]) < 40  # equal texts: the first keeps all
    assert all(out[i] == before[i] for i in list(before)[-20:])
    assert substring_dedup.repeats(df.limit(0)).count() == 0
    again = spark.createDataFrame([(1, before[0]), (1, before[0])], "doc_id long, text string")
    assert substring_dedup.repeats(again).count() == 0  # one document


def test_passages_without_spaces_and_clashing_names(spark):
    rng = random.Random(6)
    make = lambda n: "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(n))
    shared = make(600)
    rows = [(k, make(80) + shared + make(80), k, k, "s", 1) for k in range(3)] + [(None, None, 0, 0, "", 0), (9, make(700), 0, 0, "", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, th int, id int, spans string, i int")
    found = {r["id"]: r["removed"] for r in substring_dedup.repeats(df).collect()}
    assert found == {0: False, 1: True, 2: True}
    out = substring_dedup.remove_repeats(df)
    assert out.columns == df.columns
    got = {r["doc_id"]: r for r in out.collect()}
    assert len(got[1]["text"]) < 250 and got[0]["text"] == rows[0][1] and got[9]["text"] == rows[4][1] and got[None]["text"] is None
    assert all(got[k]["th"] == k and got[k]["spans"] == "s" for k in range(3))


def test_classes_and_search_in_turns_without_whole_sets(spark, rows, monkeypatch):
    """Hot shingles, several turns: the same components, no whole set written for prefixes."""
    df = frame(spark, rows)
    want = collections.Counter(tuple(r) for r in ngram_join.document_components(df).collect())
    tags = []
    real = ngram_join.materialise
    monkeypatch.setattr(ngram_join, "materialise", lambda df, tag: tags.append(tag) or real(df, tag))
    for name, value in (("HOT", 5), ("TURN_ROWS", 20), ("JOB_ROWS", 20)):
        monkeypatch.setattr(ngram_join, name, value)
    assert collections.Counter(tuple(r) for r in ngram_join.document_components(df).collect()) == want
    assert "touched" in tags and tags.count("classes") > 2 and "shingles" not in tags[: tags.index("alike")]


def test_repeats_in_turns_drop_their_tables(spark, rows, monkeypatch):
    """The same rows in one turn and in many, and nothing of the units is left behind."""
    rng = random.Random(7)
    make = lambda n: [f"w{rng.randrange(10**6)}x" for _ in range(n)]
    shared = make(26)
    some = [*rows[:60], *[(7000, " ".join([*make(40), *shared, *make(40)])) for _ in range(3)], (None, " ".join([*make(20), *shared, *make(30)]))]
    df = frame(spark, some)
    kept = []
    real = substring_dedup.materialise
    monkeypatch.setattr(substring_dedup, "materialise", lambda df, tag: kept.append((tag, real(df, tag))) or kept[-1][1])
    names = ["id", "th", "start", "end", "n_words", "first_id", "removed"]
    one = collections.Counter(tuple(r) for r in substring_dedup.repeats(df).select(names).collect())
    assert sum(t == "met" for t, _ in kept) == 1
    monkeypatch.setattr(substring_dedup, "TURN_ROWS", 50)
    kept.clear()
    assert collections.Counter(tuple(r) for r in substring_dedup.repeats(df).select(names).collect()) == one
    met = [t for tag, t in kept if tag == "met"]
    assert len(met) == substring_dedup.TURNS and not any(os.path.exists(f.removeprefix("file:")) for t in met for f in t.inputFiles())
    assert sum(k[0] == 7000 for k in one.elements()) == 3 and None in {k[0] for k in one}


def test_cuts_fall_into_step_after_insertions():
    import numpy as np

    t = text(random.Random(1), 400).encode()
    a = set(substring_dedup.cuts(np.frombuffer(t, np.uint8)).tolist())
    moved = b"some words more " + t
    b = {c - 16 for c in substring_dedup.cuts(np.frombuffer(moved, np.uint8)).tolist()}
    assert len(a & b) > 0.9 * len(a)


def test_many_pairs_of_leaves_are_met_at_once():
    """Small blocks together give what each gives by its own trees, and no link is lost."""
    import numpy as np

    from tremolith.llm import signature_tree as st

    rng = np.random.default_rng(4)
    sets, group, side = [], [], []
    for g in range(40):
        base = rng.integers(0, 2**64, int(rng.integers(1, 400)), dtype=np.uint64)
        for _ in range(int(rng.integers(2, 9))):
            own = base.copy()
            own[rng.random(len(base)) < rng.choice([0.05, 0.12, 0.5])] = rng.integers(0, 2**64, dtype=np.uint64)
            sets.append(np.unique(own[: max(1, int(len(own) * rng.choice([0.5, 0.8, 1])))]))
            group.append(g)
            side.append(bool(rng.integers(0, 2)))
    group, side, labels = np.array(group), np.array(side), np.arange(len(sets)) % 5
    sizes, maps = np.array([len(s) for s in sets]), [st.bitmap(s, st.bits_for(len(s))) for s in sets]
    pairs = lambda found: sorted((i, j) for x, y in found for i, j in zip(x.tolist(), y.tolist(), strict=True))
    got = pairs(st.join_leaves(sizes, maps, labels, np.flatnonzero(side), np.flatnonzero(~side), group))
    want = []
    for g in range(40):
        left, right = np.flatnonzero(side & (group == g)), np.flatnonzero(~side & (group == g))
        if len(left) and len(right):
            want += pairs(st.join_sets(sizes, maps, labels, left, right))
    linked = {(i, j) for i in np.flatnonzero(side) for j in np.flatnonzero(~side) if group[i] == group[j] and labels[i] != labels[j] and ngram_join._linked(sets[i], sets[j])}
    assert len(linked) > 20 and linked <= set(got) and set(want) <= set(got) and len(got) == len(set(got))
    assert all(st.near((sizes[i], sizes[j]), (maps[i], maps[j])) for i, j in got)


def test_shingles_are_counted_packed(spark, monkeypatch):
    """Counts of prefixes' shingles over tasks: the bitmap of shared ones and the hot ones."""
    import numpy as np

    from tremolith.llm.bitmaps import assembled, hits, unpacked

    monkeypatch.setattr(ngram_join, "HOT", 4)
    rng = np.random.default_rng(2)
    common = rng.integers(0, 2**64, 60, dtype=np.uint64)
    held = [np.unique(np.concatenate([rng.integers(0, 2**64, 20, dtype=np.uint64), common[rng.random(60) < k / 200]])) for k in range(30)] + [common[:0]]
    df = spark.createDataFrame([(k, bytearray(s.tobytes())) for k, s in enumerate(held)], "cid long, prefix binary").repartition(4)
    found = ngram_join._counted(df)
    counts = collections.Counter((np.concatenate(held) & np.uint64(0x7FFFFFFF)).tolist())
    assert max(counts.values()) > 4 and min(counts.values()) == 1
    assert sorted(r["key"] for r in found.selectExpr("explode(hot) AS key").collect()) == sorted(k for k, n in counts.items() if n > 4)
    bits = unpacked(assembled(found))
    want = {k & (2**26 - 1) for k, n in counts.items() if n > 1}
    assert int(np.unpackbits(bits).sum()) == len(want) and hits(bits, np.array(list(want), np.uint64)).all()


def test_packed_prefixes_of_linked_sets_share_a_shingle(spark, monkeypatch):
    """One order for all, read out of the packed prefixes shingle by shingle."""
    import numpy as np

    monkeypatch.setattr(ngram_join, "HOT", 6)
    rows = []
    for seed in range(3):
        rng = random.Random(seed)
        words = [f"p{seed}x{i}" for i in range(rng.randrange(30, 130))]
        rows += [" ".join([f"o{rng.random()}" for _ in range(30)] + words) for _ in range(10)] + stretches(rng, words, 9, 25, 6)
    rows = list(enumerate(rows))
    found = ngram_join._Classes(spark.createDataFrame([(i, None, t) for i, t in rows], "id long, th binary, text string"))
    prefixes, _ = ngram_join._prefixes(found)
    held = {r["least"]: set(np.frombuffer(bytes(r["prefix"]), np.uint64).tolist()) for r in prefixes.join(found.names, "cid").collect()}
    sets, _ = components(rows)
    linked = [(a, b) for a in held for b in held if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    assert len(linked) > 6 and all(held[a] & held[b] for a, b in linked)
    assert all(len(held[a]) == len(sets[a]) // 4 + 1 for a in held)
