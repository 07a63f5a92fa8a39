"""Decontamination, licenses, pages, urls and pieces against brute force."""

import collections
import random
import re

import pytest

from tremolith.llm import decontaminate, html_extract, license_scan, sentence_pieces, url_filter

WORDS = [f"w{i}" for i in range(300)]


def shingles(t):
    w = (t or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


@pytest.mark.parametrize("most", [decontaminate.MAX_TABLE_BYTES, 0])
def test_containment(spark, most):
    rng = random.Random(9)
    make = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    items = [(i, make(n)) for i, n in enumerate([3, 4, 5, 6, 8, 12, 20, 33, 50, 120, 0])] + [(90, None), (0, make(7))]
    docs = []
    for k, (_, t) in enumerate(items * 3):
        w = (t or "").split()
        for _ in range(k % 4):
            if w:
                w[rng.randrange(len(w))] = "changed"
        docs.append((k, make(60) + " " + " ".join(w) + " " + make(60)))
    docs += [(200, items[0][1]), (201, None), (202, ""), (200, items[0][1]), (203, make(3000) + " " + items[8][1].upper())]
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, item_id int")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = collections.Counter((r["doc_id"], r["item_id"], r["n_item"], r["n_common"]) for r in decontaminate.contained_items(d, b, max_table_bytes=most).collect())
    want = collections.Counter()
    for i, t in docs:
        for j, q in items:
            s = shingles(q)
            common = len(s & shingles(t))
            if s and 4 * common >= 3 * len(s):
                want[i, j, len(s), common] += 1
    assert got == want and len(want) > 10
    clean = (None, make(40))
    d = d.unionAll(spark.createDataFrame([(None, items[8][1], 1), (*clean, 1), (200, clean[1], 1)], d.schema)).withColumn("_bad", d.item_id).withColumn("th", d.item_id)
    kept = decontaminate.decontaminate(d, b, max_table_bytes=most)
    left = [(i, t) for i, t in docs if i not in {k[0] for k in want}] + [clean, (200, clean[1])]
    assert kept.columns == d.columns and sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted(left, key=str)
    assert decontaminate.contained_items(d.limit(0), b, max_table_bytes=most).count() == 0
    assert decontaminate.contained_items(d, b.limit(0), max_table_bytes=most).count() == 0


LICENSES = [
    "Code under the MIT License, or UNDER THE mit  license! under the mit-license.",
    "cc-by-nc cc by nc by nc cc by",
    "Apache License, Version 2.0 and apache license version 20",
    "Permission is hereby granted, free of any charge, to any person obtaining a copy of this software and its associated documentation files",
    None, "", "   ", "mit", "under the\u00e9 mit license", "x " * 5000 + "cc by nc",
]


def test_licenses(spark):
    rows = [(i, t) for i, t in enumerate(LICENSES)] + [(1, LICENSES[1]), (0, None)]
    df = spark.createDataFrame([(i, t, "n") for i, t in rows], "doc_id long, text string, label string")
    got = collections.Counter(tuple(r) for r in license_scan.license_report(spark, df).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect())
    want = collections.Counter()
    for i, t in rows:
        low = "".join(c.lower() if c.isascii() else c for c in t or "")
        w = [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", low) if x]
        at = [(k, label) for p, label in license_scan.BASE.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        places = [k for k, _ in at]
        want[i, len(w), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({label for _, label in at}))] += 1
    assert got == want
    labels = {r["doc_id"]: (r["labels"], r["score"]) for r in license_scan.license_report(spark, df.filter("doc_id = 3")).collect()}
    scores = {r["doc_id"]: r["score"] for r in license_scan.license_report(spark, df).collect()}
    assert scores[2] == 1.0 and scores[4] == scores[7] == 0.0
    assert labels[3][0] == "mit" and 0.6 <= labels[3][1] < 1
    assert license_scan.license_report(spark, df.limit(0)).count() == 0


NOTICES = [
    ("This work is licensed under the GNU General Public License, version 3.", "gpl,gpl-3"), ("\u00a9 2020. All rights reserved.", "all-rights-reserved"),
    ("Released under the MIT License.", "mit"), ("GNU Lesser General Public Licence, version 2.1", "lgpl,lgpl-2"), ("SPDX-License-Identifier: BSD-3-Clause", "bsd"),
    ("Mozilla Public License, v. 2.0", "mpl,mpl-2"), ("the general public may license all rights", ""), ("all rights were reserved", ""),
]


def test_short_notices_are_found_whole(spark):
    rows = [(i, "so it was. " * i + text) for i, (text, _) in enumerate(NOTICES)]
    got = {r["doc_id"]: (r["labels"], r["score"] == 1.0) for r in license_scan.license_report(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: (label, label != "") for i, (_, label) in enumerate(NOTICES)}


def test_each_license_gets_its_own_label(spark):
    long = [(label, p) for label, passages in license_scan.TEMPLATES.items() for p in passages]
    rows = [(i, f"Copyright 2020 someone. {p}. Some words of another kind follow here.") for i, (_, p) in enumerate(long)]
    got = {r["doc_id"]: r["labels"].split(",") for r in license_scan.license_report(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    passages = {label for label in license_scan.TEMPLATES}
    for i, (label, _) in enumerate(long):
        family = {x.split("-")[0] for x in (label,)}
        assert label in got[i], (label, got[i])
        # Besides short notices inside it, which are of the same license, no other passage's label.
        assert all(x == label or x.split("-")[0] in family for x in set(got[i]) & passages) and not {"cc-by", "cc-by-sa", "cc-by-nc", "cc-by-nd"} & (set(got[i]) - {label}), (label, got[i])


def test_diagonals_far_apart_merge_in_order(spark):
    mit = license_scan.TEMPLATES["mit"][0].split()
    n = len(mit)
    texts = [
        mit[:9] + ["inserted"] * 12 + mit[9:], mit[:7] + mit[12:], mit[9:] + mit[:9], mit[:9] + ["inserted"] * 200 + mit[9:], mit + mit,
        ["obtaining", "a", "copy"] + mit[:6] + ["x"] * 4 + mit[6:12] + ["y"] * 5 + mit[12:],
    ]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)] + [(0, " ".join(texts[0]))], "doc_id long, text string")
    found = collections.defaultdict(list)
    for r in license_scan.spans(spark, df).filter("template IS NOT NULL").collect():
        found[r["id"]].append((r["first"], r["last"], round(r["coverage"] * (n - 2))))
    assert found.pop(4) and sorted(license_scan.spans(spark, df).filter("id = 4 AND template IS NOT NULL").select("first", "last", "coverage").collect()) == [(0, n - 1, 1.0), (n, 2 * n - 1, 1.0)]
    assert found == {0: [(0, n + 11, n - 4)], 1: [(0, n - 6, n - 9)], 5: [(3, n + 11, n - 6)]}


PAGE = """<!doctype html><html><head><title>t</title><style>p{}</style><script>var a="</p><article>";</script></head><body class="with-sidebar">
<header>site</header><nav><ul><li><a href="/">home</a></ul></nav><div class="cookie-notice">we use</div><!-- <p>no</p> -->
<main><article class=post><header><h1>Caf&eacute; &amp; bar</h1></header><p>One<br>two &lt;b&gt; <b>three</b><p>four&nbsp;five <span class="ad">buy</span> six</p>
<form><input><p>send</p></form><ul><li>a<li>b</ul><aside>side</aside><div id="comments"><p>nice</p></div><p hidden>gone</p><p style="display: none">gone</p></article></main><footer>&copy; x</footer>"""


def test_blocks():
    assert html_extract.blocks(PAGE)[0] == ["Caf\u00e9 & bar", "One two <b> three", "four five", "six", "a", "b"]
    assert html_extract.blocks(None) == ([], [], [], False)
    assert html_extract.blocks("plain <i>text")[1] == ["plain text"]
    assert html_extract.blocks("<main><p>x</main>")[0] == ["x"]


@pytest.mark.parametrize("page,want", [
    ("<main><h1>Title</h1><p>lead<article>body</article><p>tail</main>", ["Title", "lead", "body", "tail"]),
    ("<main>body</main><div><article>card</article></div>", ["body"]),
    ("<article><p class='social-history'>a<p id='related-work'>b<div class='search-engines'>c</div></article>", ["a", "b", "c"]),
    ("<article><select><option>x<p>kept</p><p>too</article>", ["kept", "too"]),
    ("<article><p>so <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds</article>", ["so x=1 holds"]),
    ("<article>text<div class='related-posts'>no</div><div id='share_buttons'>no</div><ul class='nav2 breadcrumbs'><li>no</ul></article>", ["text"]),
    ("<main><header><h1>Head</h1></header>" + "<p>long text</p>" * 3 + "</main><header>site</header>", ["Head"] + ["long text"] * 3),
    ("<article>" + "<p>" + "very long " * 50_000 + "</article>", [("very long " * 50_000).strip()]),
])
def test_main_text_is_not_lost(page, want):
    assert html_extract.blocks(page)[0] == want


def test_pages(spark):
    bar = " ".join(f"menu{i}" for i in range(9))
    bare = lambda k: f"<div>{bar}</div><p>own{k} text{k} of{k} page{k} here{k} and{k} more{k}</p>"
    rows = [(0, "http://h.org/a", PAGE), (1, "http://h.org/b", bare(1)), (2, "http://h.org/c", bare(2)), (3, "http://other.org/", bare(3)), (4, None, None), (5, "http://h.org/d", ""), (1, "http://h.org/b", bare(1))]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = collections.Counter((r["page_id"], r["text"]) for r in html_extract.extract(df).collect())
    own = lambda k: f"own{k} text{k} of{k} page{k} here{k} and{k} more{k}"
    assert got == collections.Counter({(0, "Caf\u00e9 & bar\n\nOne two <b> three\n\nfour five\n\nsix\n\na\n\nb"): 1, (1, own(1)): 2, (2, own(2)): 1, (3, f"{bar}\n\n{own(3)}"): 1, (4, ""): 1, (5, ""): 1})
    assert html_extract.extract(df.limit(0)).count() == 0


def test_bare_pages_keep_shared_sentences_and_near_copies(spark):
    menu = "<ul>" + "".join(f"<li>entry{i}</li>" for i in range(9)) + "</ul>"
    said = "this one sentence of nine words is in both"
    own = lambda k, n: " ".join(f"w{k}x{i}" for i in range(n))
    article = own("a", 80)
    bodies = {
        1: [f"{own(1, 20)} {said} {own(11, 5)}"], 2: [f"{said} {own(2, 20)}"], 3: [own(3, 6), own(33, 12)],
        4: [article, "on monday"], 5: [article, "on tuesday"],
    }
    rows = [(k, f"http://h.org/{k}", menu + "".join(f"<p>{b}</p>" for b in body) + "<p>fin 2020</p>") for k, body in bodies.items()]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in html_extract.extract(df).collect()} == {k: "\n\n".join(body) for k, body in bodies.items()}


def test_urls(spark):
    urls = [
        "http://A.Example.org/es/x", "http://example.org/es", "https://m.example.org/en/12?q#f", "http://example.org/en/2", "http://x.com/fr/1", "http://x.com/de/", "http://spam-farm.example.com/x",
        "http://www.spam-farm.example.com/fr/x", "http://notspam-farm.example.net", "http://org", "http://org/", "http://xorg/", None, "", "no scheme", "://", "a://b#/c", "x?y=http://example.org/es/",
    ]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r["page_id"]: r for r in url_filter.url_report(spark, df).collect()}
    for i, u in enumerate(urls):
        m = re.search(r"://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fits = [r for r in url_filter.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
        rule = max(fits, key=len) if fits else None
        blocked = any(host == h or host.endswith("." + h) for h in url_filter.BLOCKED_HOSTS)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule), u
        assert got[i]["verdict"] == (url_filter.RULES[rule] if rule else "block" if blocked else "allow"), u
    assert url_filter.url_report(spark, df.limit(0)).count() == 0


def test_colliding_digests_do_not_decide(tmp_path, monkeypatch):
    monkeypatch.setattr(url_filter, "digest", lambda key: len(key))
    (tmp_path / "i").write_bytes(url_filter.encode_index([("a.b/", "block"), ("c.d/", "allow"), ("long.er/", "block")]))
    index = url_filter.UrlIndex(str(tmp_path / "i"))
    found = index.find(["c.d/", "x.y/", "a.b/", "none", "long.er/"])
    assert [index.text(i) if i >= 0 else None for i in found] == ["c.d/", None, "a.b/", None, "long.er/"]


@pytest.fixture(scope="module")
def lattice():
    return sentence_pieces.Lattice(sentence_pieces.load_vocabulary())


ODD = ["", None, "a", " ", "  x \n\n y ", "\u2581 z\x00\u00e9\U0001f600\u6f22\u5b57", "q" * 100 + "\u00e9" * 30, "\n", "tab\there", "<s> </s> <0x0A> <unk>"]


def test_pieces_round_trip_and_repeat(lattice):
    ids = lattice.encode_batch(ODD, list(range(len(ODD))))
    assert [lattice.decode(i.tolist()) for i in ids] == [t or "" for t in ODD]
    alone = [lattice.encode_batch([t], [k])[0].tolist() for k, t in enumerate(ODD)]
    assert alone == [i.tolist() for i in ids]  # whatever batch a row is in
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=sentence_pieces.DEFAULT_MODEL)
    assert model.decode(ids[4].tolist()) == ODD[4]


def test_samples_follow_the_lattice(lattice):
    n, word = 30000, "hand"
    got = collections.Counter(tuple(i.tolist()) for i in lattice.encode_batch([word] * n, list(range(n))))
    paths = {}

    def walk(left, weight, ids):
        if not left:
            paths[ids] = weight
        for k in range(1, len(left) + 1):
            if left[:k] in lattice.ids:
                walk(left[k:], weight * lattice.weights[left[:k]], (*ids, lattice.ids[left[:k]]))

    walk(" " + word, 1.0, ())
    total = sum(paths.values())
    for ids, weight in paths.items():
        p = weight / total
        assert got[ids] / n == pytest.approx(p, abs=5 * (p * (1 - p) / n) ** 0.5 + 1e-3)
    assert set(got) <= set(paths)


def test_passes_agree_for_few_and_many_and_in_small_slices(lattice, monkeypatch):
    texts = ["internationalization of words", "un mot", "aaaaaaaaabababababaaaabbbabab" * 40, "\u6f22\u5b57" * 300 + "abc" * 50]
    texts[0] += " " + " ".join("".join(random.Random(k).choice("aeioustnr") for _ in range(k)) for k in range(1, 60))
    want = [a.tolist() for a in lattice.encode_batch(texts, [1, 2, 3, 4])]
    assert [lattice.decode(i) for i in want] == texts
    for name, value in (("_FEW", 10**9), ("_FEW", 1), ("_SLICE", 16)):
        with monkeypatch.context() as m:
            m.setattr(sentence_pieces, name, value)
            assert [a.tolist() for a in lattice.encode_batch(texts, [1, 2, 3, 4])] == want, name


@pytest.mark.parametrize("n", [5, 18, 19, 24, 40, 400])
def test_many_unknown_characters_do_not_underflow(lattice, n):
    text = "\U0001f9ff" * n + "hand"
    got = [lattice.decode(i.tolist()) for i in lattice.encode_batch([text] * 20, list(range(20)))]
    assert set(got) == {text}
    tails = collections.Counter(len(i) for i in lattice.encode_batch([text] * 1000, list(range(1000))))
    assert tails.most_common(1)[0][1] > 900  # the word whole, as in a short text


def test_long_text_without_spaces_is_quick(lattice):
    import time

    rng = random.Random(3)
    for text in ("".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(100_000)), "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(33_000))):
        began = time.thread_time()
        ids = lattice.encode_batch([text], [1])[0]
        took = time.thread_time() - began
        assert lattice.decode(ids.tolist()) == text and took < 3, took


def test_pieces_on_spark(spark):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(ODD)] + [(None, "x", 1)], "doc_id long, text string, ids int")
    got = sentence_pieces.decode(sentence_pieces.encode(df)).collect()
    both = sentence_pieces.decode(sentence_pieces.encode(df, decoded=True), text_col="again")
    assert both.columns[-2:] == ["text", "again"] and both.filter("NOT text <=> again").count() == 0
    assert sentence_pieces.decode(sentence_pieces.encode(df, decoded=True)).columns == ["doc_id", "ids", "n_pieces", "lossless", "text"]
    assert all(r["lossless"] for r in got) and sorted(r["text"] for r in got) == sorted([*(t or "" for t in ODD), "x"])
    assert sentence_pieces.encode(df.limit(0)).count() == 0


def _article(blocks):
    return "<nav><a>home</a></nav><article>" + "".join(f"<p>{b}</p>" for b in blocks) + "</article>"


def test_repeats_of_half_a_host_leave_articles(spark):
    """Markup alone would keep what nothing marks; passages of fewer pages and copies stay."""
    own = lambda k, n: " ".join(f"w{k}x{i}" for i in range(n))
    plea = "please support our work by giving what you can to this site today"
    said = "a sentence of the king that three of these eight pages quote in full"
    bodies = {k: [f"Title {k}", own(k, 30), plea, own(k + 100, 20)] for k in range(8)}
    for k in range(3):
        bodies[k].insert(1, said)
    rows = [(k, f"http://h.org/{k}", _article(b)) for k, b in bodies.items()]
    rows += [(20 + k, "http://two.org/", _article([own(k, 20), plea])) for k in range(2)]  # on two pages only
    family = [own("f", 200), own("g", 100)]
    copies = {30 + k: [*family, f"version {k}"] for k in range(6)} | {40 + k: [own(k + 200, 30)] for k in range(4)}
    rows += [(k, "http://c.org/", _article(b)) for k, b in copies.items()]  # most pages are near copies of one
    seen = [*[own(k + 300, 30) for k in range(3)], own(303, 12)]
    rows += [(50, "http://d.org/", _article([seen[0], seen[3]]))] * 9 + [(51 + k, "http://d.org/", _article([seen[k], seen[3]])) for k in (1, 2)]
    rows += [(60 + k, "http://d.org/", _article([own(k + 400, 30)])) for k in range(4)]  # on three of seven, equal pages count once
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = {k: "\n\n".join(x for x in b if x != plea) for k, b in bodies.items()} | {k: "\n\n".join(b) for k, b in copies.items()}
    want |= {20 + k: f"{own(k, 20)}\n\n{plea}" for k in range(2)} | {50: f"{seen[0]}\n\n{seen[3]}"} | {51 + k: f"{seen[k]}\n\n{seen[3]}" for k in (1, 2)} | {60 + k: own(k + 400, 30) for k in range(4)}
    got = html_extract.extract(df).collect()
    assert len(got) == len(rows) and {r["page_id"]: r["text"] for r in got} == want


@pytest.mark.parametrize("at_once", [1, 60, 1 << 21])
def test_wide_repeats_against_brute_force(spark, monkeypatch, at_once):
    """Whatever parts of a host's pages tasks compare, equal pages in many of them."""
    monkeypatch.setattr(html_extract, "AT_ONCE", at_once)
    rng = random.Random(5)
    words = lambda tag, n: " ".join(f"{tag}{i}" for i in range(n))
    rows = []
    for k in range(60):
        parts = [words(f"p{k}", 12)] + [words(f"b{j}", 10) for j in range(6) if rng.random() < j / 7]
        rows += [(k, f"http://h{k % 4}.org/", _article(parts))] * rng.choice((1, 1, 1, 7))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    read = html_extract.materialise(df.mapInArrow(html_extract._read, html_extract._READ), "read")
    on, pages = collections.defaultdict(set), collections.defaultdict(set)
    for _, url, page in rows:
        main, loose, out, _ = html_extract.blocks(page)
        pages[url[7:-1]].add(page)
        for part in (main, loose, out):
            for key in html_extract.prefixes(html_extract._tokens(part)).tolist():
                on[url[7:-1], key].add(page)
    want = {key for key, held in on.items() if len(held) >= 3 and 2 * len(held) >= len(pages[key[0]])}
    _, wide = html_extract.wide_repeats(read)
    assert len(want) > 10 and {(r["host"], r["s"] & (2**64 - 1)) for r in wide.collect()} == want
