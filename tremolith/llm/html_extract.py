"""Main text of HTML pages by markup and by repeats on the host.

Each page is read once into blocks.  Blocks in a ``main`` element, articles in it
included, else in ``article`` elements, are its main text; scripts, styles, menus,
headers, footers, sidebars, notices, adverts, forms, reader comments and hidden
parts, known by element, role, class or id, never are.  A class or id marks a part
if it says nothing else: ``related-posts`` does, ``related-work`` does not, and
paragraphs, headings and table cells are never marked by it.  Pages without either
element go by the repeats of their host.

Repeats are looked for in the token streams of all pages of a host.  Suffixes are dealt out by their prefix of ``LONG`` tokens: those that
share it are an interval of the host's suffix array at that depth, and the
positions of all intervals with two or more pages are the repeats of ``LONG``
tokens and more.  That is all the removal asks, so no suffixes are sorted within
an interval and no longer common prefixes are computed.  Intervals are reduced
with partial aggregation, never gathered, so neither a host with a third of all
pages nor a footer on all of them burdens one task.

Pages without an article or main element lose whole blocks, never parts of one: a
block whose every token lies in long repeats, and a block under ``LONG`` tokens
that equals one of other pages.  Near copies (5-word shingles of main text and
loose blocks alike by op1's measure) count as one page.  A long repeat must be on
two such groups of pages and on 1/``SHARE`` of the host's, a short block on three
and on half.  Those of bare pages are repeats of blocks outside main texts.

Pages with one of the elements lose whole blocks of it too, by a stricter measure: every
token of the block lies in repeats of ``LONG`` tokens or more that half of the host's pages
have, anywhere in the page, and three of them at least, whether near copies count one by
one or as one page.  Passages that fewer articles share stay, and so do short blocks by
themselves, as headings are.  Which repeats half of the pages may have is found without
moving suffixes: each task compares its own pages, a part of a host's at a time, and what
half of them all have, half of some part has.  Only suffixes that such a repeat may begin,
by a bitmap, are dealt out, counted and decided.

Blocks: character references are decoded, white space becomes one space, ends
are trimmed, blocks join by an empty line in page order; nothing is capped.

Defined results: a null or empty html has an empty text; a null url has an empty
host; pages with equal html or near copies count as one page for repeats; repeated rows give a
row each; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bitmaps import bitmap_of, hits, unpacked
from .ngram_join import document_components
from .storage import materialise, table
from .words import list_column, mix, row_slices

#: Tokens of a long repeat; a repeat is on at least 1/SHARE of a host's pages.
LONG, SHARE = 8, 20
#: Suffixes of pages that a task compares at once; pages of a host that it keeps for the
#: next turn, since half of very few pages says little.
AT_ONCE, KEPT = 1 << 21, 32
# Elements by what they mean for the main text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg annotation annotation-xml".split())
OUTSIDE = frozenset("nav footer aside form dialog menu button fieldset head select datalist".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr math semantics mi mo mn ms mtext mrow mfrac msup msub msubsup msqrt mroot munder mover munderover mtable mtr mtd".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
# Words in a class or id that mark a part as no article text.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertisements adsense sponsor sponsored promo promotion promoted banner cookie cookies consent gdpr notice notices "
    "notification popup modal overlay newsletter subscribe subscription signup login signin social share sharing related recommended recommendations sidebar widget widgets "
    "menu navbar nav navigation breadcrumb breadcrumbs pagination pager footer header masthead copyright comment comments commentlist disqus reply replies respond search toolbar "
    "skip hidden outbrain taboola teaser".split()
)
# Words that may stand beside those without saying what else a part is.
NEUTRAL = frozenset(
    "area articles bar bars block body bottom box boxes btn button buttons col column container content cta form frame icon icons inner item items left lg link links list lower main md mobile nav "
    "news outer page pages panel popular post posts primary right row secondary section site slot sm stories sub tag tags text title top unit upper wrap wrapper zone".split()
)
#: Elements that hold running text: a class or id does not take them out.
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr table blockquote pre figure figcaption".split())
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([A-Za-z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_SPACE = re.compile(r"\s+")
_HOST = re.compile(r"://([^/?#]*)")


def _is_outside(name: str, attributes: str, in_article: bool) -> bool:
    if name in OUTSIDE or (name == "header" and not in_article):
        return True
    if not attributes or name in ("html", "body", "article", "main"):
        return False
    textual = name in TEXTUAL
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id"):
            for token in () if textual else _html.unescape(value).split():
                words = {w.lower() for w in _WORD.findall(token) if not w.isdigit()}
                if words & MARKS and words <= MARKS | NEUTRAL and not (in_article and words & MARKS == {"header"}):
                    return True
        elif (key == "role" and value.strip().lower() in ROLES) or key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
            return True
        elif key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


def blocks(page: str | None) -> tuple[list[str], list[str], list[str], bool]:
    """Of a page, in order: the blocks of its main text, the blocks that are
    neither that nor marked as outside, those marked as outside, and whether it
    has an article or main element at all."""
    kinds: dict[str, list[str]] = {"article": [], "main": [], "loose": [], "out": []}
    order: list[tuple[str, str]] = []
    stack: list[tuple[str, bool, str]] = []  # name, outside, region
    pieces: list[str] = []
    outside, region = False, "loose"
    seen = set()

    def flush() -> None:
        if pieces:
            text = _SPACE.sub(" ", _html.unescape("".join(pieces))).strip()
            pieces.clear()
            if text:
                order.append(("out" if outside else region, text))

    def restore() -> None:
        nonlocal outside, region
        outside, region = (stack[-1][1], stack[-1][2]) if stack else (False, "loose")

    at, page = 0, page or ""
    n = len(page)
    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            pieces.append(page[at:])
            break
        if m.start() > at:
            pieces.append(page[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            if m[0].startswith("<![CDATA["):
                pieces.append(m[0][9:].removesuffix("]]>").replace("&", "&amp;"))
            continue
        name = name.lower()
        if m[1]:
            if name not in INLINE:
                flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    if outside != (k > 0 and stack[k - 1][1]):  # a marked inline part ends
                        flush()
                    del stack[k:]
                    restore()
                    break
                if name in INLINE and stack[k][0] not in INLINE:
                    break
            continue
        if name == "br":
            pieces.append(" ")
            continue
        if name in VOID:
            if name == "hr":
                flush()
            continue
        if name in RAW:
            if m[3].rstrip().endswith("/") and name in ("svg", "math", "iframe", "object"):
                continue
            close = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = close.end() if close else n
            continue
        if name in INLINE:
            out = outside or _is_outside(name, m[3], region != "loose")
            if out != outside:  # an inline part that is marked stands by itself
                flush()
            stack.append((name, out, region))
            outside = out
            continue
        flush()
        if name not in ("option", "optgroup"):  # a list of options that was not closed
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in ("select", "datalist"):
                    del stack[k:]
                    break
        if stack and stack[-1][0] == "p":
            stack.pop()
        elif any(s[0] == "p" for s in stack[-8:]) and all(s[0] in INLINE or s[0] == "p" for s in stack[max(k for k, s in enumerate(stack) if s[0] == "p") :]):
            del stack[max(k for k, s in enumerate(stack) if s[0] == "p") :]
        if name in ("li", "dt", "dd", "tr", "td", "th", "option") and stack and stack[-1][0] == name:
            stack.pop()
        restore()
        if name in ("article", "main") and not outside:
            seen.add(name)
            region = name if region == "loose" else region if region == "main" else name
        out = outside or _is_outside(name, m[3], region != "loose")
        stack.append((name, out, region))
        outside = out
    flush()
    for kind, text in order:
        kinds[kind].append(text)
    main = "main" if kinds["main"] or "article" not in seen else "article"
    if not seen:
        return [], kinds["loose"], kinds["out"], False
    other = kinds["article"] if main == "main" else []
    return kinds[main], [], kinds["loose"] + other + kinds["out"], True


def _tokens(parts: list[str]) -> np.ndarray:
    words = " ".join(parts).encode("utf-8", "surrogatepass").split(b" ") if parts else []  # blocks have no other white space
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def prefixes(tokens: np.ndarray) -> np.ndarray:
    """The hash, an even number, of the first LONG tokens of each suffix that has as many."""
    n = len(tokens) - LONG + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, LONG, np.uint64)
    for j in range(LONG):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + tokens[j : j + n])
    return h & ~np.uint64(1)


def short_blocks(parts: list[str]) -> np.ndarray:
    """The hash, an odd number, of each block; 0 for one of LONG tokens or more."""
    return np.fromiter((xxhash.xxh3_64_intdigest(p.encode("utf-8", "surrogatepass")) | 1 if len(p.split()) < LONG else 0 for p in parts), np.uint64, len(parts))


def keys_of(parts: list[str]) -> np.ndarray:
    short = short_blocks(parts)
    return np.concatenate([prefixes(_tokens(parts)), short[short != 0]])


def own_blocks(parts: list[str], repeated: set[int]) -> list[str]:
    """The blocks but those that repeats cover from end to end."""
    wanted = np.fromiter(repeated, np.uint64, len(repeated))
    keys = prefixes(_tokens(parts))
    covered = np.zeros(sum(len(p.split()) for p in parts), bool)
    for i in np.flatnonzero(np.isin(keys, wanted)).tolist():
        covered[i : i + LONG] = True
    out, at = [], 0
    for part, known in zip(parts, np.isin(short_blocks(parts), wanted).tolist(), strict=True):
        n = len(part.split())
        if not known and not covered[at : at + n].all():
            out.append(part)
        at += n
    return out


_READ = "page_id bigint, url string, host string, page bigint, main array<string>, loose array<string>, found boolean, suffixes array<bigint>"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in row_slices(whole, 256)):
        mains, looses, found, keys, digests, hosts = [], [], [], [], [], []
        for url, page in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            main, loose, out, has = blocks(page)
            m = _HOST.search(url or "")
            hosts.append(m[1].lower() if m else "")
            digests.append(xxhash.xxh3_64_intdigest((page or "").encode("utf-8", "surrogatepass")))
            mains.append(main)
            looses.append(loose)
            found.append(has)
            keys.append(np.unique(np.concatenate([keys_of(loose), keys_of(out)])))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0), batch.column(1), pa.array(hosts, pa.string()), pa.array(np.array(digests, np.uint64).view(np.int64)),
                pa.array(mains, pa.list_(pa.string())), pa.array(looses, pa.list_(pa.string())), pa.array(found), list_column(keys, pa.int64()),
            ],
            names=["page_id", "url", "host", "page", "main", "loose", "found", "suffixes"],
        )


def _page_keys(batch: pa.RecordBatch) -> list[np.ndarray]:
    """The keys of long prefixes anywhere in each page, of ``main, suffixes``."""
    tokens = [_tokens(main) for main in batch.column(batch.schema.get_field_index("main")).to_pylist()]
    at = np.cumsum([0] + [len(t) for t in tokens]).tolist()
    inside = prefixes(np.concatenate(tokens)) if tokens else None
    other = batch.column(batch.schema.get_field_index("suffixes"))
    ends, flat = other.offsets.to_numpy().tolist(), other.values.to_numpy().view(np.uint64)
    outside = [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
    return [np.concatenate((inside[a : max(a, b - LONG + 1)], o[o & np.uint64(1) == 0])) for a, b, o in zip(at[:-1], at[1:], outside, strict=True)]


def _half_here(batches: Iterator[pa.RecordBatch], at_once: int) -> Iterator[pa.RecordBatch]:
    """Of ``host, copies, main, suffixes``: the keys ``s`` that half of a host's pages of a part
    have, equal pages counting as one over all parts."""
    held: dict[str, list[tuple[np.ndarray, float]]] = {}
    size = 0

    def found(keep: int) -> pa.RecordBatch:
        nonlocal size
        out, kept = [np.zeros(0, np.uint64)], {}
        for host, pages in held.items():
            part = pages[: len(pages) - keep] if len(pages) >= 2 * keep else []
            if len(part) < len(pages):
                kept[host] = pages[len(part) :]
            if part:
                keys = np.concatenate([k for k, _ in part])
                weights = np.array([w for _, w in part])
                order = np.argsort(keys)
                keys = keys[order]
                first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))[: len(keys)])
                n = np.add.reduceat(np.repeat(weights, [len(k) for k, _ in part])[order], first) if len(first) else np.zeros(0)
                out.append(keys[first][2 * n >= weights.sum() - 1e-6])
        held.clear()
        held.update(kept)
        size = sum(len(k) for pages in kept.values() for k, _ in pages)
        return pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(out)).view(np.int64))], names=["s"])

    for batch in (part for whole in batches for part in row_slices(whole, 256)):
        for host, copies, keys in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _page_keys(batch), strict=True):
            keys = np.unique(keys)
            held.setdefault(host, []).append((keys, 1 / copies))
            size += len(keys)
        if size >= at_once:
            yield found(KEPT)
            if 2 * size >= at_once:  # many hosts of few pages
                yield found(0)
    yield found(0)


def wide_repeats(read: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """``host, page, s`` of keys that may be wide, and ``host, s`` of those that are: on half
    of a host's pages and on three; None if there are none."""
    copies = materialise(read.groupBy("host", "page").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1"), "copies")
    once = read.join(copies, ["host", "page"], "left").select("host", F.coalesce("copies", F.lit(1)).alias("copies"), "main", "suffixes")
    at_once = AT_ONCE
    near = materialise(once.mapInArrow(lambda batches: _half_here(batches, at_once), "s bigint"), "near")
    if near.isEmpty():
        return None
    bits = bitmap_of(near, "s")

    def of_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = unpacked(bits)
        for batch in (part for whole in batches for part in row_slices(whole, 256)):
            kept = [keys[hits(some, keys)] for keys in _page_keys(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), list_column(kept, pa.int64())], names=["host", "page", "suffixes"])

    rows = read.select("host", "page", "main", "suffixes").mapInArrow(of_pages, "host string, page bigint, suffixes array<bigint>")
    rows = materialise(rows.select("host", "page", F.explode("suffixes").alias("s")).distinct(), "suffixes")
    held = read.groupBy("host").agg(F.count_distinct("page").alias("held"))
    wide = rows.groupBy("host", "s").agg(F.count(F.lit(1)).alias("n")).filter("n >= 3").join(held, "host").filter("2 * n >= held")
    wide = materialise(wide.select("host", "s"), "wide")
    return None if wide.isEmpty() else (rows, wide)


def page_groups(pages: DataFrame) -> DataFrame:
    """``page, group``: pages that are near copies have one group."""
    texts = pages.select("page", F.concat_ws(" ", "main", "loose").alias("text")).dropDuplicates(["page"])
    found = document_components(texts, "page", "text")
    return materialise(found.select(F.col("id").alias("page"), F.col("component_id").alias("group")).distinct(), "groups")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``page_id, url, text`` of ``page_id, url, blocks, repeated``."""
    for batch in batches:
        kept = []
        for parts, repeated in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            parts = own_blocks(parts, {k & (2**64 - 1) for k in repeated}) if repeated else parts
            kept.append("\n\n".join(parts))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(kept, pa.string())], names=["page_id", "url", "text"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text`` of every page."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    read = materialise(rows.mapInArrow(_read, _READ), "pages")
    found, bare = read.filter("found"), read.filter("NOT found")
    marked = found.select("page_id", "url", F.array_join("main", "\n\n").alias("text"))
    wide = wide_repeats(read)
    hosts = bare.select("host").distinct()
    hosts = materialise(hosts.union(wide[1].select("host")).distinct() if wide else hosts, "hosts")
    if hosts.isEmpty():
        return marked
    pages = read.join(hosts, "host", "left_semi")
    groups = page_groups(pages)
    placed = pages.select("host", "page").distinct().join(groups, "page")
    held = materialise(placed.groupBy("host").agg(F.count_distinct("group").alias("held")), "held")
    schema = "page_id bigint, url string, text string"

    def hits_of(suffixes: DataFrame, intervals: DataFrame) -> DataFrame:
        met = suffixes.join(intervals.select("host", "s"), ["host", "s"])
        return met.groupBy("host", "page").agg(F.collect_set("s").alias("repeated"))

    if wide:
        suffixes = wide[0].join(wide[1], ["host", "s"], "left_semi")
        intervals = suffixes.join(groups, "page").groupBy("host", "s").agg(F.count_distinct("group").alias("n")).join(held, "host").filter("n >= 3 AND 2 * n >= held")
        left = found.join(hits_of(suffixes, intervals), ["host", "page"], "left").select("page_id", "url", "main", "repeated")
        marked = left.mapInArrow(_cut, schema)
    # Only prefixes that a page without marked main text has can matter to it.
    asked = bare.select("host", F.explode("suffixes").alias("s")).distinct()
    every = pages.select("host", "page", F.explode("suffixes").alias("s")).join(asked, ["host", "s"], "left_semi").join(groups, "page")
    intervals = every.groupBy("host", "s").agg(F.count_distinct("group").alias("n")).join(held, "host")
    short = F.col("s").bitwiseAND(1) == 1
    intervals = intervals.filter(F.when(short, (F.col("n") >= 3) & (2 * F.col("n") >= F.col("held"))).otherwise((F.col("n") >= 2) & (SHARE * F.col("n") >= F.col("held"))))
    hits_in = hits_of(bare.select("host", "page", F.explode("suffixes").alias("s")), intervals)
    left = bare.join(hits_in, ["host", "page"], "left").select("page_id", "url", "loose", "repeated")
    return marked.unionByName(left.mapInArrow(_cut, schema))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.char_length("text").cast("long"))
