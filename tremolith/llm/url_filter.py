"""URL filters over a memory-mapped sorted digest array.

A list of rules (a host, then the start of a path: ``example.org/es/``) becomes
one file: the sorted 64-bit xxhash keys, each rule's verdict, and the rules
themselves.  Every Python worker memory-maps its copy, probes a batch of
candidate keys with one vectorised binary search, and confirms each hit against
the stored full string, so a colliding digest never decides.

A rule fits its host and all subdomains if the url's path starts with the
rule's path; the longest fitting rule wins (of equal length, the longer host).

Defined results: host is what follows the first ``://`` up to ``/``, ``?``,
``#`` or the end, with A-Z lower-cased; path follows up to ``?``, ``#`` or the
end.  A null url, or one without ``://``, has an empty host and path, fits no
rule and is allowed.  Repeated rows are judged alike; an empty table gives an
empty result; further columns are not read.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

from .storage import shared_dir, table, write_bytes

# The rules that must hold, and their verdicts.
RULES = {
    "org/": "allow",
    "example.org/es/": "block",
    "example.org/en/1": "block",
    "com/fr/": "allow",
    "com/de/": "block",
}
# Names of unwanted sites; each is listed under three domains.
UNWANTED = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
DOMAINS = ("example.com", "example.net", "example.org")
BLOCKED_HOSTS = tuple(f"{name}.{domain}" for name in UNWANTED for domain in DOMAINS)

SCHEMA = "page_id bigint, host string, path string, rule string, verdict string"
_URL = re.compile(r"://([^/?#]*)([^?#]*)", re.S)
_LOWER = {i: i + 32 for i in range(65, 91)}
_HEAD = 2  # words before the arrays: entries, bytes of strings


def digest(key: str) -> int:
    return xxhash.xxh64_intdigest(key.encode("utf-8", "surrogatepass"))


def encode_index(rules: Iterable[tuple[str, str]]) -> bytes:
    """The bytes of an index file; ``rules`` are (rule, verdict) pairs."""
    rows = sorted({r: v for r, v in rules}.items(), key=lambda rv: (digest(rv[0]), rv[0]))
    texts = [r.encode("utf-8", "surrogatepass") for r, _ in rows]
    ends = np.zeros(len(rows) + 1, np.uint64)
    np.cumsum([len(t) for t in texts], out=ends[1:])
    return b"".join(
        (
            np.array([len(rows), int(ends[-1])], np.uint64).tobytes(),
            np.array([digest(r) for r, _ in rows], np.uint64).tobytes(),
            ends.tobytes(),
            np.array([v == "block" for _, v in rows], np.uint8).tobytes(),
            b"".join(texts),
        )
    )


class UrlIndex:
    """A memory-mapped index file."""

    def __init__(self, path: str):
        raw = np.memmap(path, np.uint8, "r")
        n = int(raw[:8].view(np.uint64)[0])
        at = 8 * _HEAD
        self.keys = raw[at : at + 8 * n].view(np.uint64)
        at += 8 * n
        self.ends = raw[at : at + 8 * (n + 1)].view(np.uint64)
        at += 8 * (n + 1)
        self.block = raw[at : at + n]
        self.texts = raw[at + n :]
        rules = [self.text(i) for i in range(n)] if n <= 1 << 16 else None
        #: The lengths of the rules' paths; few, however long the list is.
        self.path_lengths = sorted({len(r) - r.index("/") for r in rules}) if rules is not None else self._lengths(n)

    def _lengths(self, n: int) -> list[int]:
        return sorted({len(t) - t.index("/") for t in map(self.text, range(n))})

    def text(self, i: int) -> str:
        return bytes(self.texts[int(self.ends[i]) : int(self.ends[i + 1])]).decode("utf-8", "surrogatepass")

    def find(self, keys: list[str]) -> np.ndarray:
        """For each key its entry, or -1."""
        out = np.full(len(keys), -1, np.int64)
        if not keys or not len(self.keys):
            return out
        wanted = np.fromiter(map(digest, keys), np.uint64, len(keys))
        at = np.searchsorted(self.keys, wanted)
        inside = np.flatnonzero(at < len(self.keys))
        hits = inside[self.keys[at[inside]] == wanted[inside]]
        for k in hits.tolist():
            i = int(at[k])
            while i < len(self.keys) and self.keys[i] == wanted[k]:  # full strings settle collisions
                if self.text(i) == keys[k]:
                    out[k] = i
                    break
                i += 1
        return out


def split_url(url: str | None) -> tuple[str, str]:
    m = _URL.search(url) if url else None
    return (m[1].translate(_LOWER), m[2]) if m else ("", "")


def candidates(host: str, path: str, lengths: list[int]) -> list[str]:
    """Every rule that could fit, longest first."""
    labels = host.split(".")
    hosts = [".".join(labels[i:]) for i in range(len(labels))]
    found = {h + path[:k] for h in hosts if h for k in lengths if 0 < k <= len(path)}
    return sorted(found, key=lambda r: (-len(r), r.index("/")))


def judge_urls(df: DataFrame, index: str, blocked: str, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``index`` and ``blocked`` name index files given to :func:`publish`: the
    rules, and the method's own blocked hosts (as rules ending in ``/``)."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules, own = UrlIndex(SparkFiles.get(index)), UrlIndex(SparkFiles.get(blocked))
        for batch in batches:
            split = [split_url(u) for u in batch.column(1).to_pylist()]
            fits = _longest(rules, split, lambda s: candidates(*s, rules.path_lengths))
            unwanted = _longest(own, split, lambda s: candidates(s[0], "/", [1]))
            verdict = [
                ("block" if rules.block[r] else "allow") if r >= 0 else ("block" if o >= 0 else "allow")
                for r, o in zip(fits, unwanted, strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(pa.int64()),
                    pa.array([h for h, _ in split], pa.string()),
                    pa.array([p for _, p in split], pa.string()),
                    pa.array([rules.text(r) if r >= 0 else None for r in fits], pa.string()),
                    pa.array(verdict, pa.string()),
                ],
                names=["page_id", "host", "path", "rule", "verdict"],
            )

    return df.select(id_col, url_col).mapInArrow(judge, SCHEMA)


def _longest(index: UrlIndex, split: list, keys_of) -> list[int]:
    keys, owner = [], []
    for i, s in enumerate(split):
        new = keys_of(s)
        keys += new
        owner += [i] * len(new)
    out = [-1] * len(split)
    for i, entry in zip(owner, index.find(keys).tolist(), strict=True):
        if entry >= 0 and out[i] < 0:
            out[i] = entry
    return out


def publish(spark: SparkSession, rules: Iterable[tuple[str, str]], tag: str) -> str:
    """Write an index to the shared folder and have every executor fetch it."""
    name = f"{tag}-{uuid.uuid4().hex[:12]}.urls"
    spark.sparkContext.addFile(write_bytes(spark, f"{shared_dir(spark)}/{name}", encode_index(rules)))
    return Path(name).name


def url_report(spark: SparkSession, pages: DataFrame) -> DataFrame:
    rules = publish(spark, RULES.items(), "rules")
    own = publish(spark, ((f"{h}/", "block") for h in BLOCKED_HOSTS), "hosts")
    return judge_urls(pages, rules, own)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_report(spark, table(spark, sf_dir, "pages"))


_VALUES = ", ".join(f"('{r.split('/', 1)[0]}', '/{r.split('/', 1)[1]}', '{r}', '{v}')" for r, v in RULES.items())
_HOSTS = ", ".join(f"('{h}')" for h in BLOCKED_HOSTS)
ORACLE = f"""
WITH rules(rule_host, rule_path, rule, verdict) AS (VALUES {_VALUES}),
own(blocked) AS (VALUES {_HOSTS}),
cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
  FROM cut),
fit AS (
  SELECT s.page_id, s.host, s.path, r.rule, r.verdict,
         row_number() OVER (PARTITION BY s.page_id ORDER BY length(r.rule) DESC, length(r.rule_host) DESC) AS turn
  FROM split s LEFT JOIN rules r ON (s.host = r.rule_host OR ends_with(s.host, '.' || r.rule_host)) AND starts_with(s.path, r.rule_path))
SELECT page_id, host, path, rule,
       coalesce(verdict, CASE WHEN EXISTS (SELECT 1 FROM own WHERE fit.host = blocked OR ends_with(fit.host, '.' || blocked)) THEN 'block' ELSE 'allow' END) AS verdict
FROM fit WHERE turn = 1
"""
