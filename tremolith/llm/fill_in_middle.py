"""Fill-in-the-middle transformation of documents, and its exact inverse.

A text is cut into a prefix, a middle and a suffix at two of its units' ends, and
the parts are put in the order that a model is to learn: ``psm`` is
``<P>prefix<S>suffix<M>middle``, ``spm`` is ``<S>suffix<P>prefix<M>middle`` and
``plain`` the text as it is.  The regex library finds the units: finditer walks
the text in runs of RUN units, and the ends of each run's repeated capture go to
a compact array, whose length is the number of units; two look-ups in it give
the cuts.  A row's seed is the hex sha256 of ``salt:id`` alone, so a row gets the
same form wherever and however often it is computed.

All of this is a pandas UDF over Arrow batches, row by row: no shuffle, and
nothing is held but one batch and one text's array (4 bytes a unit).

A text that holds one of the three marks stays plain, so the marks in an output
are the operator's own; as no mark can begin within another (``<`` comes first
only), the first ``<S>``, ``<P>`` or ``<M>`` after a part is where the part ends.

Defined results: null and empty texts are plain with no units; a null id is
seeded like an empty one; equal rows give equal rows; texts that the units don't
cover (a pattern of one's own) keep what lies after the last cut in the suffix;
an empty table gives an empty result; further columns are kept, whatever their
names.
"""

from __future__ import annotations

from array import array
from hashlib import sha256

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .storage import table

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: What units may be: a code point, a word with the space before it, a line.
UNITS = {"code point": r"(?s:.)", "word": r"\s*\S+", "line": r"[^\n]*\n|[^\n]+"}
#: Of a hundred texts those that are cut, and of a hundred cut ones those in spm.
CUT_PERCENT, SPM_PERCENT = 90, 20
#: Units that one match takes.
RUN = 256

_CUT = "n long, form string, prefix_chars long, middle_chars long, output string"


def unit_ends(text: str, unit: regex.Pattern) -> array:
    """The end of each unit of a text; ``unit`` is a pattern of :func:`unit_pattern`."""
    ends = array("I" if len(text) < 1 << 32 else "Q")
    for found in unit.finditer(text):
        ends.extend(found.ends(1))
    return ends


def unit_pattern(unit: str = "code point") -> regex.Pattern:
    """Runs of units, each of them a capture of group 1; ``unit`` is one of UNITS or
    a pattern that has no groups and matches at least one code point."""
    return regex.compile(f"({UNITS.get(unit, unit)}){{1,{RUN}}}+")


def numbers(key: object, salt: str = "1") -> list[int]:
    """The first four 32-bit numbers of a row's seed."""
    seed = sha256(f"{salt}:{'' if key is None else key}".encode()).hexdigest()
    return [int(seed[8 * k : 8 * k + 8], 16) for k in range(4)]


def cut(text: str, key: object, unit: regex.Pattern, salt: str = "1", cut_percent: int = CUT_PERCENT, spm_percent: int = SPM_PERCENT) -> tuple[int, str, int | None, int | None, str]:
    """The units of a text, its form, the code points of prefix and middle, and the
    output."""
    ends = unit_ends(text, unit)
    n = len(ends)
    h1, h2, h3, h4 = numbers(key, salt)
    if not text or h3 % 100 >= cut_percent or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    first, last = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (ends[k - 1] if k else 0 for k in (first, last))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm_percent:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def restored(output: str, form: str) -> str:
    """The text that an output was made of, from output and form alone."""
    if form == "plain":
        return output
    lead, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    at = output.index(second, len(lead))
    end = output.index(MIDDLE, at + len(second))
    one, two, middle = output[len(lead) : at], output[at + len(second) : end], output[end + len(MIDDLE) :]
    return one + middle + two if form == "psm" else two + middle + one


def cut_column(key: Column, text: Column, unit: str = "code point", salt: str = "1", cut_percent: int = CUT_PERCENT, spm_percent: int = SPM_PERCENT, digests: bool = False) -> Column:
    """A struct of n, form, prefix_chars, middle_chars and output; with ``digests``
    the output is not returned but the sha256 of it and of the text rebuilt from it
    (output_sha256, restored_sha256)."""

    @pandas_udf(_CUT if not digests else _CUT.replace("output string", "output_sha256 string, restored_sha256 string"))
    def of(keys: pd.Series, texts: pd.Series) -> pd.DataFrame:
        pattern = unit_pattern(unit)
        rows = []
        for k, t in zip(keys, texts, strict=True):
            n, form, a, b, out = cut(t or "", k, pattern, salt, cut_percent, spm_percent)
            rows.append((n, form, a, b, *((_digest(out), _digest(restored(out, form))) if digests else (out,))))
        names = ["n", "form", "prefix_chars", "middle_chars", *(("output_sha256", "restored_sha256") if digests else ("output",))]
        whole = pd.DataFrame(rows, columns=names)
        return whole.astype({c: "Int64" for c in ("n", "prefix_chars", "middle_chars")})

    return of(key.cast("string"), text)


def restored_column(output: Column, form: Column) -> Column:
    """The texts that outputs were made of."""

    @pandas_udf("string")
    def of(outputs: pd.Series, forms: pd.Series) -> pd.Series:
        return pd.Series([None if o is None else restored(o, f) for o, f in zip(outputs, forms, strict=True)], dtype=object)

    return of(output, form)


def _digest(text: str) -> str:
    return sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``row`` (all columns of the input) and ``n, form, prefix_chars, middle_chars,
    output``; ``options`` are those of :func:`cut_column`."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    made = docs.select(row, cut_column(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"), **options).alias("made"))
    return made.select("row", "made.*")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"), digests=True)
    return made.select("row.doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


ORACLE = f"""
WITH seeds AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
drawn AS (
  SELECT doc_id, t, length(t) AS n, {", ".join(f"CAST('0x' || substr(h, {8 * k + 1}, 8) AS BIGINT) AS h{k + 1}" for k in range(4))} FROM seeds),
formed AS (
  SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t
              WHEN 'psm' THEN '<P>' || substr(t, 1, a) || '<S>' || substr(t, b + 1) || '<M>' || substr(t, a + 1, b - a)
              ELSE '<S>' || substr(t, b + 1) || '<P>' || substr(t, 1, a) || '<M>' || substr(t, a + 1, b - a) END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM formed
"""
