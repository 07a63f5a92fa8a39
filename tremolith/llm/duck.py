"""Pieces of DuckDB SQL that several oracles share."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shingles(name: str, source: str, key: str) -> str:
    """CTEs ``name``_words (key, w) and ``name`` (key, s): distinct shingles."""
    return f"""
{name}_words AS (
  SELECT {key}, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM {source}),
{name} AS (
  SELECT DISTINCT {key}, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS s
  FROM {name}_words)"""
