"""Quality rules, lines first: failing lines are removed, then documents that lost too much are rejected.

Words are ``[^\\x20\\x09-\\x0D]+``.  A line with words fails by

* navigation: fewer than ``MENU_WORDS`` words and no closing mark at its end, or at least
  ``SEPARATOR_SHARE`` percent as many separators as words;
* punctuation: no closing mark at its end, or more than ``SYMBOL_SHARE`` percent of its characters are symbols;
* boilerplate: it contains one of ``BOILERPLATE`` (A-Z in lower case).

A document is rejected if it fails the base rules, if nothing is left of it, or if the removed lines held more
than ``LOST_SHARE`` percent of its word characters.
"""

from __future__ import annotations

from collections import Counter

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import ASCII_LOWER, utf8

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
SEPARATORS = "|>»›·•"
#: what may end a line: marks that end a sentence in any script, and what may follow them
CLOSING = "".join(regex.findall(
    r"\p{Sentence_Terminal}|\p{Pe}|\p{Pf}|\p{Pi}|[:;…\"'：；]", "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))))
_CLOSING = frozenset(CLOSING)
MENU_WORDS, SEPARATOR_SHARE, SYMBOL_SHARE, LOST_SHARE = 3, 20, 10, 30
LEAST_WORDS, REPEAT_SHARE, WINDOW = 10, 20, 5
BOILERPLATE = (
    "accept cookies", "all rights reserved", "click here", "cookie policy", "enable javascript", "lorem ipsum",
    "powered by", "privacy policy", "sign up", "skip to content", "subscribe to", "terms of use",
)

_KIND = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
         "n_lines long, n_navigation long, n_punctuation long, n_boilerplate long, lost_chars long, kept boolean, "
         "cleaned string")
_COLUMNS = [c.split()[0] for c in _KIND.split(", ")]


def _characters(text: str) -> int:
    """Code points that are not blanks."""
    return len(text) - sum(map(text.count, BLANKS))


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a window of ``WINDOW`` words found twice or more."""
    windows = list(zip(*(words[k:] for k in range(WINDOW))))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    covered = end = 0
    for at, window in enumerate(windows):
        if counts[window] > 1:
            covered += at + WINDOW - max(at, end)
            end = at + WINDOW
    return covered


def line_verdict(line: str, n_words: int) -> str | None:
    """The rule that a line with words fails, or None."""
    closed = line.rstrip(BLANKS)[-1] in _CLOSING
    if (n_words < MENU_WORDS and not closed) or 100 * sum(map(line.count, SEPARATORS)) >= SEPARATOR_SHARE * n_words:
        return "navigation"
    if not closed or 100 * sum(map(line.count, SYMBOLS)) > SYMBOL_SHARE * _characters(line):
        return "punctuation"
    lower = utf8(line).translate(ASCII_LOWER).decode("utf-8", "surrogatepass")
    return "boilerplate" if any(phrase in lower for phrase in BOILERPLATE) else None


def judge(text: str | None) -> tuple:
    """All results for one text; null counts as empty."""
    text = text or ""
    words = utf8(text).split()
    characters = _characters(text)
    seen: set[str] = set()
    failed = Counter()
    n_lines = duplicates = lost = 0
    left = []
    for line in text.split("\n"):
        n = len(utf8(line).split())
        if n == 0:
            continue
        n_lines += 1
        duplicates += line in seen
        seen.add(line)
        verdict = line_verdict(line, n)
        if verdict:
            failed[verdict] += 1
            lost += _characters(line)
        else:
            left.append(line)
    repeated = repeated_words(words)
    base = len(words) < LEAST_WORDS or 100 * repeated > REPEAT_SHARE * len(words)
    kept = not base and bool(left) and 100 * lost <= LOST_SHARE * characters
    return (len(words), characters, sum(map(text.count, SYMBOLS)), duplicates, repeated, base, n_lines,
            failed["navigation"], failed["punctuation"], failed["boilerplate"], lost, kept, "\n".join(left))


def clean_lines(docs: DataFrame, text: str = "text", name: str = "rules") -> DataFrame:
    """``docs`` with a struct column ``name``: counts, verdicts and the cleaned text.

    Null and empty texts have no words and fail the base rules; ``cleaned`` is then empty.
    """

    @F.pandas_udf(_KIND)
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([judge(t) for t in texts], columns=_COLUMNS)

    return docs.withColumn(name, run(F.col(text)))


def oracle() -> str:
    """DuckDB SQL for the counts and verdicts."""
    word = "[^\\x20\\x09-\\x0D]+"
    blank = "[\\x20\\x09-\\x0D]"
    quoted = SYMBOLS.replace("|", "\\|").replace("$", "\\$").replace("*", "\\*")
    closing = "".join("\\" * (c in "])}.?") + c for c in CLOSING).replace("'", "''")
    boiler = " OR ".join(f"contains(low, '{p}')" for p in BOILERPLATE)
    return f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, regexp_extract_all(text, '{word}') AS w FROM t),
win AS (SELECT r, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS k
  FROM (SELECT r, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM w WHERE len(w) >= {WINDOW})),
often AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS n FROM win) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT i + j) AS n FROM often, (SELECT unnest(range(0, {WINDOW})) AS j) GROUP BY r),
l0 AS (SELECT r, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM t),
l1 AS (SELECT *, len(regexp_extract_all(line, '{word}')) AS n, length(regexp_replace(line, '{blank}', '', 'g')) AS c,
    lower(line) AS low, row_number() OVER (PARTITION BY r, line ORDER BY i) AS nth,
    regexp_matches(line, '[{closing}]{blank}*$') AS closed,
    len(regexp_extract_all(line, '[{quoted}]')) AS sym, len(regexp_extract_all(line, '[{SEPARATORS}]')) AS sep
  FROM l0),
l2 AS (SELECT *, CASE WHEN (n < {MENU_WORDS} AND NOT closed) OR 100 * sep >= {SEPARATOR_SHARE} * n THEN 'n'
    WHEN NOT closed OR 100 * sym > {SYMBOL_SHARE} * c THEN 'p' WHEN {boiler} THEN 'b' END AS fail FROM l1 WHERE n > 0),
l AS (SELECT r, count(*) AS n_lines, count(*) FILTER (nth > 1) AS n_dup, count(*) FILTER (fail = 'n') AS n_nav,
    count(*) FILTER (fail = 'p') AS n_pun, count(*) FILTER (fail = 'b') AS n_boi,
    coalesce(sum(c) FILTER (fail IS NOT NULL), 0) AS lost, count(*) FILTER (fail IS NULL) AS good FROM l2 GROUP BY r),
a AS (SELECT t.doc_id, CAST(len(w.w) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '{blank}', '', 'g')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(text, '[{quoted}]')) AS BIGINT) AS n_symbols, coalesce(n_dup, 0) AS n_dup_lines,
    coalesce(rep.n, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, coalesce(n_nav, 0) AS n_navigation,
    coalesce(n_pun, 0) AS n_punctuation, coalesce(n_boi, 0) AS n_boilerplate,
    CAST(coalesce(lost, 0) AS BIGINT) AS lost_chars, coalesce(good, 0) AS good
  FROM t JOIN w USING (r) LEFT JOIN rep USING (r) LEFT JOIN l USING (r)),
b AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {REPEAT_SHARE} * n_words AS base_failed FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_lines, n_navigation,
  n_punctuation, n_boilerplate, lost_chars,
  NOT base_failed AND good > 0 AND 100 * lost_chars <= {LOST_SHARE} * word_chars AS kept
FROM b"""
