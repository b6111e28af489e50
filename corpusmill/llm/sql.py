"""DuckDB SQL for queries that SQL can express."""

from __future__ import annotations

from .quality import LINE_LIMIT, NGRAM_LIMITS, SYMBOL_LIMIT
from .substrings import WINDOW

_WORD = r"[^\x20\x09-\x0D]+"
_LAST = 9223372036854775807

#: Rows may repeat, so each gets a number of its own; words by position.
_WORDS = f"""docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
split AS (SELECT rid, doc_id, text, regexp_extract_all(text, '{_WORD}') AS ws FROM docs),
words AS (SELECT rid, doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM split)"""


def _grams(n: int, name: str) -> str:
    frame = f"(PARTITION BY rid ORDER BY pos ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING)"
    return f"""{name} AS (SELECT rid, doc_id, pos, array_to_string(l, ' ') AS gram FROM (
  SELECT rid, doc_id, pos, list(w) OVER {frame} AS l FROM words) WHERE len(l) = {n})"""


SUBSTRINGS = f"""WITH {_WORDS},
{_grams(WINDOW, "grams")},
low AS (SELECT gram, min(coalesce(doc_id, {_LAST})) AS low FROM grams GROUP BY 1),
hit AS (SELECT rid, pos FROM grams JOIN low USING (gram) WHERE low < coalesce(doc_id, {_LAST})),
gone AS (SELECT DISTINCT rid, pos + j AS pos FROM hit, (SELECT unnest(range({WINDOW})) AS j)),
kept AS (SELECT words.rid, string_agg(w, ' ' ORDER BY words.pos) AS kept, count(*) AS n FROM words ANTI JOIN gone USING (rid, pos) GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM split LEFT JOIN kept USING (rid)"""


def _covered(n: int) -> str:
    return f"""{_grams(n, f"g{n}")},
c{n} AS (SELECT rid, count(*) AS words, sum(length(w)) AS chars FROM words SEMI JOIN (
  SELECT DISTINCT rid, pos + j AS pos FROM (SELECT rid, pos, count(*) OVER (PARTITION BY rid, gram) AS k FROM g{n}), (SELECT unnest(range({n})) AS j) WHERE k > 1
) m USING (rid, pos) GROUP BY 1)"""


_SHARES = " AND ".join(f"dup_chars_{n} <= {limit}::DOUBLE * word_chars" for n, limit in NGRAM_LIMITS.items())

QUALITY = f"""WITH {_WORDS},
{", ".join(_covered(n) for n in NGRAM_LIMITS)},
lines AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM docs),
dups AS (SELECT rid, sum(k - 1)::BIGINT AS n, sum((k - 1) * length(regexp_replace(line, '[\\x20\\x09-\\x0D]', '', 'g')))::BIGINT AS chars FROM (
  SELECT rid, line, count(*) AS k FROM lines WHERE regexp_matches(line, '{_WORD}') GROUP BY 1, 2) GROUP BY 1),
measured AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(dups.n, 0)::BIGINT AS n_dup_lines,
  coalesce(c8.words, 0)::BIGINT AS n_repeat_words, coalesce(dups.chars, 0)::BIGINT AS dup_line_chars,
  {", ".join(f"coalesce(c{n}.chars, 0)::BIGINT AS dup_chars_{n}" for n in NGRAM_LIMITS)}
  FROM split LEFT JOIN dups USING (rid) {" ".join(f"LEFT JOIN c{n} USING (rid)" for n in NGRAM_LIMITS)}),
based AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM measured)
SELECT *, NOT base_failed AND {_SHARES} AND dup_line_chars <= {LINE_LIMIT}::DOUBLE * word_chars AND n_symbols <= {SYMBOL_LIMIT}::DOUBLE * n_words AS kept FROM based"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: All pairs with a common shingle, then the smallest reachable id by repeated relabelling over links.
NEAR_DUPLICATES = f"""WITH RECURSIVE docs AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') AS ws FROM documents),
words AS (SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos, least(5, len(ws)) AS n FROM docs),
shingles AS (SELECT DISTINCT rid, array_to_string(l, ' ') AS g FROM (
  SELECT rid, n, list(w) OVER (PARTITION BY rid ORDER BY pos ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS l FROM words) WHERE len(l) >= n),
sizes AS (SELECT rid, count(*) AS size FROM shingles GROUP BY 1),
pairs AS (SELECT a.rid AS x, b.rid AS y, count(*) AS common FROM shingles a JOIN shingles b ON a.g = b.g AND a.rid <> b.rid GROUP BY 1, 2),
links AS (SELECT DISTINCT d.doc_id AS u, e.doc_id AS v FROM pairs JOIN sizes s ON s.rid = x JOIN sizes t ON t.rid = y JOIN docs d ON d.rid = x JOIN docs e ON e.rid = y
  WHERE 100 * common >= 85 * (s.size + t.size - common) AND d.doc_id IS NOT NULL AND e.doc_id IS NOT NULL),
reach AS (SELECT DISTINCT u AS node, u AS label FROM links UNION SELECT v, label FROM reach JOIN links ON u = node),
comp AS (SELECT node, min(label) AS label FROM reach GROUP BY 1)
SELECT doc_id, coalesce(size, 0)::BIGINT AS n_shingles, coalesce(label, doc_id) AS component_id, coalesce(doc_id = coalesce(label, doc_id), true) AS kept
FROM docs LEFT JOIN sizes USING (rid) LEFT JOIN comp ON node = doc_id"""
