"""The text functions again, as DuckDB SQL, written on their own for the oracles."""

from __future__ import annotations

from lexiloom.functions.text import BAD_TITLES, BLANK, CLITICS, RESERVED, STOPWORDS, SUFFIXES, THEME_SEEDS


def quoted(words: list[str] | tuple[str, ...]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


STOP, SEEDS, NEVER, HEADS = quoted(STOPWORDS), quoted(THEME_SEEDS), quoted([*STOPWORDS, *RESERVED]), quoted(CLITICS)
BAD = "(?i)" + "|".join(BAD_TITLES).replace("'", "''")


def norm(x: str) -> str:
    return rf"regexp_replace(strip_accents(lower(trim({x}))), '^[^\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]+$', '', 'g')"


def canon(x: str) -> str:
    rules = " ".join(f"WHEN ends_with({x}, '{a}') AND length({x}) - {len(a)} >= 3 THEN left({x}, length({x}) - {len(a)}) || '{b}'" for a, b in SUFFIXES)
    return f"CASE WHEN length({x}) <= 3 OR {x} = 'pays' OR ends_with({x}, 'is') THEN {x} {rules} ELSE {x} END"


def web(x: str) -> str:
    return f"regexp_replace(replace(replace(strip_accents(lower({x})), 'œ', 'oe'), 'æ', 'ae'), '[^a-z0-9]', '', 'g')"


#: tok(doc_id, idx, part, norm, is_word, canon) of documents, by table expressions.
TOKENS = rf"""
parts AS (SELECT doc_id, regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]+|\s+') AS p FROM documents WHERE text IS NOT NULL),
pieces AS (SELECT doc_id, unnest(p) AS part, generate_subscripts(p, 1) - 1 AS idx FROM parts),
normed AS (SELECT doc_id, idx, part, {norm("part")} AS norm FROM pieces),
tok AS (SELECT doc_id, idx, part, norm, regexp_matches(norm, '[\p{{L}}\p{{N}}]') AS is_word, {canon("norm")} AS canon FROM normed),
content AS (SELECT doc_id, canon AS word, min(idx) AS pos FROM tok WHERE is_word AND length(canon) >= 3 GROUP BY ALL)
"""


def spelt(sql: str) -> str:
    """White space spelt out: in RE2 as in Java \\s is ASCII only."""
    return sql.replace(r"[^\p{L}\p{N}_\s]+|\s+", rf"[^\p{{L}}\p{{N}}_{BLANK}]+|[{BLANK}]+").replace(r"[^\s]+", f"[^{BLANK}]+")
