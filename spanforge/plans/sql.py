"""Shared pieces of the DuckDB statements."""

from __future__ import annotations

SP = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def pieces(table: str = "documents", keep: str = "doc_id, source", text: str = "text") -> str:
    """Sentences of 8 to 120 characters: keep, pos, text."""
    return rf"""
pieces AS (
  SELECT {keep}, unnest(range(0, len(l))) AS pos, trim(regexp_replace(unnest(l), '{SP}', ' ', 'g'), ' ') AS text
  FROM (SELECT {keep}, regexp_split_to_array(regexp_replace(coalesce({text}, ''), '([。！？!?；;])', '\1' || chr(10), 'g'), '[\r\n]+') AS l FROM {table})
),
sentences AS (SELECT * FROM pieces WHERE length(text) BETWEEN 8 AND 120)"""


DISTINCT = """
firsts AS (
  SELECT text, sha256(text)[1:16] AS sid, sha256('documents:' || min(doc_id)::VARCHAR)[1:16] AS group_id FROM sentences GROUP BY text
)"""

#: Part-name words and frequent tokens of four to twelve letters.
LEXICON = """
lexicon AS (
  SELECT DISTINCT word FROM (
    SELECT unnest(string_split(p_name, ' ')) AS word FROM part
    UNION ALL
    SELECT word FROM (SELECT unnest(string_split(text, ' ')) AS word FROM firsts) WHERE regexp_full_match(word, '[A-Za-z]{4,12}') GROUP BY word HAVING count(*) >= 20
  ) WHERE length(word) BETWEEN 2 AND 12
)"""

MATCHES = """
starts AS (SELECT sid, text, unnest(range(0, length(text) - 1))::INT AS start FROM firsts),
spans AS (SELECT sid, text, start, unnest(range(2, least(12, length(text) - start) + 1))::INT AS n FROM starts),
matches AS (SELECT s.sid, s.text, s.start, s.start + s.n AS "end", l.word FROM spans s JOIN lexicon l ON substring(s.text, s.start + 1, s.n) = l.word)"""


def base(*more: str) -> str:
    return "WITH RECURSIVE " + ",".join([pieces(), DISTINCT, *more])


def class_of(c: str, cp: str) -> str:
    return f"""CASE WHEN {c} LIKE '<%' THEN {c}
  WHEN {cp} BETWEEN 13312 AND 40959 OR {cp} BETWEEN 131072 AND 191471 THEN 'HAN'
  WHEN {cp} BETWEEN 48 AND 57 OR {cp} BETWEEN 65296 AND 65305 THEN 'DIGIT'
  WHEN {cp} BETWEEN 65 AND 90 OR {cp} BETWEEN 97 AND 122 THEN 'LATIN'
  WHEN regexp_full_match({c}, '{SP}') THEN 'SPACE'
  WHEN {cp} < 128 OR {cp} IN (161, 167, 171, 182, 183, 187, 191) OR {cp} BETWEEN 8208 AND 8231 OR {cp} BETWEEN 12289 AND 12291 OR {cp} BETWEEN 12296 AND 12305 OR {cp} BETWEEN 65281 AND 65295 THEN 'PUNCT'
  ELSE 'OTHER' END"""


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def fnv(name: str, column: str) -> str:
    """hashed (column, hash): FNV-1a of the column of a table."""
    return f"""fnv_bytes AS (SELECT DISTINCT {column}, encode({column}) AS e FROM {name}),
fnv_list AS (SELECT {column}, list_transform(range(1, octet_length(e) + 1), lambda i: ('0x' || hex(e)[2 * i - 1 : 2 * i])::HUGEINT) AS l FROM fnv_bytes),
hashed AS (SELECT {column}, list_reduce(list_concat([14695981039346656037::HUGEINT], l), lambda h, x: ((((h - h % 256) + xor((h % 256), x)) * 435) % 18446744073709551616::HUGEINT + ((((h - h % 256) + xor((h % 256), x)) % 16777216) * 1099511627776)) % 18446744073709551616::HUGEINT) AS hash FROM fnv_list)"""
