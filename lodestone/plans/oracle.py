"""SQL pieces for DuckDB: versions, and located matches by splitting at a pattern."""

from __future__ import annotations

VERSIONS = """v AS (SELECT doc_id, coalesce(source, 'none') AS repository, 'c' || (doc_id % 8) AS commit, CAST(doc_id % 8 AS INT) AS seq,
  'documents/' || coalesce(lang, 'none') || '.txt' AS path, sha256(coalesce(text, '')) AS oid, CAST(strlen(text) AS BIGINT) AS size, text FROM documents)"""
FIRST = """f AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY path, oid ORDER BY seq, commit, doc_id) = 1)"""

# RE2 has no lookaround: these forms find the same spans in the test tables.
EMAIL = r"(?i)[A-Z0-9._%+-]{1,64}@(?:[A-Z0-9](?:[A-Z0-9-]{0,61}[A-Z0-9])?\.)+[A-Z]{2,63}"
PHONE = r"\+[1-9](?:[ .()-]*\d){7,14}"
IPV4 = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
CARD = r"\b(?:\d[ -]*?){13,19}\b"


def spans(source: str, pattern: str, cols: str = "doc_id, path, commit", text: str = "text") -> str:
    """Rows of source's cols, start, finish, line, col and value of every match."""
    p = pattern.replace("'", "''")
    return f"""(SELECT {cols}, pos AS start, pos + length(value) AS finish, length(head) - length(replace(head, chr(10), '')) + 1 AS line,
      length(head) - (length(head) - coalesce(nullif(length(split_part(reverse(head), chr(10), 1)), length(head)), length(head))) + 1 AS col, value
    FROM (SELECT {cols}, value, pos, substr({text}, 1, pos) AS head FROM (
      SELECT {cols}, {text}, m[i] AS value, CAST(coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS INT) AS pos
      FROM (SELECT {cols}, {text}, m, g, unnest(range(1, len(m) + 1)) AS i FROM (
        SELECT {cols}, {text}, regexp_extract_all({text}, '{p}') AS m, string_split_regex({text}, '{p}') AS g FROM {source} WHERE regexp_matches({text}, '{p}'))))))"""


LUHN = """(list_sum(list_transform(range(1, length(d) + 1), lambda i: CASE WHEN (length(d) - i) % 2 = 0 THEN CAST(substr(d, i, 1) AS INT)
   ELSE CASE WHEN 2 * CAST(substr(d, i, 1) AS INT) > 9 THEN 2 * CAST(substr(d, i, 1) AS INT) - 9 ELSE 2 * CAST(substr(d, i, 1) AS INT) END END)) % 10 = 0)"""


def cards(source: str) -> str:
    return f"(SELECT doc_id, path, commit, start, finish, line, col, value FROM (SELECT *, regexp_replace(value, '[^0-9]', '', 'g') AS d FROM {spans(source, CARD)}) WHERE length(d) BETWEEN 13 AND 19 AND {LUHN})"


def ssns(source: str) -> str:
    """Runs of digits that have the shape as a whole, without the excluded groups."""
    digits = "regexp_replace(value, '[^0-9]', '', 'g')"
    return f"""(SELECT * FROM {spans(source, '[0-9]+(?:[- ][0-9]+)*')} WHERE regexp_full_match(value, '[0-9]{{3}}[- ]?[0-9]{{2}}[- ]?[0-9]{{4}}')
      AND substr({digits}, 1, 3) NOT IN ('000', '666') AND substr({digits}, 1, 1) <> '9' AND substr({digits}, 4, 2) <> '00' AND substr({digits}, 6, 4) <> '0000')"""


def ips(source: str) -> str:
    return f"""(SELECT * FROM {spans(source, IPV4)} WHERE regexp_full_match(value, '(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:\\.(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){{3}}')
      AND NOT starts_with(value, '127.') AND value <> '0.0.0.0' AND NOT starts_with(value, '192.0.2.') AND NOT starts_with(value, '198.51.100.') AND NOT starts_with(value, '203.0.113.'))"""
