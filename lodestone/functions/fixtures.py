"""Fixtures of table and index definitions, recognised from their tokens without running or parsing SQL.

One expression cuts a text into quoted pieces, comments and the rest; quoted pieces and comments are then replaced by
marks, so that every semicolon that is left ends a statement. Each statement is compared with the two admitted shapes,
and its parentheses are folded with one state. The work is linear in the text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bind

# Bounds of a fixture, and what its statements look like (quoted pieces stand as one mark).
MAX_BYTES, MAX_STATEMENTS = 262_144, 512
NAME = "[A-Za-z_][A-Za-z0-9_]*"
TABLE = rf"(?isU)^CREATE\s+TABLE\s+{NAME}\s*\(.+\)\s*\z"
INDEX = rf"(?isU)^CREATE\s+(?:UNIQUE\s+)?INDEX\s+{NAME}\s+ON\s+{NAME}\s*\(.+\)\s*(?:WHERE\s+{NAME}\s+LIKE\s+'+\s*)?\z"
COPY = r"(?iU)\bAS\s+(?:SELECT|WITH)\b"
#: A piece within quotes (a doubled quote begins the next piece), a comment, one that doesn't end, other text.
TOKEN = r"'[^']*'|\"[^\"]*\"|`[^`]*`|\[[^\]]*\]|--[^\n]*|/\*(?s:.*?)\*/|/\*|[^'\"`\[\]/\-]+|(?s:.)"
#: Tokens that belong to nothing: quotes and comments without an end.
STRAY = ["'", '"', "`", "[", "]", "/*"]
CLOSED, WRONG = -1, -2


def _mark(token: Column) -> Column:
    long = F.length(token) > 1
    return (
        F.when(long & token.startswith("'"), "'")
        .when(long & (token.startswith('"') | token.startswith("`") | token.startswith("[")), '"')
        .when(token.startswith("--") | token.startswith("/*"), " ")
        .otherwise(token)
    )


def one_list(statement: Column) -> Column:
    """Whether the parentheses are balanced and form one outermost list."""

    def step(depth: Column, c: Column) -> Column:
        opened = F.when(depth >= 0, depth + 1).otherwise(WRONG)
        closed = F.when(depth > 1, depth - 1).when(depth == 1, CLOSED).otherwise(WRONG)
        return F.when(c == "(", opened).otherwise(closed)

    marks = F.regexp_replace(statement, "[^()]+", "")
    return F.aggregate(F.filter(F.split(marks, ""), lambda c: c != ""), F.lit(0), step) == CLOSED


def _admitted(statement: Column) -> Column:
    bare = F.translate(statement, "'\"", "  ")
    return (statement.rlike(TABLE) | statement.rlike(INDEX)) & ~bare.rlike(COPY) & one_list(bare)


def _blank(s: Column) -> Column:
    return ~s.rlike(r"(?U)\S")


def schema_only(text: Column) -> Column:
    """Whether a text is a fixture: one to 512 complete definitions of tables and indexes, and nothing else.

    Not so: a null or empty text, one with a NUL or of more than 262,144 bytes, quotes or comments that don't end, a
    table that copies a query, parentheses that aren't one balanced list. Literals are read as units.
    """

    def judged(tokens: Column) -> Column:
        parts = F.split(F.array_join(F.transform(tokens, _mark), ""), ";", -1)

        def statements(p: Column) -> Column:
            n = F.size(p) - 1
            trimmed = F.transform(F.slice(p, F.lit(1), F.greatest(n, F.lit(0))), lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+\z", ""))
            return (n >= 1) & (n <= MAX_STATEMENTS) & _blank(F.element_at(p, -1)) & F.forall(trimmed, _admitted)

        return ~F.exists(tokens, lambda t: t.isin(STRAY)) & bind(parts, statements)

    fits = (text != "") & (F.octet_length(text) <= MAX_BYTES) & ~text.contains("\x00")
    return F.coalesce(F.when(fits, bind(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), judged)), F.lit(False))
