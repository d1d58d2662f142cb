"""Column helpers over texts: located matches, bindings, lines, placeholders, globs. All of them stay in Catalyst."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import values as v

SPAN = "array<struct<start:int,end:int,value:string>>"


def bind(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with the value computed once however often f uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


#: Numbers of an array that are summed at once: prefix sums cost its length times this, and not its square.
STRIDE = 128


def prefix_sums(sizes: Column, f: Callable[[Callable[[Column], Column]], Column]) -> Column:
    """f(before), where before(i) is the sum of the first i of sizes; every stride's sum is added up once."""
    add = lambda a, x: a + x
    zero = F.lit(0)
    whole = F.transform(F.sequence(F.lit(0), F.size(sizes), F.lit(STRIDE)), lambda k: F.aggregate(F.slice(sizes, k + 1, F.lit(STRIDE)), zero, add))

    def summed(strides: Column) -> Column:
        starts = F.transform(strides, lambda _, k: F.aggregate(F.slice(strides, F.lit(1), k), zero, add))

        def use(first: Column) -> Column:
            def before(i: Column) -> Column:
                k = F.floor(i / STRIDE).cast("int")
                return F.get(first, k) + F.aggregate(F.slice(sizes, k * STRIDE + 1, i - k * STRIDE), zero, add)

            return f(before)

        return bind(starts, use)

    return bind(whole, summed)


def spans(text: Column, pattern: str) -> Column:
    """All matches as (start, end, value), in code points from 0.

    A match starts after the gaps and matches before it: Spark splits at the matches and extracts them.
    """

    def located(m: Column, gap: Column) -> Column:
        sizes = F.zip_with(gap, m, lambda g, x: F.coalesce(F.length(g), F.lit(0)) + F.coalesce(F.length(x), F.lit(0)))

        def at(total: Column) -> Column:
            def all_(before: Callable[[Column], Column]) -> Column:
                def one(x: Column, i: Column) -> Column:
                    start = before(i) + F.length(F.get(gap, i))
                    return F.struct(start.alias("start"), (start + F.length(x)).alias("end"), x.alias("value"))

                return F.transform(m, one)

            return prefix_sums(total, all_)

        return bind(sizes, at)

    found = F.regexp_extract_all(text, F.lit(pattern), 0)
    all_ = bind(found, lambda m: bind(F.split(text, pattern, -1), lambda gap: located(m, gap)))
    return F.when(text.rlike(pattern), all_).otherwise(F.array().cast(SPAN))


def with_places(text: Column, found: Column, f: Callable[[Column, Column, Column], Column]) -> Column:
    """f(x, line, column) of each x of found (structs with a start), lines and columns from 1.

    The text is cut into blocks once; a place is looked up in its own block, and in what the blocks before it hold.
    """
    n = F.length(text)
    size = F.greatest(F.lit(4096), F.ceil(F.sqrt(n)).cast("int") * 8)

    def in_blocks(b: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), n, b), lambda k: F.substring(text, k + 1, b))

        def blocks(c: Column) -> Column:
            lines = F.transform(c, lambda x: F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit(""))))
            last = F.transform(c, lambda x, k: F.when(x.contains("\n"), k * b + F.length(x) - F.length(F.substring_index(x, "\n", -1))))

            def placed(ends: Column) -> Column:
                starts = F.transform(ends, lambda _, k: F.coalesce(F.array_max(F.slice(ends, F.lit(1), k)), F.lit(0)))

                def use(line_start: Column) -> Column:
                    def each(before: Callable[[Column], Column]) -> Column:
                        def one(x: Column) -> Column:
                            k = F.floor(x["start"] / b).cast("int")

                            def here(head: Column) -> Column:
                                more = F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit("")))
                                column = F.when(more > 0, F.length(F.substring_index(head, "\n", -1)) + 1).otherwise(x["start"] - F.get(line_start, k) + 1)
                                return f(x, (before(k) + more + 1).cast("int"), column.cast("int"))

                            return bind(F.substring(F.get(c, k), F.lit(1), x["start"] - k * b), here)

                        return F.transform(found, one)

                    return bind(lines, lambda sizes: prefix_sums(sizes, each))

                return bind(starts, use)

            return bind(last, placed)

        return bind(cut, blocks)

    return bind(size, in_blocks)


def group_spans(text: Column, pattern: str, group: int, where: Callable[[Column], Column] | None = None) -> Column:
    """Like spans, for the last group of a pattern whose match ends with it, apart from what `after` the pattern says."""
    got = spans(text, pattern)
    if where is not None:
        got = F.filter(got, where)

    def inner(s: Column) -> Column:
        value = F.regexp_extract(s["value"], pattern, group)
        at = s["start"] + F.length(s["value"]) - F.length(value) - (1 if pattern.endswith("@") else 0)
        return F.struct(at.alias("start"), (at + F.length(value)).alias("end"), value.alias("value"))

    return F.transform(got, inner)


# Bindings of a key to a quoted or bare literal.
KEY = r"[A-Za-z_][A-Za-z0-9_.-]*"
QUOTED = r"(?U)(?<![\w.-])([\"'](?:[^\"'\\]*+(?:\\.[^\"'\\]*+)*+)[\"']|" + KEY + r")\s*(?::|=|:=)\s*([\"'])([^\"'\\]*+(?:\\.[^\"'\\]*+)*+)\2"
UNQUOTED = r"(?U)(?<![\w.-])(" + KEY + r")\s*(?::|=|:=)\s*([^\s,;#}\]]+)"


def normalize_key(key: Column) -> Column:
    return F.regexp_replace(F.lower(key), "[^a-z0-9]", "")


def normal(key: str) -> str:
    return re.sub("[^a-z0-9]", "", key.lower())


def bindings(text: Column) -> Column:
    """Key and literal of every `key = value`, quoted ones first; an unquoted value that begins with a quote is none."""

    def quoted(s: Column) -> Column:
        value = F.regexp_extract(s["value"], QUOTED, 3)
        return F.struct(normalize_key(F.regexp_extract(s["value"], QUOTED, 1)).alias("key"), value.alias("value"), (s["end"] - 1 - F.length(value)).alias("start"), (s["end"] - 1).alias("end"), F.lit(True).alias("quoted"))

    def bare(s: Column) -> Column:
        value = F.regexp_extract(s["value"], UNQUOTED, 2)
        return F.struct(normalize_key(F.regexp_extract(s["value"], UNQUOTED, 1)).alias("key"), value.alias("value"), (s["end"] - F.length(value)).alias("start"), s["end"].alias("end"), F.lit(False).alias("quoted"))

    bare_ones = F.filter(F.transform(spans(text, UNQUOTED), bare), lambda b: ~b["value"].startswith('"') & ~b["value"].startswith("'"))
    # Ordered by place, quoted ones first: a binding whose neighbour before has the same place is the same literal.
    placed = F.sort_array(F.transform(F.concat(F.transform(spans(text, QUOTED), quoted), bare_ones), lambda b: F.struct(b["start"], b["end"], (~b["quoted"]).alias("bare"), b["key"], b["value"], b["quoted"])))

    def same(a: Column, b: Column) -> Column:
        return F.coalesce((a["start"] == b["start"]) & (a["end"] == b["end"]) & a["quoted"] & ~b["quoted"], F.lit(False))

    return bind(placed, lambda all_: F.filter(all_, lambda b, i: ~same(F.get(all_, i - 1), b)))


def is_placeholder(value: Column) -> Column:
    t = F.regexp_replace(value, r"(?U)^\s+|\s+\z", "")
    return (t == "") | t.rlike(f"(?is)^(?-s:{v.PLACEHOLDER}|{v.REFERENCE})\\z")


def is_secret_field(key: Column) -> Column:
    return key.isin(sorted({normal(k) for k in v.GENERIC_FIELDS})) | key.rlike("(?:" + "|".join(v.SECRET_SUFFIXES) + r")\z")


def full_match(value: Column, pattern: str) -> Column:
    flags = re.match(r"(?:\(\?[a-zA-Z]+\))*", pattern).group()
    return value.rlike(f"{flags}^(?:{pattern[len(flags):]})\\z")


def line_of(text: Column, start: Column) -> Column:
    """Line of a place, from 1."""
    return F.size(F.split(F.substring(text, F.lit(1), start), "\n", -1))


def column_of(text: Column, start: Column) -> Column:
    """Column of a place, from 1."""
    return F.length(F.element_at(F.split(F.substring(text, F.lit(1), start), "\n", -1), -1)) + 1


def lines_around(lines: Column, line: Column, around: int = 2) -> Column:
    """The lines around a line, joined again."""
    first = F.greatest(line - around, F.lit(1))
    return F.array_join(F.slice(lines, first, line + around - first + 1), "\n")


def context_of(text: Column, line: Column, around: int = 2) -> Column:
    return lines_around(F.split(text, "\n", -1), line, around)


def glob_regex(glob: str) -> str:
    """A shell pattern as a regular expression; `*` also crosses slashes."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        end = glob.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif end > 0:
            body = glob[i + 1 : end].replace("\\", "\\\\")
            out += "[" + ("^" + body[1:] if body[0] == "!" else body) + "]"
            i = end
        else:
            out += re.sub(r"([^\w])", r"\\\1", c)
        i += 1
    return f"(?s)^{out}\\z"


def in_scope(path: Column, globs: list[str]) -> Column:
    p = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "^\\./", "")
    return p.rlike("|".join(f"(?:{glob_regex(g)})" for g in globs)) if globs else F.lit(False)


def one_of(parts: list[str]) -> str:
    """A regular expression for any of the literal strings."""
    return "(?:" + "|".join(re.sub(r"([^\w])", r"\\\1", p) for p in parts) + ")"


def luhn(value: Column) -> Column:
    return F.call_function("luhn_check", F.regexp_replace(value, "[^0-9]", ""))


def redact_path(path: Column) -> Column:
    """A location without what is sensitive in it; the order of the replacements matters."""
    p = F.replace(F.regexp_replace(path, "[\\x00-\\x1f\\x7f]", "_"), F.lit("\\"), F.lit("/"))
    # What is redacted, in order, and the words that stand for it.
    steps = [
        (r"(?i)/(?:Users|home)/[^/\s]+(?:/[^\s]*)?|[A-Z]:[\\/]Users[\\/][^\\/\s]+(?:[\\/][^\s]*)?", "[local-path]"),
        (r"(?i)/(?:Volumes|private/var/folders|private/var/tmp)/[^\s]+", "[local-path]"),
        (v.EMAIL, "[redacted-email]"),
        (r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |ENCRYPTED )?PRIVATE KEY-----|-----BEGIN PGP PRIVATE KEY BLOCK-----", "[private-key]"),
        ("|".join(f"(?:{x})" for _, x in v.TOKEN_FORMATS), "[credential]"),
        (r"(?i)\b(?:api[_-]?key|access[_-]?token|auth[_-]?token|password|passwd|client[_-]?secret|secret[_-]?key|credential|bearer|token|session[_-]?key)[:=._-][^/\\\s]+", "[credential]"),
        (r"(?U)(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?!\w|\.\d)", "[redacted-ip]"),
        (r"(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?:::[0-9A-Fa-f:]{0,})?(?![0-9A-Fa-f:.])", "[redacted-ip]"),
        (r"(?<![A-Za-z0-9])[A-Fa-f0-9]{48,}(?![A-Fa-f0-9])", "[redacted-id]"),
    ]
    out = p
    for pattern, word in steps:
        out = F.regexp_replace(out, pattern, re.sub(r"([\\$])", r"\\\1", word))
    return F.when(p.startswith("/") | p.rlike("^[A-Za-z]:/"), "[absolute-path]").otherwise(out)
