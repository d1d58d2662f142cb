"""Line dedup: exact and near copies of lines over all documents, in DataFrame expressions only.

Lines of min_chars characters or more take part, those under 40 only if they have a letter or a digit; others always
stay. The queries take min_chars = 1: every line with a word. A line's text counts where it first stands (by doc_id,
then place). Later copies of a text go, and a text goes altogether if another text that stands earlier is within 2
edits, or within 1 if the shorter of the two has 3 to 19 characters; texts of 1 or 2 characters only go as copies.

Texts of up to 20 characters are indexed under themselves and all their forms with one character left out: two within
1 edit share one of these. For those of 20 and more the edit join cuts each distinct text of length L into 3 segments: two texts within 2 edits share one of them, at a
place that the counts of edits before and after it bound. A text's segments are indexed under (segment's number,
length, hash), and each text probes the indexes of lengths L, L - 1 and L - 2 with the substrings at those places. Texts
that share a key with another one then have their letters counted, by groups (an edit moves the counts by 2 at most), and
only those that agree in these become candidates: near copies with another word share a segment but aren't paired.
Candidates are verified by a banded bit-parallel edit distance: 5 bits of the vertical differences move down the diagonal.

Edge cases: a null text is an empty one; rows without doc_id keep all lines and make no other line go; rows that
repeat an id and its text share their verdicts; empty lines and tables are answered as they are; other columns of
any name are kept by dedup_lines and ignored by line_verdicts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bind, discard, materialize, small_side, unused

EDITS, MIN_CHARS = 2, 40
#: Texts of LEAST characters and more have near copies; those under SHORT within one edit.
LEAST, SHORT = 3, 20
#: Groups of letters that are counted together, three bits each; the lower four bits hold the length.
GROUPS = ("a", "b", "c", "d", "e", "f", "g", "h", "i", "k", "l", "m", "n", "o", "p", "r", "s", "t", "ujq", "vwxyz")


def _segment(length: Column, i: int, parts: int) -> tuple[Column, Column]:
    """Start (from 0) and length of segment i; the last length % parts segments are one character longer."""
    base, rest = F.floor(length / parts), length % parts
    return i * base + F.greatest(F.lit(0), rest + (i - parts)), base + F.when(rest >= parts - i, 1).otherwise(0)


def _key(line: Column, i: int, length: Column, start: Column, size: Column) -> Column:
    return F.xxhash64(F.lit(i), length, F.substring(line, start + 1, size))


def index_keys(line: Column, n: Column, edits: int = EDITS) -> list[Column]:
    """n: the line's length."""
    return [_key(line, i, n, *_segment(n, i, edits + 1)) for i in range(edits + 1)]


def probe_keys(line: Column, n: Column, edits: int = EDITS) -> list[Column]:
    """Keys beyond the text's own index keys under which a text within `edits`, as long or shorter, may be indexed."""
    out = []
    for less in range(edits + 1):
        for i in range(edits + 1):
            start, size = _segment(n - less, i, edits + 1)
            for shift in range(max(-i, less - (edits - i)), min(i, less + edits - i) + 1):
                if less or shift:
                    out.append(F.when((n - less >= SHORT) & (start + shift >= 0) & (start + shift + size <= n), _key(line, i, n - less, start + shift, size)))
    return out


def _none() -> Column:
    return F.array().cast("array<long>")


def left_out_keys(line: Column, n: Column) -> Column:
    """Keys of a text and of its forms without one of its characters."""
    one_less = F.transform(F.sequence(F.lit(0), n), lambda i: F.xxhash64(F.lit(-1), F.concat(F.substring(line, F.lit(1), i), F.substring(line, i + 2, n))))
    return F.array_distinct(one_less)


def own_keys(line: Column, n: Column, edits: int = EDITS) -> Column:
    """Keys under which a text is indexed: segments, forms, or at SHORT characters both."""
    segments, forms = F.array(*index_keys(line, n, edits)), left_out_keys(line, n)
    return F.when(n > SHORT, segments).when(n == SHORT, F.concat(segments, forms)).when(n >= LEAST, forms).otherwise(_none())


def takes_part(line: Column, min_chars: int) -> Column:
    return (F.length(line) >= min_chars) & ((F.length(line) >= MIN_CHARS) | F.rlike(line, F.lit(r"[\p{L}\p{N}]")))


def letter_counts(line: Column, n: Column) -> Column:
    """The length modulo 16 and the counts of each group of letters modulo 8, as one long."""
    out, size = (n % 16).cast("long"), F.octet_length(line)
    for k, group in enumerate(GROUPS):
        count = sum((size - F.octet_length(F.replace(line, F.lit(c), F.lit(""))) for c in group), F.lit(0))
        out = out.bitwiseOR(F.shiftleft((count % 8).cast("long"), 4 + 3 * k))
    return out


def counts_near(a: Column, b: Column, edits: int = EDITS) -> Column:
    """Whether two texts may be within `edits`: differences are taken around the modulus."""

    def apart(at: int, bits: int) -> Column:
        d = F.abs(F.shiftrightunsigned(a, at).bitwiseAND(F.lit((1 << bits) - 1)) - F.shiftrightunsigned(b, at).bitwiseAND(F.lit((1 << bits) - 1)))
        return F.least(d, F.lit(1 << bits) - d)

    return (apart(0, 4) <= edits) & (sum((apart(4 + 3 * k, 3) for k in range(len(GROUPS))), F.lit(0)) <= 2 * edits)


def edit_distance(a: Column, b: Column, edits: int = EDITS) -> Column:
    """The edit distance of two texts longer than 2 * edits if it is at most `edits`, else a larger number or null."""
    width = 2 * edits + 1
    ones = (1 << width) - 1
    bit = lambda v, k: F.shiftright(v, k).bitwiseAND(F.lit(1))
    inv = lambda v: v.bitwiseXOR(F.lit(ones))

    def run(x: Column, y: Column) -> Column:
        m = F.size(x)

        def equal(j: Column) -> Column:
            out = F.lit(0)
            for k in range(width):
                out = out + F.when(F.get(x, j + (edits + 1 - width + k)) == F.get(y, j), 1 << k).otherwise(0)
            return out

        def step(state: Column, j: Column) -> Column:
            vp, vn, d = F.get(state, F.lit(0)), F.get(state, F.lit(1)), F.get(state, F.lit(2))

            def with_diagonal(d0: Column) -> Column:
                hn = d0.bitwiseAND(vp)
                hp = vn.bitwiseOR(inv(d0.bitwiseOR(vp)))
                down = F.shiftright(d0, 1)
                place = width - 2 - (j - (m - edits))
                moved = F.when(j < m - edits, 1 - bit(d0, width - 1)).otherwise(_bit_at(hp, place) - _bit_at(hn, place))
                return F.array(hn.bitwiseOR(inv(down.bitwiseOR(hp))), hp.bitwiseAND(down), d + moved)

            def with_equal(e: Column) -> Column:
                d0 = (e.bitwiseAND(vp) + vp).bitwiseXOR(vp).bitwiseOR(e).bitwiseOR(vn).bitwiseAND(F.lit(ones))
                return bind(d0, with_diagonal)

            return bind(equal(j), with_equal)

        begin = F.array(F.lit(ones & ~((1 << edits) - 1)), F.lit(0), F.lit(edits))
        return F.get(F.aggregate(F.sequence(F.lit(0), F.size(y) - 1), begin, step), F.lit(2))

    distance = bind(F.split(a, ""), lambda x: bind(F.split(b, ""), lambda y: run(x, y)))
    return F.when(F.abs(F.length(a) - F.length(b)) <= edits, distance)


def _bit_at(v: Column, k: Column) -> Column:
    return F.call_function("shiftright", v, k.cast("int")).bitwiseAND(F.lit(1))


def lines_of(df: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, pos, line, its length n and its two hashes, for the lines that take part."""
    rows = df.where(F.col("doc_id").isNotNull()).select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("pos", "line"))
    rows = rows.withColumn("n", F.length("line")).where(takes_part(F.col("line"), min_chars))
    return rows.select("doc_id", "pos", "line", "n", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


def near_pairs(lines: DataFrame, edits: int = EDITS) -> DataFrame:
    """(a, b): hashes of texts that may be within `edits`, each pair once."""
    # Keys are made before equal texts meet: they are shorter than most lines.
    line, n = F.col("line"), F.col("n")
    made = lines.select("h1", "h2", own_keys(line, n, edits).alias("own"), F.when(n >= SHORT, F.array(*probe_keys(line, n, edits))).otherwise(_none()).alias("more"))
    keyed = materialize(made.groupBy("h1", "h2").agg(F.first("own").alias("own"), F.first("more").alias("more")).drop("h2"))
    # Most keys belong to one text; letters are counted only in texts that share a key, and pairs made only of these.
    of = lambda name, mine: F.transform(F.filter(name, lambda k: k.isNotNull()), lambda k: F.struct(k.alias("key"), F.lit(mine).alias("mine")))
    each = keyed.select("h1", F.explode(F.concat(of("own", True), of("more", False))).alias("k")).select("h1", "k.key", "k.mine")
    shared = each.groupBy("key").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi"), F.max("mine").alias("mine")).where("lo < hi and mine").select("key")
    met = materialize(each.join(small_side(materialize(shared)), "key", "left_semi"))
    ids = materialize(met.select("h1").distinct())
    sigs = lines.join(small_side(ids), "h1", "left_semi").groupBy("h1").agg(F.min("line").alias("line"))
    sigs = materialize(sigs.select("h1", letter_counts(F.col("line"), F.length("line")).alias("sig")))
    met = met.join(small_side(sigs), "h1")
    index = met.where("mine").select("key", F.col("h1").alias("b"), F.col("sig").alias("sig_b"))
    probe = met.select("key", F.col("h1").alias("a"), F.col("sig").alias("sig_a"))
    # Texts of one length find each other from both sides; one is enough.
    once = (F.col("sig_a").bitwiseXOR(F.col("sig_b")).bitwiseAND(F.lit(15)) != 0) | (F.col("a") < F.col("b"))
    hit = probe.join(index, (probe["key"] == index["key"]) & (F.col("a") != F.col("b")) & once & counts_near(F.col("sig_a"), F.col("sig_b"), edits))
    return hit.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_texts(lines: DataFrame, edits: int = EDITS) -> DataFrame:
    """(h1, h2): texts that go because a text that stands earlier is within `edits`."""
    pairs = materialize(near_pairs(lines, edits))
    discard(lines.sparkSession)
    ids = materialize(pairs.select(F.explode(F.array("a", "b")).alias("h1")).distinct())
    at = F.min(F.struct("doc_id", "pos")).alias("at")
    texts = materialize(lines.join(small_side(ids), "h1", "left_semi").groupBy("h1", "h2").agg(F.first("line").alias("line"), at))
    side = lambda s: texts.select(*(F.col(c).alias(f"{c}_{s}") for c in texts.columns))
    both = pairs.join(side("a"), F.col("a") == F.col("h1_a")).join(side("b"), F.col("b") == F.col("h1_b"))
    a, b = F.col("line_a"), F.col("line_b")
    close = both.where(F.when(F.least(F.length(a), F.length(b)) < SHORT, edit_distance(a, b, 1) <= 1).otherwise(edit_distance(a, b, edits) <= edits))
    later = F.when(F.col("at_a") > F.col("at_b"), F.struct(F.col("h1_a").alias("h1"), F.col("h2_a").alias("h2"))).otherwise(F.struct(F.col("h1_b").alias("h1"), F.col("h2_b").alias("h2")))
    return close.select(later.alias("l")).select("l.*").distinct()


def kept_places(df: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id and the places (sorted) of its lines that take part and stay; documents without any such line are missing."""
    lines = lines_of(df, min_chars)
    near = materialize(near_texts(lines, edits))
    discard(df.sparkSession)
    held = lines.groupBy("h1", "h2", "doc_id").agg(F.min("pos").alias("pos"))
    first = held.groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id"))
    stays = held.join(first, ["h1", "h2", "doc_id"], "left_semi").join(near, ["h1", "h2"], "left_anti")
    return stays.groupBy("doc_id").agg(F.sort_array(F.collect_list("pos")).alias("kept"))


def line_verdicts(df: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """One row per document: lines, lines that take part, lines that stay in all, and the places of those that take part and stay."""
    kept = kept_places(df, edits, min_chars)
    cut = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    docs = df.select("doc_id", F.size(cut).cast("long").alias("n_lines"), F.size(F.filter(cut, lambda x: takes_part(x, min_chars))).cast("long").alias("n_checked"))
    out = docs.join(kept, "doc_id", "left")
    stay = F.when(F.col("doc_id").isNull(), F.col("n_checked")).otherwise(F.coalesce(F.size("kept"), F.lit(0)).cast("long"))
    stay = F.when(F.col("kept").isNull() & F.col("doc_id").isNotNull(), F.lit(0).cast("long")).otherwise(stay)
    return out.select("doc_id", "n_lines", "n_checked", (F.col("n_lines") - F.col("n_checked") + stay).alias("n_kept"), F.coalesce(F.array_join(F.col("kept").cast("array<string>"), ","), F.lit("")).alias("kept_places"))


def dedup_lines(df: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """The documents with only the lines that stay, in df's columns (n_chars is counted anew if there is one); a document that loses all of its lines that have a word goes, one that had none stays."""
    key, places, short = (unused(df, c) for c in ("kept_id", "kept_places", "short"))
    kept = kept_places(df, edits, min_chars).withColumnsRenamed({"doc_id": key, "kept": places})
    cut = F.split(F.col("text"), "\n", -1)

    def shortened(lines: Column, at: Column) -> Column:
        return F.filter(lines, lambda x, i: ~takes_part(x, min_chars) | F.array_contains(at, i))

    none = F.array().cast("array<int>")
    joined = df.join(kept, df["doc_id"] == F.col(key), "left")
    text = F.array_join(shortened(cut, F.coalesce(places, none)), "\n")
    out = joined.withColumn(short, F.when(F.col("text").isNull() | F.col("doc_id").isNull(), F.col("text")).otherwise(text))
    out = out.where(F.col("text").isNull() | (F.trim(short) != "") | (F.trim("text") == ""))
    new = {"text": F.col(short), "n_chars": F.length(short).cast(df.schema["n_chars"].dataType) if "n_chars" in df.columns else None}
    return out.select(*(new[c].alias(c) if c in new else F.col(f"`{c}`") for c in df.columns))
