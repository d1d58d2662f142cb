"""Joins of addresses with networks, and of paths with patterns, by keys that both sides have: neither is a product."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.addresses import address, masked, network

#: Lengths of the beginnings and endings that patterns are found by, and of the letters in between.
LENGTHS, GRAMS = (*range(1, 25), 32, 48, 64), (4, 8, 16, 32)
#: Parts that the paths of one beginning or ending are dealt over: those of the empty one are all.
PARTS = 16


def network_keys(networks: DataFrame, cidr: str = "cidr") -> DataFrame:
    """networks with the columns of their keys; rows that are no network are left out."""
    return networks.withColumn("_net", network(F.col(cidr))).where("_net is not null").select(*networks.columns, "_net")


def _joined(addresses: DataFrame, nets: DataFrame, value: str, at: str | None = None) -> DataFrame:
    """(value, cidr, prefix) of addresses and networks with their keys.

    An address is masked to each prefix length that the networks have (33 and 129 lengths at most) and equi-joined with
    the networks of that length: no interval is compared with another. Values that are no address match nothing.
    """
    lengths = [(r[0], r[1]) for r in nets.select("_net.version", "_net.prefix").distinct().collect()]  # 162 at most
    if not lengths:
        return addresses.select(value).limit(0).withColumns({"cidr": F.lit("").cast("string"), "prefix": F.lit(0)})
    sizes = F.array(*(F.struct(F.lit(v).alias("version"), F.lit(p).alias("prefix")) for v, p in sorted(lengths)))
    some = addresses.select(value, F.col(at or value).alias("_at")).distinct().withColumn("_a", address(F.col("_at"))).where("_a is not null")
    some = some.withColumn("_l", F.explode(F.filter(sizes, lambda s: s["version"] == F.col("_a.version")))).withColumn("_m", masked(F.col("_a"), F.col("_l.prefix")))
    keys = lambda c: [F.col(f"{c}.high").alias("_high"), F.col(f"{c}.low").alias("_low")]
    left = some.select(value, F.col("_l.version").alias("_version"), F.col("_l.prefix").alias("_prefix"), *keys("_m"))
    right = nets.select("cidr", F.col("_net.version").alias("_version"), F.col("_net.prefix").alias("_prefix"), *keys("_net"))
    return left.join(right, ["_version", "_prefix", "_high", "_low"]).select(value, "cidr", F.col("_prefix").alias("prefix"))


def in_networks(addresses: DataFrame, networks: DataFrame, value: str = "value", cidr: str = "cidr") -> DataFrame:
    """(value, cidr, prefix): every distinct address with each network that holds it."""
    return _joined(addresses, network_keys(networks.select(F.col(cidr).alias("cidr")).distinct()), value)


def narrowest_network(addresses: DataFrame, networks: DataFrame, value: str = "value", cidr: str = "cidr", at: str | None = None) -> DataFrame:
    """(value, cidr, prefix): every distinct address that networks hold, with the one of the longest prefix, the first by name among equal ones.

    at: the column with the address itself, where value only names it.
    """
    one = network_keys(networks.select(F.col(cidr).alias("cidr"))).groupBy("_net").agg(F.min("cidr").alias("cidr"))
    best = F.min_by(F.struct("cidr", "prefix"), F.struct(-F.col("prefix"), "cidr"))
    return _joined(addresses, one, value, at).groupBy(value).agg(best.alias("_b")).select(value, "_b.cidr", "_b.prefix")


def outside_networks(found: DataFrame, networks: DataFrame, rule: str = "privacy.endpoint.ip-address") -> DataFrame:
    """Candidates less the rule's addresses that a network holds; other rules' candidates pass."""
    inside = in_networks(found.where(F.col("rule") == rule), networks).select("value").distinct().withColumn("rule", F.lit(rule))
    return found.join(inside, ["rule", "value"], "left_anti")


def glob_regex(glob: Column) -> Column:
    """A shell pattern as a regular expression: `*` crosses slashes, a class may be negated by `!`, an open bracket is itself, and a class with a range that runs backward matches nothing."""

    def one(t: Column) -> Column:
        inner = F.regexp_extract(t, r"(?s)^\[!?(.*)\]\z", 1)
        body = F.regexp_replace(inner, r"([\\\[\]&^~])", r"\\$1")
        ends = F.regexp_extract_all(inner, F.lit("(?s).-."), F.lit(0))
        backward = F.exists(ends, lambda r: F.ascii(F.substring(r, 1, 1)) > F.ascii(F.substring(r, -1, 1)))
        cls = F.when(backward, "(?!)").otherwise(F.concat(F.when(t.startswith("[!"), "[^").otherwise("["), body, F.lit("]")))
        return F.when(t == "*", ".*").when(t == "?", ".").when((inner != "") & t.startswith("["), cls).otherwise(F.regexp_replace(t, r"([^\w])", r"\\$1"))

    tokens = F.regexp_extract_all(glob, F.lit(r"\[!?\]?[^\]]*\]|(?s:.)"), F.lit(0))
    return F.concat(F.lit("(?s)^"), F.array_join(F.transform(tokens, one), ""), F.lit("\\z"))


def _wild(glob: Column) -> Column:
    return glob.rlike(r"[*?\[]")


def _down_to(n: Column, steps: tuple[int, ...]) -> Column:
    """The largest of the steps that n reaches, 0 if it reaches none."""
    return F.greatest(F.lit(0), *(F.when(n >= k, k) for k in steps))


def _with_keys(rules: DataFrame, folders: bool) -> DataFrame:
    """rules with the keys of their _choice: _a of its literal beginning, _b of that and its literal ending, _c of both and letters in between.

    Lengths are cut down to those of LENGTHS and GRAMS. A choice without a wildcard has its whole text for a beginning.
    """
    glob = F.col("_choice")
    head, tail = F.regexp_extract(glob, r"^[^*?\[]*", 0), F.regexp_extract(glob, r"[*?\]]([^*?\[\]]*)\z", 1)
    inner = F.substring(glob, F.length("_head") + 1, F.length(glob) - F.length("_head") - F.length("_tail"))
    literals = F.filter(F.split(F.regexp_replace(inner, r"(?s)\[.*\]", "*"), r"[*?]+", -1), lambda x: F.length(x) >= GRAMS[0])
    longest = F.array_max(F.transform(literals, lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))["x"]
    exact = F.regexp_replace(glob, "/+\\z", "") if folders else glob
    out = rules.withColumns({"_wild": _wild(glob), "_head": head, "_tail": tail}).withColumn("_inner", F.when(F.col("_wild"), longest))
    size = lambda c, steps: F.when(F.col("_wild"), F.coalesce(_down_to(F.length(c), steps), F.lit(0))).otherwise(0)
    out = out.withColumns({"_from": size("_head", LENGTHS), "_to": size("_tail", LENGTHS), "_gram": size("_inner", GRAMS)})
    out = out.withColumn("_a", F.when(F.col("_wild"), F.xxhash64(F.lit("from"), F.substring("_head", F.lit(1), F.col("_from")))).otherwise(F.xxhash64(F.lit("at"), exact)))
    out = out.withColumn("_b", F.xxhash64("_a", F.right("_tail", F.col("_to"))))
    return out.withColumn("_c", F.xxhash64("_b", F.coalesce(F.substring("_inner", F.lit(1), F.col("_gram")), F.lit(""))))


def _met(paths: DataFrame, rules: DataFrame, path: str) -> DataFrame:
    """paths (with their compared form _p) and the rules whose keys they have: beginnings first, then endings of these, then letters of both."""
    used = rules.select("_wild", "_from").distinct().collect()  # 29 at most
    none = F.array().cast("array<int>")
    n, slashes = F.length("_p"), F.length("_p") - F.length(F.replace("_p", F.lit("/"), F.lit("")))
    # Folders are told from beginnings by their sign: -1 is the empty one, -2 that of the first part.
    places = F.sequence(-slashes - 2, F.lit(-1)) if any(not r[0] for r in used) else none
    starts = sorted(r[1] for r in used if r[0])
    out = paths.select(path, "_p", F.explode(F.concat(places, F.array(*map(F.lit, starts)) if starts else none)).alias("_k")).where(F.col("_k") <= n)
    folder = F.xxhash64(F.lit("at"), F.expr("substring_index(_p, '/', -_k - 1)"))
    part = F.when(F.col("_k") < 0, 0).otherwise(F.pmod(F.xxhash64("_p"), F.lit(PARTS)).cast("int")).alias("_part")
    out = out.select(path, "_p", part, F.when(F.col("_k") < 0, folder).otherwise(F.xxhash64(F.lit("from"), F.substring("_p", F.lit(1), F.col("_k")))).alias("_a"))

    def needed(key: str, length: str) -> DataFrame:
        parts = F.explode(F.sequence(F.lit(0), F.when(F.col("_wild"), PARTS - 1).otherwise(0))).alias("_part")
        return rules.groupBy(key, "_wild").agg(F.collect_set(length).alias("_k")).select(key, "_k", parts)

    out = out.join(needed("_a", "_to"), ["_a", "_part"]).select(path, "_p", "_part", "_a", F.explode("_k").alias("_k")).where(F.col("_k") <= n)
    out = out.select(path, "_p", "_part", F.xxhash64("_a", F.right("_p", F.col("_k"))).alias("_b"))
    out = out.join(needed("_b", "_gram"), ["_b", "_part"]).select(path, "_p", "_b", F.explode("_k").alias("_k")).where(F.col("_k") <= n)
    out = out.select(path, "_p", "_b", "_k", F.explode(F.when(F.col("_k") > 0, F.sequence(F.lit(1), n - F.col("_k") + 1)).otherwise(F.array(F.lit(1)))).alias("_i"))
    out = out.select(path, "_p", F.xxhash64("_b", F.substring("_p", F.col("_i"), F.col("_k"))).alias("_c"))
    return out.join(rules.select("pattern", "_choice", "_wild", "_regex", "_c"), "_c")


def in_scopes(paths: DataFrame, patterns: DataFrame, path: str = "path", pattern: str = "pattern", policy: bool = True) -> DataFrame:
    """(path, pattern): every distinct path with each pattern that matches it.

    policy: patterns may be alternatives joined by `|`, and one without a wildcard means a path or a folder; else each
    pattern is one shell pattern, and paths are compared with forward slashes and without a leading `./`. Patterns are
    keyed by all that they have literally (beginning, ending, and letters in between), a path by what the patterns that
    its beginning meets need, and only pairs of equal keys are compared. A pattern without any of these (`*`) meets all paths.
    """
    plain = F.col(path) if policy else F.regexp_replace(F.replace(F.col(path), F.lit("\\"), F.lit("/")), r"^\./", "")
    choice = F.explode(F.array_distinct(F.split(F.col(pattern), r"\|", -1))) if policy else F.col(pattern)
    rules = patterns.select(pattern).distinct().select(F.col(pattern).alias("pattern"), choice.alias("_choice")).withColumn("_regex", glob_regex(F.col("_choice")))
    met = _met(paths.select(path).distinct().withColumn("_p", plain), _with_keys(rules.where("_choice <> ''" if not policy else "true"), policy), path)
    literal = (F.col("_p") == F.col("_choice")) | (F.startswith(F.col("_p"), F.concat(F.regexp_replace("_choice", "/+\\z", ""), F.lit("/"))) if policy else F.lit(False))
    return met.where(F.when(F.col("_wild"), F.expr("_p rlike _regex")).otherwise(literal)).select(path, "pattern").distinct()
