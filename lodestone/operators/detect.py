"""Detectors: every family is a column expression from a text to an array of candidates, and one explode gives the rows.

All families of a text are concatenated before the explode, so that a scan reads each text once, and the bindings
(`key = value`) are extracted once for the seven rules that read them.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keys as km
from ..functions import text as tx
from ..functions import values as v

CANDIDATE = "array<struct<rule:string,start:int,end:int,basis:string,value:string>>"


def _empty() -> Column:
    return F.array().cast(CANDIDATE)


def _as(found: Column, rule: str | None, basis: str, name=None) -> Column:
    """Candidates of one rule (or of name(span)) from spans."""
    return F.transform(found, lambda s: F.struct((F.lit(rule) if rule else name(s)).alias("rule"), s["start"].alias("start"), s["end"].alias("end"), F.lit(basis).alias("basis"), s["value"].alias("value")))


def _if(test: Column, found: Column) -> Column:
    return F.when(test, found).otherwise(_empty())


def _set(names: list[str]) -> list[str]:
    return sorted({tx.normal(n) for n in names})


def bound(text: Column, path: Column) -> Column:
    """Rules over bindings: provider and generic credentials, and runtime, business, backend and host fields."""
    family = {tx.normal(f): k for k, fields in v.PROVIDER_FIELDS.items() for f in fields}
    names = F.create_map(*(F.lit(x) for kv in sorted(family.items()) for x in kv))
    literal = lambda b: ~tx.is_placeholder(b["value"])
    plain = lambda b, shape: b["quoted"] | ~tx.full_match(F.trim(b["value"]), shape)
    scheme = lambda b: (b["key"] == "authorization") & F.lower(b["value"]).isin("bearer", "basic")

    def rules(all_: Column) -> Column:
        provider = F.filter(all_, lambda b: b["key"].isin(sorted(family)) & ~scheme(b) & literal(b) & plain(b, v.DOTTED))
        generic = F.filter(all_, lambda b: ~b["key"].isin(sorted(family)) & tx.is_secret_field(b["key"]) & ~scheme(b) & literal(b) & plain(b, v.DOTTED))
        field = lambda names: F.filter(all_, lambda b: b["key"].isin(_set(names)) & literal(b))
        meta = lambda names: F.filter(all_, lambda b: b["key"].isin(_set(names)) & literal(b) & (b["quoted"] | ~tx.full_match(b["value"], v.SCOPED)))
        hosts = F.filter(all_, lambda b: b["key"].isin(_set(v.HOST_FIELDS)) & tx.full_match(b["value"], v.HOST_LITERAL) & private_host(F.lower(b["value"])))
        return F.concat(
            _as(provider, None, "Literal assignment to a provider credential field", lambda b: F.concat(F.lit("privacy.credential.provider."), F.element_at(names, b["key"]))),
            _as(generic, "privacy.credential.binding", "Literal assignment to a credential or authentication field"),
            _as(field(v.RUNTIME_FIELDS), "privacy.personal.record-field", "Literal assigned to a user, device, session, or runtime-data field"),
            _as(meta(v.BUSINESS_FIELDS), "privacy.business.assignment", "Literal business or commercial record field requiring provenance review"),
            _as(meta(v.BACKEND_FIELDS), "privacy.backend.metadata", "Literal backend, provider, or deployment metadata field"),
            _as(hosts, "privacy.endpoint.host-binding", "Host or domain configuration literal requiring ownership review"),
        )

    return _if(text.contains("=") | text.contains(":"), tx.bind(tx.bindings(text), rules))


def token_formats(text: Column, path: Column) -> Column:
    """One alternation; the first format that the match fits names the rule."""
    every = "|".join(f"(?:{p})" for _, p in v.TOKEN_FORMATS)
    name = lambda s: F.concat(F.lit("privacy.credential.format."), F.coalesce(*(F.when(tx.full_match(s["value"], p), n) for n, p in v.TOKEN_FORMATS)))
    return _as(tx.spans(text, every), None, "Recognized provider token shape; validity is not tested", name)


def personal(text: Column, path: Column) -> Column:
    rule = "privacy.personal.identifier"
    cards = F.filter(tx.spans(text, v.CARD), lambda s: tx.luhn(s["value"]))
    digits = text.rlike("[0-9]")
    return F.concat(
        _if(text.contains("@"), _as(tx.spans(text, v.EMAIL), rule, "Email-address-shaped personal data")),
        _if(text.contains("+"), _as(tx.spans(text, v.PHONE), rule, "International phone-number-shaped personal data")),
        _if(digits, _as(tx.spans(text, v.SSN), rule, "National-identifier-shaped personal data")),
        _if(digits, _as(cards, rule, "Payment-card-shaped personal data with a valid Luhn checksum")),
    )


def public_ipv4(value: Column) -> Column:
    """Whether an IPv4 literal is valid and outside loopback, unspecified and documentation addresses."""
    octet = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    out = value.rlike(f"^{octet}(?:\\.{octet}){{3}}\\z") & ~value.startswith("127.") & (value != "0.0.0.0")
    for p in v.DOCUMENTATION_PREFIXES:
        out = out & ~value.startswith(p)
    return out


def public_ipv6(value: Column) -> Column:
    """Likewise for IPv6: 8 groups, or fewer around one gap."""
    groups = F.filter(F.split(value, ":", -1), lambda g: g != "")
    shape = value.rlike("^(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})*)?(?:::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})*)?)?\\z")
    size = F.when(value.contains("::"), F.size(groups) <= 7).otherwise(F.size(groups) == 8)
    plain = F.array_join(F.filter(F.transform(groups, lambda g: F.regexp_replace(g, "^0+", "")), lambda g: g != ""), ":")
    ends = F.element_at(F.split(value, ":", -1), -1) != ""
    trivial = (plain == "") | ((plain == "1") & ends)
    return shape & size & ~trivial & ~F.lower(value).rlike("^2001:0?db8:")


def network(text: Column, path: Column) -> Column:
    rule, basis = "privacy.endpoint.ip-address", "IP address literal outside loopback and documentation ranges"
    svg = F.lower(path).endswith(".svg")

    def drawn(s: Column) -> Column:
        before = F.lower(F.element_at(F.split(F.substring(text, F.lit(1), s["start"]), "\n", -1), -1))
        return svg & before.rlike("<path\\b[^>]*\\bd\\s*=\\s*[\"'][^\"']*\\z")

    scoped = path.rlike("\\.(?:rs|kt|kts|java|cpp|cc|h|hpp)\\z")

    def namespace(s: Column) -> Column:
        before, after = F.substring(text, s["start"], F.lit(1)), F.substring(text, s["end"] + 1, F.lit(1))
        before = F.when(s["start"] > 0, before).otherwise("")
        return scoped & s["value"].rlike("(?U)^[A-Za-z]\\w*::[A-Za-z]\\w*\\z") & ~before.isin('"', "'", "[") & ~after.isin('"', "'", "]")

    v4 = F.filter(tx.spans(text, v.IPV4), lambda s: public_ipv4(s["value"]) & ~drawn(s))
    v6 = F.filter(tx.spans(text, v.IPV6), lambda s: public_ipv6(s["value"]) & ~drawn(s) & ~namespace(s))
    return F.concat(_if(text.rlike("[0-9]\\.[0-9]"), _as(v4, rule, basis)), _if(text.contains(":"), _as(v6, rule, basis)))


def private_host(host: Column) -> Column:
    """Whether a lower-case host is neither an example, a loopback or documentation address, nor a public authority."""
    h = F.regexp_replace(host, "\\.+\\z", "")
    out = (h != "") & ~h.isin(v.EXAMPLE_HOSTS + v.PUBLIC_AUTHORITIES) & ~h.rlike(tx.one_of(v.EXAMPLE_SUFFIXES) + "\\z")
    is_v4 = h.rlike("^[0-9]{1,3}(?:\\.[0-9]{1,3}){3}\\z")
    is_v6 = h.contains(":")
    return out & (~is_v4 | public_ipv4(h)) & (~is_v6 | public_ipv6(h))


def url_host(url: Column) -> Column:
    host = F.regexp_extract(url, "^[^:]+://(?:[^/?#@]*@)?(\\[[^\\]]*\\]|[^/:?#]*)", 1)
    return F.lower(F.regexp_replace(host, "[\\[\\]]", ""))


def trimmed_urls(text: Column) -> Column:
    """URLs without the punctuation that ends them."""

    def cut(s: Column) -> Column:
        value = F.regexp_replace(s["value"], "[.,;:!?)}\\]]+\\z", "")
        return F.struct(s["start"].alias("start"), (s["start"] + F.length(value)).alias("end"), value.alias("value"))

    return F.transform(tx.spans(text, v.URL), cut)


def endpoints(text: Column, path: Column) -> Column:
    served = lambda s: F.lower(F.regexp_extract(s["value"], "^([^:]+)://", 1)).isin(v.SERVICE_SCHEMES)
    urls = F.filter(trimmed_urls(text), lambda s: served(s) & private_host(url_host(s["value"])))
    ssh = F.filter(tx.spans(text, v.SSH_ACCESS), lambda s: private_host(F.lower(F.regexp_extract(s["value"], v.SSH_ACCESS, 1))))
    return F.concat(
        _if(text.contains("://"), _as(urls, "privacy.endpoint.private-host", "Parsed service endpoint; ownership and publication context require review")),
        _if(text.contains("@"), _as(ssh, "privacy.endpoint.host-binding", "SSH account and remote endpoint access metadata")),
    )


def _literal_secret(value: Column) -> Column:
    plain = F.coalesce(F.try_url_decode(F.replace(value, F.lit("+"), F.lit("%2B"))), value)
    return ~tx.is_placeholder(plain) & ~plain.rlike("[<>$`{}]")


def userinfo(text: Column, path: Column) -> Column:
    inner = F.filter(tx.group_spans(text, v.USERINFO, 1), lambda s: _literal_secret(s["value"]))
    nats = F.filter(tx.spans(text, "(?<=\\bnats://)[^\\s/:@\"'<>`]+(?=@)"), lambda s: _literal_secret(s["value"]))
    rule = "privacy.credential.uri-userinfo"
    return _if(text.contains("://"), F.concat(_as(inner, rule, "URL authority contains literal authentication material"), _as(nats, rule, "NATS URL authority contains a literal access token")))


def authentication(text: Column, path: Column) -> Column:
    rule, basis = "privacy.credential.auth-header", "Literal authentication header, cookie, or signed-query value"

    def cut(s: Column) -> Column:
        value = F.regexp_replace(s["value"], "[&;,]+\\z", "")
        return F.struct(s["start"].alias("start"), (s["start"] + F.length(value)).alias("end"), value.alias("value"))

    def header(s: Column) -> Column:
        raw = F.regexp_extract(s["value"], v.AUTH_HEADER, 3)
        value = F.regexp_replace(raw, "[&;,]+\\z", "")
        start = s["start"] + F.length(s["value"]) - F.length(raw)
        scheme = F.lower(F.regexp_extract(s["value"], v.AUTH_HEADER, 2))
        name = F.lower(F.regexp_extract(s["value"], v.AUTH_HEADER, 1))
        tail = F.rtrim(F.regexp_extract(F.substring(text, start + F.length(value) + 1, F.lit(1 << 30)), "^[^\\r\\n\"']*", 0))
        whole = F.when((scheme == "") & name.endswith("authorization"), F.concat(value, tail)).otherwise(value)
        decoded = F.try_to_binary(F.when(value.rlike("^[A-Za-z0-9+/]*={0,2}\\z") & (F.length(value) % 4 == 0), value), F.lit("base64")).cast("string")
        basic = F.coalesce(decoded.contains(":") & ~tx.is_placeholder(F.regexp_replace(decoded, "(?s)^[^:]*:", "")), F.lit(False))
        return F.struct(start.cast("int").alias("start"), (start + F.length(whole)).cast("int").alias("end"), whole.alias("value"), ((scheme != "basic") | basic).alias("ok"))

    headers = F.filter(F.transform(tx.spans(text, v.AUTH_HEADER), header), lambda s: s["ok"] & _literal_secret(s["value"]))
    some = lambda pattern: F.filter(F.transform(tx.group_spans(text, pattern, 1), cut), lambda s: _literal_secret(s["value"]))
    return _if(text.contains("=") | text.contains(":"), F.concat(_as(headers, rule, basis), _as(some(v.COOKIE), rule, basis), _as(some(v.SIGNED_QUERY), rule, basis)))


def paths(text: Column, path: Column) -> Column:
    def public(s: Column) -> Column:
        value = F.lower(F.regexp_replace(F.replace(s["value"], F.lit("\\"), F.lit("/")), "/+\\z", ""))
        return value.isin(v.PUBLIC_FILES) | value.rlike("[${}<>]") | value.rlike("^" + tx.one_of(v.PUBLIC_ROOTS) + "(?:/|\\z)")

    def templated(s: Column) -> Column:
        parts = F.split(F.lower(F.replace(s["value"], F.lit("\\"), F.lit("/"))), "/", -1)
        at = F.array_min(F.filter(F.array(F.array_position(parts, "users"), F.array_position(parts, "home")), lambda i: i > 0))
        return F.coalesce(F.get(parts, at.cast("int")).rlike("[$<>`{}]"), F.lit(False))

    deployment = lambda p: F.filter(tx.spans(text, p), lambda s: ~public(s))
    machine = lambda p: F.filter(tx.spans(text, p), lambda s: ~templated(s))
    rule, basis = "privacy.local.deployment-path", "Machine-specific deployment, temporary, volume, or workspace path"
    slashed = text.contains("/") | text.contains("\\")
    return _if(
        slashed,
        F.concat(
            _as(deployment(v.DEPLOYMENT_PATH), rule, basis),
            _as(deployment(v.WINDOWS_WORKSPACE), rule, basis),
            _as(machine(v.HOME_PATH), "privacy.local.machine-path", "Machine-local account or volume path"),
            _as(machine(v.VOLUME_PATH), "privacy.local.machine-path", "Machine-local account or volume path"),
        ),
    )


def resources(text: Column, path: Column) -> Column:
    p = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    return _if(p.rlike("^" + tx.one_of(v.OPERATIONAL_ROOTS)) | p.rlike(tx.one_of(v.OPERATIONAL_SCRIPTS) + "\\z"), _as(tx.spans(text, v.RESOURCE_ID), "privacy.backend.resource-id", "Provider resource identifier in operational material"))


def keys(text: Column, path: Column) -> Column:
    """Private key blocks and markers, SSH public keys, private members of JSON web keys, signed and encrypted tokens."""
    return F.concat(
        _if(text.contains("-----BEGIN "), km.private_blocks(text)),
        _if(text.contains("ssh-") | text.contains("ecdsa-"), km.ssh_keys(text)),
        _if(text.contains("kty") | text.contains("\\u00"), km.web_keys(text)),
        _if(text.rlike(km.HEADER), F.concat(km.signed_tokens(text), km.encrypted_tokens(text))),
    )


#: Families that always run; the opt-in groups follow in patterns().
FAMILIES = (bound, token_formats, keys, userinfo, authentication, endpoints, network, personal, paths, resources)


def patterns(text: Column, path: Column, groups: list[str]) -> Column:
    """The pattern rules of the chosen groups, where they apply."""
    p = F.lower(path)
    place = {"code": p.rlike("\\.(?:" + "|".join(v.CODE_SUFFIXES) + ")\\z"), "workflows": path.startswith(".github/workflows/") & p.rlike("\\.ya?ml\\z"), "dependencies": F.lit(True)}
    found = [_if(place[g], _as(tx.spans(text, pattern), rule, "Pattern rule")) for rule, _, g, pattern in v.PATTERN_RULES if g in groups]
    return F.concat(*found) if found else _empty()


def rules_table(spark) -> DataFrame:
    """The catalog: rule, category and topic of every rule."""
    rules = [f"privacy.credential.provider.{k}" for k in v.PROVIDER_FIELDS] + ["privacy.credential.binding"] + [f"privacy.credential.format.{k}" for k, _ in v.TOKEN_FORMATS]
    rules += ["privacy.key.private-pem", "privacy.key.ssh-public", "privacy.key.private-jwk", "privacy.token.signed-jose", "privacy.token.encrypted-jose", "privacy.credential.uri-userinfo", "privacy.credential.auth-header"]
    rules += ["privacy.endpoint.private-host", "privacy.endpoint.ip-address", "privacy.personal.record-field", "privacy.personal.identifier", "privacy.business.assignment", "privacy.backend.metadata", "privacy.backend.resource-id", "privacy.endpoint.host-binding", "privacy.local.deployment-path", "privacy.local.machine-path"]
    rules += [r for r, _, _, _ in v.PATTERN_RULES]
    return spark.createDataFrame([(r, v.category(r), v.TOPICS.get(v.category(r))) for r in rules], "rule string, category string, topic string")


@lru_cache(maxsize=64)
def _found(families: tuple, groups: tuple[str, ...], places: bool, context: bool) -> Column:
    """The array of candidates of the columns text and path; kept, as building it takes thousands of calls to the JVM."""
    text, path = F.col("text"), F.col("path")
    found = [f(text, path) for f in families]
    if groups:
        found.append(patterns(text, path, list(groups)))
    named = lambda c, *more: F.struct(*(c[k].alias(k) for k in ("rule", "start", "end", "basis", "value")), *more)

    def first_of_each(all_: Column) -> Column:
        # Ordered by rule and span, and then by the families' order: the first of each run of equal spans is kept.
        ordered = F.sort_array(F.transform(all_, lambda c, i: F.struct(c["rule"], c["start"], c["end"], i.alias("i"), c["basis"], c["value"])))
        same = lambda a, b: F.coalesce((a["rule"] == b["rule"]) & (a["start"] == b["start"]) & (a["end"] == b["end"]), F.lit(False))
        return tx.bind(ordered, lambda o: F.filter(o, lambda c, i: ~same(F.get(o, i - 1), c)))

    def placed(kept: Column) -> Column:
        if not places:
            return F.transform(kept, lambda c: named(c))
        at = tx.with_places(text, kept, lambda c, line, column: named(c, line.alias("line"), column.alias("column")))
        around = lambda c, lines: named(c, c["line"].alias("line"), c["column"].alias("column"), tx.lines_around(lines, c["line"]).alias("context"))
        return tx.bind(F.split(text, "\n", -1), lambda lines: F.transform(at, lambda c: around(c, lines))) if context else at

    return tx.bind(F.concat(*found), lambda all_: F.when(F.size(all_) > 0, tx.bind(first_of_each(all_), placed)))


def candidates(df: DataFrame, families=FAMILIES, groups: list[str] = (), places: bool = True, context: bool = False) -> DataFrame:
    """df's columns and one row per candidate: rule, start, end, basis, the located value, and line and column if places are asked for.

    df has text and path. Equal spans of one rule collapse to the first in the families' order. Places, and the lines
    around a candidate (context), are found before the rows are made, from one pass over the text.
    """
    rows = df.where(F.col("text").isNotNull()).select(*df.columns, F.explode(_found(tuple(families), tuple(groups), places or context, context)).alias("_c"))
    return rows.select(*df.columns, *(F.col(f"_c.{c}").alias(c) for c in ("rule", "start", "end", "basis", "value", *(("line", "column") if places or context else ()), *(("context",) if context else ()))))


def located(found: DataFrame, local: bool = False) -> DataFrame:
    """Findings without the text; local ones carry the value and its context, others neither."""
    if local:
        return found.drop("text") if "context" in found.columns else found.withColumn("context", tx.context_of(F.col("text"), F.col("line"))).drop("text")
    return found.withColumn("file", tx.redact_path(F.col("path"))).withColumn("evidence", F.lit("[source value withheld]")).drop("text", "value")


#: What orders the versions of a path's object.
ORDER = ("seq", "commit", "doc_id")


def introduced(found: DataFrame) -> DataFrame:
    """Each finding of a (path, object) once, from the version that introduces it: one aggregation of rows without texts.

    Versions of one object have the same text, and so the same findings at the same places; the first version's stay.
    """
    keys = [k for k in ("path", "oid", "rule", "start", "end") if k in found.columns]
    rest = [c for c in found.columns if c not in keys]
    one = F.min_by(F.struct(*(F.col(f"`{c}`") for c in rest)), F.struct(*ORDER)).alias("_v")
    return found.groupBy(*keys).agg(one).select(*(F.col(c) if c in keys else F.col("_v")[c].alias(c) for c in found.columns))


def first_versions(versions: DataFrame) -> DataFrame:
    """The introducing version of each (path, oid), chosen from rows without texts.

    Rows with a text are joined with the chosen keys, so that no task sorts an object's copies; rows that repeat path,
    oid, seq, commit and doc_id are one version, and stay each.
    """
    if "text" not in versions.columns:
        rest = [c for c in versions.columns if c not in ("path", "oid")]
        one = versions.groupBy("path", "oid").agg(F.min_by(F.struct(*rest), F.struct(*ORDER)).alias("_v"))
        return one.select(*(F.col(c) if c in ("path", "oid") else F.col("_v")[c].alias(c) for c in versions.columns))
    first = versions.groupBy("path", "oid").agg(F.min(F.struct(*ORDER)).alias("_k"))
    first = first.select(F.col("path").alias("_path"), F.col("oid").alias("_oid"), *(F.col("_k")[c].alias(f"_{c}") for c in ORDER))
    on = (F.col("path") == F.col("_path")) & (F.col("oid") == F.col("_oid"))
    for c in ORDER:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return versions.join(first, on, "left_semi")
