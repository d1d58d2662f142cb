"""Key material within texts: private key blocks, SSH public keys in wire format, JSON web keys, compact tokens.

Each function takes the text column and gives an array of spans with a rule and a basis. All of them stay in Catalyst:
structure is read from the tokens that one regular expression cuts out, nesting by a fold that holds the open objects.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import values as v
from .text import bind, is_placeholder, spans

#: A JSON string, a field whose value is one, and what structures objects. Possessive groups match without recursion.
_STRING = r"\"[^\"\\\x00-\x1f]*+(?:\\(?:[\"\\/bfnrt]|u[0-9a-fA-F]{4})[^\"\\\x00-\x1f]*+)*+\""
_BLANK = r"[\p{IsWhite_Space}\x1c-\x1f]*+"
_FIELD = rf"({_STRING}){_BLANK}:{_BLANK}({_STRING})"
_JSON = rf"{_FIELD}|{_STRING}|[{{}}]"
_SSH = r"(?U)(?<![\w-])(" + "|".join(re.escape(k) for k in v.SSH_KINDS) + r")[ \t]+([A-Za-z0-9+/]+={0,2})(?![A-Za-z0-9+/=])"
#: A segment long enough for a header with an algorithm, and what ends it: texts without one have no compact token.
HEADER = r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{15,}+\."
#: Members of a key that must stay private, by its type.
PRIVATE = {"RSA": ["d", "p", "q", "dp", "dq", "qi", "oth"], "EC": ["d"], "OKP": ["d"], "oct": ["k"]}


def _found(rule: str, basis: Column, s: Column) -> Column:
    return F.struct(F.lit(rule).alias("rule"), s["start"].alias("start"), s["end"].alias("end"), basis.alias("basis"), s["value"].alias("value"))


def _all(rule: str, basis: str, found: Column) -> Column:
    return F.transform(found, lambda s: _found(rule, F.lit(basis), s))


def _base64(value: Column) -> Column:
    """The bytes of padded base64; null for anything else."""
    ok = (F.length(value) % 4 == 0) & value.rlike(r"^[A-Za-z0-9+/]+={0,2}\z")
    return F.try_to_binary(F.when(ok, value), F.lit("base64"))


def _segment(value: Column) -> Column:
    """The bytes of a base64url segment without padding; null for anything else, and for an empty one."""
    plain = F.translate(value, "-_", "+/")
    return F.when(~value.rlike("[+/]"), _base64(F.concat(plain, F.repeat(F.lit("="), F.pmod(-F.length(value), F.lit(4))))))


# Private key blocks.


def _payload(block: Column) -> Column:
    """What a block has between its markers, without header lines and line ends, escaped ones too."""
    body = F.regexp_extract(block, v.PEM_BLOCK, 2)
    body = F.replace(F.replace(body, F.lit("\\r\\n"), F.lit("\n")), F.lit("\\n"), F.lit("\n"))
    lines = F.transform(F.split(body, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]", -1), lambda x: F.regexp_replace(x, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", ""))
    return F.array_join(F.filter(lines, lambda x: ~F.lower(x).rlike("^(?:proc-type:|dek-info:)")), "")


def private_blocks(text: Column) -> Column:
    """Delimited private keys, and markers that begin none."""
    rule = "privacy.key.private-pem"

    def both(blocks: Column) -> Column:
        basis = lambda s: F.when(F.octet_length(_base64(_payload(s["value"]))) > 0, v.BASIS["pem-decodes"]).otherwise(v.BASIS["pem-block"])
        starts = F.transform(blocks, lambda b: b["start"])
        bare = F.filter(spans(text, v.PEM), lambda s: ~F.array_contains(starts, s["start"]))
        return F.concat(F.transform(blocks, lambda s: _found(rule, basis(s), s)), _all(rule, v.BASIS["pem-marker"], bare))

    return bind(spans(text, v.PEM_BLOCK), both)


# SSH public keys.


def _field(blob: Column, at: Column) -> Column:
    """The length-prefixed bytes at a place and where they end; null if the blob ends before."""
    size = F.conv(F.hex(F.substring(blob, at + 1, F.lit(4))), 16, 10).cast("long")
    whole = (at + 4 <= F.octet_length(blob)) & (at + 4 + size <= F.octet_length(blob))
    return F.when(whole, F.struct(F.substring(blob, at + 5, size.cast("int")).alias("bytes"), (at + 4 + size).cast("int").alias("end")))


def wire_format(kind: Column, encoded: Column) -> Column:
    """Whether the blob is a key of that kind: its name, then the fields of its family to the end, or more behind them in a certificate.

    Security keys and DSA keys have further fields, which must begin.
    """

    def parts(blob: Column) -> Column:
        size = F.octet_length(blob)
        cert = kind.contains("-cert-v01@")
        ends = lambda at: F.when(cert, at < size).otherwise(at == size)

        def after_name(name: Column) -> Column:
            def after_first(one: Column) -> Column:
                def after_second(two: Column) -> Column:
                    some = (F.octet_length(one["bytes"]) > 0) & (F.octet_length(two["bytes"]) > 0) & ends(two["end"])
                    curve = F.regexp_extract(kind, "^ecdsa-sha2-(.*?)(?:-cert-v01@.*)?$", 1)
                    return F.when(kind.startswith("ssh-rsa"), some).otherwise((one["bytes"] == curve.cast("binary")) & some)

                edwards = (F.octet_length(one["bytes"]) == 32) & ends(one["end"])
                return F.when(kind.startswith("ssh-ed25519"), edwards).otherwise(bind(_field(blob, one["end"]), after_second))

            family = kind.startswith("ssh-ed25519") | kind.startswith("ssh-rsa") | kind.startswith("ecdsa-sha2-")
            rest = F.when(family, bind(_field(blob, name["end"]), after_first)).otherwise(name["end"] < size)
            return (name["bytes"] == kind.cast("binary")) & rest

        return bind(_field(blob, F.lit(0)), after_name)

    return F.coalesce(bind(_base64(encoded), parts), F.lit(False))


def ssh_keys(text: Column) -> Column:
    valid = lambda s: wire_format(F.regexp_extract(s["value"], _SSH, 1), F.regexp_extract(s["value"], _SSH, 2))
    return _all("privacy.key.ssh-public", v.BASIS["ssh-wire"], F.filter(spans(text, _SSH), valid))


# JSON web keys.


def _string(quoted: Column) -> Column:
    return F.get_json_object(F.concat(F.lit("["), quoted, F.lit("]")), "$[0]")


def _tokens(text: Column) -> Column:
    """Fields with string values, and braces, in order: start, end, key and value (null for braces), and what stands there."""

    def token(s: Column) -> Column:
        quoted = F.regexp_extract(s["value"], _FIELD, 2)
        key, value = (F.when(~s["value"].isin("{", "}"), _string(F.regexp_extract(s["value"], _FIELD, g))) for g in (1, 2))
        end = F.when(key.isNotNull(), s["end"] - 1).otherwise(s["end"])
        start = F.when(key.isNotNull(), s["end"] - F.length(quoted) + 1).otherwise(s["start"])
        return F.struct(start.alias("start"), end.alias("end"), key.alias("key"), value.alias("value"), F.when(key.isNull(), s["value"]).alias("brace"))

    return F.transform(F.filter(spans(text, _JSON), lambda s: s["value"].isin("{", "}") | s["value"].rlike(f"^{_FIELD}\\z")), token)


def _objects(tokens: Column) -> Column:
    """(open, close, kind) of the objects, by places among the tokens, whose first `kty` names a key type.

    A fold over braces and `kty` fields holds the open objects, each with its first `kty`; a closing brace takes the
    innermost one away, and one without an object is nothing.
    """
    stack = "array<struct<open:int,kind:string>>"
    seen = "array<struct<open:int,close:int,kind:string>>"
    marks = F.filter(F.transform(tokens, lambda t, i: F.struct(i.alias("at"), t["brace"].alias("brace"), F.when(t["key"] == "kty", t["value"]).alias("kind"), (t["key"] == "kty").alias("is_kind"))), lambda m: m["brace"].isNotNull() | m["is_kind"])
    start = F.struct(F.array().cast(stack).alias("open"), F.array().cast(seen).alias("done"))

    def step(s: Column, m: Column) -> Column:
        depth = F.size(s["open"])
        top = F.get(s["open"], depth - 1)
        below = F.slice(s["open"], F.lit(1), F.greatest(depth - 1, F.lit(0)))
        fresh = F.struct(m["at"].cast("int").alias("open"), F.lit(None).cast("string").alias("kind"))
        named = F.struct(top["open"].alias("open"), m["kind"].alias("kind"))
        opened = F.when(m["brace"] == "{", F.array_append(s["open"], fresh)).when(m["brace"] == "}", below).when((depth > 0) & top["kind"].isNull(), F.array_append(below, named)).otherwise(s["open"])
        ends = (m["brace"] == "}") & top["kind"].isin(list(PRIVATE))
        one = F.struct(top["open"].alias("open"), m["at"].cast("int").alias("close"), top["kind"].alias("kind"))
        return F.struct(opened.cast(stack).alias("open"), F.when(F.coalesce(ends, F.lit(False)), F.array_append(s["done"], one)).otherwise(s["done"]).cast(seen).alias("done"))

    return F.aggregate(marks, start, step, lambda s: s["done"])


def web_keys(text: Column) -> Column:
    """Private members of JSON web keys, at any depth and within any other text, each by its value's span."""
    members = F.create_map(*(x for k, names in PRIVATE.items() for x in (F.lit(k), F.array(*map(F.lit, names)))))
    kind = "array<struct<start:int,end:int,value:string>>"

    def secret(tokens: Column) -> Column:
        def of(o: Column) -> Column:
            inner = F.slice(tokens, o["open"] + 2, o["close"] - o["open"] - 1)
            state = F.struct(F.lit(0).alias("depth"), F.array().cast(kind).alias("found"))

            def step(s: Column, t: Column) -> Column:
                named = (s["depth"] == 0) & F.array_contains(F.element_at(members, o["kind"]), t["key"]) & (t["value"] != "") & ~is_placeholder(t["value"])
                depth = s["depth"] + F.when(t["brace"] == "{", 1).when(t["brace"] == "}", -1).otherwise(0)
                span = F.struct(t["start"].alias("start"), t["end"].alias("end"), t["value"].alias("value"))
                return F.struct(depth.alias("depth"), F.when(F.coalesce(named, F.lit(False)), F.array_append(s["found"], span)).otherwise(s["found"]).cast(kind).alias("found"))

            return F.aggregate(inner, state, step, lambda s: s["found"])

        return F.flatten(F.transform(_objects(tokens), of))

    def raw(s: Column) -> Column:
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), F.substring(text, s["start"] + 1, s["end"] - s["start"]).alias("value"))

    return _all("privacy.key.private-jwk", v.BASIS["jwk-member"], F.transform(bind(_tokens(text), secret), raw))


# Compact tokens.


def _json(segment: Column) -> Column:
    return F.try_parse_json(F.try_validate_utf8(_segment(segment).cast("string")))


def _member(json: Column, name: str) -> Column:
    """A member if it is a string."""
    got = F.try_variant_get(json, f"$.{name}", "variant")
    return F.when(F.schema_of_variant(got) == "STRING", F.try_variant_get(json, f"$.{name}", "string"))


def _is_object(json: Column) -> Column:
    return F.schema_of_variant(json).startswith("OBJECT")


def _or_empty(segment: Column) -> Column:
    return (segment == "") | _segment(segment).isNotNull()


def signed_tokens(text: Column) -> Column:
    """Three segments: a header with an algorithm, an object as payload, and a signature unless the algorithm is none."""

    def valid(s: Column) -> Column:
        def judged(p: Column) -> Column:
            alg = bind(_json(F.get(p, F.lit(0))), lambda h: F.when(_is_object(h), _member(h, "alg")))
            unsigned = F.get(p, F.lit(2)) == ""
            return bind(alg, lambda a: (F.length(a) > 0) & (unsigned == (F.lower(a) == "none"))) & _is_object(_json(F.get(p, F.lit(1)))) & _or_empty(F.get(p, F.lit(2)))

        return F.coalesce(bind(F.split(s["value"], "\\.", -1), judged), F.lit(False)) & ~is_placeholder(s["value"])

    return _all("privacy.token.signed-jose", v.BASIS["jws"], F.filter(spans(text, v.JOSE), valid))


def encrypted_tokens(text: Column) -> Column:
    """Five segments: a header with an algorithm and a cipher, a key (which a direct algorithm leaves empty), and three that decode."""

    def valid(s: Column) -> Column:
        def judged(p: Column) -> Column:
            part = lambda i: F.get(p, F.lit(i))

            def headed(h: Column) -> Column:
                truthy = lambda k: F.coalesce(~F.try_variant_get(h, f"$.{k}", "string").isin("", "0", "false"), F.lit(False))
                return _is_object(h) & truthy("alg") & truthy("enc") & ((part(1) != "") | F.coalesce(_member(h, "alg").isin("dir", "ECDH-ES"), F.lit(False)))

            return bind(_json(part(0)), headed) & _or_empty(part(1)) & _segment(part(2)).isNotNull() & _segment(part(3)).isNotNull() & _segment(part(4)).isNotNull()

        return F.coalesce(bind(F.split(s["value"], "\\.", -1), judged), F.lit(False)) & ~is_placeholder(s["value"])

    return _all("privacy.token.encrypted-jose", v.BASIS["jwe"], F.filter(spans(text, v.JWE), valid))
