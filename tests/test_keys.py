"""Key material: structure, wire format and encoding."""

import base64
import json
import time

import pytest
from pyspark.sql import functions as F

from lodestone.functions import values as v
from lodestone.operators.detect import candidates, keys


def found(spark, texts):
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "path string, text string")
    out = [[] for _ in texts]
    for r in candidates(df, (keys,)).collect():
        assert texts[int(r.path)][r.start : r.end] == r.value
        out[int(r.path)].append((r.rule.split(".")[-1], r.value, r.basis))
    return [sorted(x) for x in out]


def values(spark, texts):
    return [[x for _, x, _ in one] for one in found(spark, texts)]


WEB = [
    ('{"kty":"EC","d":"secret1","x":"open"}', ["secret1"]),
    ('{"d":"before","kty":"OKP"}', ["before"]),
    ('{"kty":"RSA","n":"n","d":"a1","p":"b1","q":"c1","dp":"d1","dq":"e1","qi":"f1","e":"AQAB"}', ["a1", "b1", "c1", "d1", "e1", "f1"]),
    ('{"kty":"RSA","oth":"o1","oth2":"no"}', ["o1"]),
    ('{"kty":"RSA","d":"own","oth":[{"r":"r1","d":"inner","t":"t1"}]}', ["own"]),
    ('{"keys":[{"kty":"oct","k":"one"},{"kty":"EC","d":"two","crv":"P-256"}],"d":"none"}', ["one", "two"]),
    ('{"a":{"b":{"c":{"kty":"EC","d":"deep"}}}}', ["deep"]),
    ('{"kty":"EC","nested":{"kty":"oct","k":"inner","d":"no"},"d":"outer"}', ["inner", "outer"]),
    ('{"kty":"EC","note":"a } brace { and \\" quote","d":"kept"}', ["kept"]),
    ('const jwk = {"kty" : "EC",\n\t"d"\n:\n"spaced"}; // } more {', ["spaced"]),
    ('{"\\u006bty":"EC","\\u0064":"escaped\\u0021"}', ["escaped\\u0021"]),
    ('{"kty":"EC","d":""}', []),
    ('{"kty":"EC","d":"<your-key>"}', []),
    ('{"kty":"EC","d":"${KEY}"}', []),
    ('{"kty":"EC","d":12}', []),
    ('{"kty":"XX","d":"other"}', []),
    ('{"kty":"XX","kty":"EC","d":"second type"}', []),
    ('{"kty":"EC","k":"not its member"}', []),
    ('"kty":"EC","d":"no object"', []),
    ('{"kty":"EC","d":"never closed"', []),
    ('} {"kty":"EC","d":"after a stray brace"}', ["after a stray brace"]),
    ('say "unbalanced {"kty":"EC","d":"odd"}', []),
    ('say "balanced" {"kty":"EC","d":"even"}', ["even"]),
    ('{"kty":"EC","x":"line\nbreak","d":"control"}', []),
    ("{'kty':'EC','d':'single quotes'}", []),
]


def test_web_keys(spark):
    assert values(spark, [t for t, _ in WEB]) == [w for _, w in WEB]


def test_web_keys_take_linear_time(spark):
    one = '{"kty":"EC","d":"s%d","note":"' + "x" * 60 + '"}'
    long = '{"keys":[' + ",".join(one % i for i in range(1000)) + "]}"
    deep = '{"a":' * 3000 + '{"kty":"EC","d":"s"}' + "}" * 3000
    text = '{"kty":"EC","d":"s","note":"' + "\\n" * 50_000 + '"}'
    values(spark, ['{"kty":"EC","d":"warm"}'])
    for t, n in ((long, 1000), (deep, 1), (text, 1)):
        began = time.time()
        assert len(values(spark, [t])[0]) == n
        assert time.time() - began < 8


def field(*parts):
    return b"".join(len(p).to_bytes(4, "big") + p for p in parts)


def key(kind, *parts, tail=b"", encode=None):
    return f"{kind} {base64.b64encode(field((encode or kind).encode(), *parts) + tail).decode()}"


SSH = [
    (key("ssh-ed25519", b"k" * 32), True),
    (key("ssh-ed25519", b"k" * 31), False),
    (key("ssh-ed25519", b"k" * 32, tail=b"x"), False),
    (key("ssh-ed25519", b"k" * 32, encode="ssh-rsa"), False),
    (key("ssh-ed25519-cert-v01@openssh.com", b"k" * 32), False),
    (key("ssh-ed25519-cert-v01@openssh.com", b"k" * 32, b"more"), True),
    (key("ssh-rsa", b"\x01\x00\x01", b"m" * 129), True),
    (key("ssh-rsa", b"\x01\x00\x01"), False),
    (key("ssh-rsa", b"", b"m" * 129), False),
    (key("ssh-rsa", b"\x01\x00\x01", b""), False),
    (key("ssh-rsa", b"\x01\x00\x01", b"m" * 129, b"more"), False),
    (key("ssh-rsa-cert-v01@openssh.com", b"e", b"m", b"more"), True),
    (key("ssh-rsa-cert-v01@openssh.com", b"e", b"m"), False),
    *((key(f"ecdsa-sha2-{c}", c.encode(), b"p" * 65), True) for c in ("nistp256", "nistp384", "nistp521")),
    (key("ecdsa-sha2-nistp256", b"nistp384", b"p" * 65), False),
    (key("ecdsa-sha2-nistp256", b"nistp256", b""), False),
    *((key(f"ecdsa-sha2-{c}-cert-v01@openssh.com", c.encode(), b"p", b"more"), True) for c in ("nistp256", "nistp384", "nistp521")),
    (key("ecdsa-sha2-nistp521-cert-v01@openssh.com", b"nistp521", b"p"), False),
    (key("ssh-dss", b"p"), True),
    (key("ssh-dss"), False),
    (key("sk-ssh-ed25519@openssh.com", b"p", b"ssh:"), True),
    (key("sk-ecdsa-sha2-nistp256@openssh.com"), False),
    ("ssh-rsa " + base64.b64encode(field(b"ssh-rsa", b"e", b"m" * 50)[:-1]).decode(), False),
    ("ssh-rsa AAAA", False),
    ("ssh-rsa " + base64.b64encode(b"\xff\xff\xff\xffssh-rsa").decode(), False),
    ("ssh-ed25519 " + base64.b64encode(field(b"ssh-ed25519", b"k" * 32)).decode() + "=", False),
    ("x-" + key("ssh-ed25519", b"k" * 32), False),
]


def test_ssh_keys(spark):
    got = values(spark, [f"{t} comment" for t, _ in SSH])
    assert [(t, bool(g)) for (t, _), g in zip(SSH, got, strict=True)] == SSH
    assert all(g == [t] for (t, ok), g in zip(SSH, got, strict=True) if ok)


def test_private_blocks(spark):
    body = base64.b64encode(b"z" * 40).decode()
    begin, end = "-----BEGIN %s-----", "-----END %s-----"
    block = lambda kind, inner: f"{begin % kind}{inner}{end % kind}"
    good = [block("RSA PRIVATE KEY", f"\n{body[:20]}\n  {body[20:]}\n"), block("PRIVATE KEY", f"\\n{body}\\r\\n"), block("ENCRYPTED PRIVATE KEY", f"\r\nProc-Type: 4,ENCRYPTED\r\nDEK-Info: AES\r\n{body}\r\n")]
    bad = [block("EC PRIVATE KEY", "\nnot base64!\n"), block("PRIVATE KEY", ""), block("OPENSSH PRIVATE KEY", "\nAAA\n")]
    got = found(spark, good + bad)
    assert [[(x, b) for _, x, b in g] for g in got] == [[(t, v.BASIS["pem-decodes"])] for t in good] + [[(t, v.BASIS["pem-block"])] for t in bad]
    marker, pgp = begin % "EC PRIVATE KEY", begin % "PGP PRIVATE KEY BLOCK"
    text = f"{marker} {block('PRIVATE KEY', begin % 'RSA PRIVATE KEY')} {pgp} {end % 'PGP PRIVATE KEY BLOCK'}"
    assert sorted((x, b) for _, x, b in found(spark, [text])[0]) == sorted([(marker, v.BASIS["pem-marker"]), (block("PRIVATE KEY", begin % "RSA PRIVATE KEY"), v.BASIS["pem-block"]), (begin % "RSA PRIVATE KEY", v.BASIS["pem-marker"]), (pgp, v.BASIS["pem-marker"])])


def seg(x):
    return base64.urlsafe_b64encode(x if isinstance(x, bytes) else json.dumps(x).encode()).decode().rstrip("=")


TOKENS = [
    (f"{seg({'alg': 'HS256'})}.{seg({'sub': '1'})}.{seg(b'sig')}", True),
    (f"{seg({'alg': 'none'})}.{seg({'sub': '1'})}.", True),
    (f"{seg({'alg': 'NONE'})}.{seg({})}.", True),
    (f"{seg({'alg': 'none'})}.{seg({'sub': '1'})}.{seg(b'sig')}", False),
    (f"{seg({'alg': 'HS256'})}.{seg({'sub': '1'})}.", False),
    (f"{seg({'alg': 5, 'long': 'header'})}.{seg({'sub': '1'})}.{seg(b'sig')}", False),
    (f"{seg({'alg': '', 'long': 'header'})}.{seg({'sub': '1'})}.{seg(b'sig')}", False),
    (f"{seg({'alg': 'HS256'})}.{seg(['list'])}.{seg(b'sig')}", False),
    (f"{seg(['alg', 'HS256', 'x'])}.{seg({})}.{seg(b'sig')}", False),
    (f"{seg(b'{broken json here')}.{seg({})}.{seg(b'sig')}", False),
    (f"{seg({'alg': 'HS256'})}.{seg({'sub': '1'})}.A", False),
    (f"{seg(b' {\"alg\": \"HS256\"}')}.{seg({})}.{seg(b'sig')}", True),
    (f"{seg({'alg': 'RSA-OAEP', 'enc': 'A'})}.{seg(b'k')}.{seg(b'iv')}.{seg(b'c')}.{seg(b't')}", True),
    (f"{seg({'alg': 'dir', 'enc': 'A'})}..{seg(b'iv')}.{seg(b'c')}.{seg(b't')}", True),
    (f"{seg({'alg': 'ECDH-ES', 'enc': 'A'})}..{seg(b'iv')}.{seg(b'c')}.{seg(b't')}", True),
    (f"{seg({'alg': 'RSA-OAEP', 'enc': 'A'})}..{seg(b'iv')}.{seg(b'c')}.{seg(b't')}", False),
    (f"{seg({'alg': 'dir', 'enc': 'A'})}...{seg(b'c')}.{seg(b't')}", False),
    (f"{seg({'alg': 'dir', 'enc': 'A'})}..{seg(b'iv')}.{seg(b'c')}.", False),
    (f"{seg({'alg': 'dir', 'cty': 'A'})}..{seg(b'iv')}.{seg(b'c')}.{seg(b't')}", False),
]


def test_compact_tokens(spark):
    got = values(spark, [f"token: {t}, next" for t, _ in TOKENS])
    assert [(t, g == [t]) for (t, _), g in zip(TOKENS, got, strict=True)] == TOKENS


@pytest.mark.parametrize("text", ["", "no keys here", None])
def test_nothing(spark, text):
    assert spark.createDataFrame([("p", text)], "path string, text string").select(F.size(keys(F.col("text"), F.col("path")))).first()[0] in (0, -1, None)
