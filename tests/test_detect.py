"""Detectors on constructed rows: what is found where, and what isn't."""

import base64
import json

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.operators.detect import candidates, located, rules_table


def b64(o):
    return base64.urlsafe_b64encode(json.dumps(o).encode()).decode().rstrip("=")


ED = base64.b64encode(b"\x00\x00\x00\x0bssh-ed25519\x00\x00\x00\x20" + bytes(range(32))).decode()
CERT = base64.b64encode(b"\x00\x00\x00\x28ecdsa-sha2-nistp256-cert-v01@openssh.com\x00\x00\x00\x08nistp256\x00\x00\x00\x20" + bytes(range(32)) + b"tail").decode()
KEY = "AKIA" + "ABCDEFGH23456723"

CASES = [
    # name, path, text, {rule suffix: values}
    ("provider", "a.py", 'OPENAI_API_KEY = "abcd1234efgh"', {"provider.openai": ["abcd1234efgh"]}),
    ("references", "a.py", "password = os.environ['X']\nsecret = replace-me\ntoken: <your-token>\npwd = '${PWD}'\napi_key = config.key", {}),
    ("multiline", "b.txt", 'password: "line one\nline two"', {"credential.binding": ["line one\nline two"]}),
    ("reserved", "b.txt", "authorization: Bearer", {"credential.binding": []}),
    ("access key", "c.txt", KEY, {"format.aws-key-id": [KEY]}),
    ("pem", "k.txt", "-----BEGIN RSA PRIVATE KEY-----\nAAAA\n-----END RSA PRIVATE KEY----- -----BEGIN PRIVATE KEY-----", {"private-pem": ["-----BEGIN RSA PRIVATE KEY-----\nAAAA\n-----END RSA PRIVATE KEY-----", "-----BEGIN PRIVATE KEY-----"]}),
    ("ssh", "k.txt", f"ssh-ed25519 {ED} me", {"ssh-public": [f"ssh-ed25519 {ED}"]}),
    ("ssh kind", "k.txt", f"ssh-rsa {ED} me", {}),
    ("pgp", "k.txt", "-----BEGIN PGP PRIVATE KEY----- x -----BEGIN PGP PRIVATE KEY BLOCK-----", {"private-pem": ["-----BEGIN PGP PRIVATE KEY-----", "-----BEGIN PGP PRIVATE KEY BLOCK-----"]}),
    ("ssh cert", "k.txt", f"ecdsa-sha2-nistp256-cert-v01@openssh.com {CERT} me", {"ssh-public": [f"ecdsa-sha2-nistp256-cert-v01@openssh.com {CERT}"]}),
    ("jwk", "j.txt", '{"kty":"EC","d":"abcdef"} {"kty":"EC","x":"abc"}', {"private-jwk": ["abcdef"]}),
    ("jws", "j.txt", f"{b64({'alg': 'HS256'})}.{b64({'sub': 'x'})}.c2ln {b64({'alg': 'none'})}.{b64({'sub': 'x'})}.c2ln", {"signed-jose": [f"{b64({'alg': 'HS256'})}.{b64({'sub': 'x'})}.c2ln"]}),
    ("jwe", "j.txt", f"{b64({'alg': 'dir', 'enc': 'A'})}..YQ.YQ.YQ", {"encrypted-jose": [f"{b64({'alg': 'dir', 'enc': 'A'})}..YQ.YQ.YQ"]}),
    ("ip", "i.txt", "127.0.0.1 192.0.2.5 8.8.8.8 08.8.8.8 2606:4700::1111 ::1 2001:db8::1", {"ip-address": ["8.8.8.8", "2606:4700::1111"]}),
    ("svg", "x.svg", '<path d="M 8.8.8.8 z"/>\n8.8.4.4', {"ip-address": ["8.8.4.4"]}),
    ("namespace", "n.rs", 'ab::cd "ef::ab"', {"ip-address": ["ef::ab"]}),
    ("personal", "p.txt", "bob@corp-mail.de +49 170 1234567, 123-45-6789 card 4111 1111 1111 1111 and 4111 1111 1111 1112", {"personal.identifier": ["bob@corp-mail.de", "+49 170 1234567", "123-45-6789", "4111 1111 1111 1111"]}),
    ("home", "p.txt", "/Users/bob/x /home/${USER}/y", {"machine-path": ["/Users/bob/x"]}),
    ("endpoint", "e.txt", "https://internal.corp.local/x, http://api.openai.com/v1 https://a.example.com https://api.openai.com.evil.io/", {"private-host": ["https://internal.corp.local/x", "https://api.openai.com.evil.io/"]}),
    ("userinfo", "e.txt", "postgres://u:hunter22@localhost/x postgres://u:${PW}@localhost/x", {"uri-userinfo": ["hunter22"], "personal.identifier": []}),
    ("auth", "h.txt", "Authorization: Basic " + base64.b64encode(b"u:secretpw").decode() + "\nAuthorization: Basic Zm9v", {"auth-header": [base64.b64encode(b"u:secretpw").decode()]}),
    ("fields", "deploy/x.tf", 'id 123e4567-e89b-12d3-a456-426614174000 bucket = "b-prod" deal_id = "D77" device_id = "A1"', {"resource-id": ["123e4567-e89b-12d3-a456-426614174000"], "backend.metadata": ["b-prod"], "business.assignment": ["D77"], "record-field": ["A1"]}),
    ("host", "x.tf", 'host = "db.corp-internal.io" url = "a.example.com"', {"host-binding": ["db.corp-internal.io"]}),
    ("paths", "x.txt", "/opt/app/run /etc/hosts /usr/local/bin/x C:\\dev\\repo\\x", {"deployment-path": ["/opt/app/run", "C:\\dev\\repo\\x"]}),
]


@pytest.fixture(scope="module")
def found(spark):
    df = spark.createDataFrame([(n, p, t) for n, p, t, _ in CASES], "case string, path string, text string")
    out = {}
    for r in located(candidates(df).withColumn("raw", F.col("text")), local=True).collect():
        assert r.raw[r.start : r.end] == r.value  # offsets are code points
        out.setdefault(r.case, {}).setdefault(r.rule, []).append(r)
    return out


@pytest.mark.parametrize("name,path,text,want", CASES, ids=[c[0] for c in CASES])
def test_case(found, name, path, text, want):
    got = {rule: [r.value for r in sorted(rows, key=lambda r: r.start)] for rule, rows in found.get(name, {}).items()}
    for suffix, values in want.items():
        assert [v for rule, vs in got.items() if rule.endswith(suffix) for v in vs] == values
    if not want:
        assert got == {}


def test_lines_and_columns(spark):
    df = spark.createDataFrame([("a.txt", "αβγ 😀 bob@corp-mail.de\r\nx 8.8.4.4")], "path string, text string")
    rows = {r.value: (r.line, r.column) for r in located(candidates(df), local=True).collect()}
    assert rows == {"bob@corp-mail.de": (1, 7), "8.8.4.4": (2, 3)}


def test_withheld_rows_carry_no_value(spark):
    df = spark.createDataFrame([("a@b-corp.de/x.txt", "bob@corp-mail.de")], "path string, text string")
    out = located(candidates(df))
    assert "text" not in out.columns and "value" not in out.columns
    assert [r.file for r in out.collect()] == ["[redacted-email]/x.txt"]


def test_long_text_and_nulls(spark):
    df = spark.createDataFrame([("a.txt", "x " * 600000 + "bob@corp-mail.de"), ("b.txt", None), ("c.txt", "")], "path string, text string")
    rows = candidates(df).collect()
    assert [(r.path, r.start) for r in rows] == [("a.txt", 1200000)]


def test_many_findings_in_one_text(spark):
    """50,000 addresses over 50,000 lines: places by brute force, in time that grows with the text and not its square."""
    import re
    import time

    text = "".join(f"row {i} é 8.{i % 200}.{i // 200 % 250}.7 and\n" for i in range(50000))
    df = spark.createDataFrame([("a.csv", text)], "path string, text string")
    began = time.time()
    rows = candidates(df).select("rule", "start", "value", "line", "column").collect()
    took = time.time() - began
    got = {r.start: r for r in rows if r.rule.endswith("ip-address")}
    want = [m.start() for m in re.finditer(r"8\.\d+\.\d+\.7", text)]
    assert sorted(got) == want and len(want) == 50000
    for k in (0, 1, 999, 31234, 49999):
        r = got[want[k]]
        assert (r.line, r.column) == (k + 1, len(f"row {k} é ") + 1) and text[r.start :].startswith(r.value)
    assert took < 60


def test_catalog_is_unique(spark):
    rules = [r.rule for r in rules_table(spark).collect()]
    assert len(rules) == len(set(rules)) == 83 + 4


def test_globs(spark):
    for glob, path, hit in (("*.md", "a/b.md", True), ("a/?.md", "a/b.md", True), ("a/[!b].md", "a/b.md", False), ("**/x", "x", False), ("**/x", "a/b/x", True), ("a.b", "axb", False)):
        assert spark.range(1).select(tx.in_scope(F.lit(path), [glob]).alias("h")).first().h == hit


def test_placeholders(spark):
    values = [("<x>", True), ("your-key", True), (" changeme ", True), ("xxx", True), ("${A}", True), ("os.getenv('A')", True), ("s3cr3t-value", False), ("", True)]
    df = spark.createDataFrame(values, "v string, want boolean")
    assert df.where(tx.is_placeholder(F.col("v")) != F.col("want")).count() == 0
