"""Structural contracts over a tree of files (path, kind, size, text): each gives violation rows (rule, file, line, detail).

Policies are small tables or lists; a tree may be of any size, so that paths meet policies by equi-joins on paths and
their directories, by filters, or by semi-joins, and never by a product of the two.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.fixtures import schema_only
from . import shapes as sh

# File names, parts and suffixes of the contracts.
FORBIDDEN_NAMES = ".DS_Store Thumbs.db Desktop.ini .coverage coverage.xml flutter_export_environment.sh generated_plugin_registrant.cc generated_plugin_registrant.h generated_plugins.cmake .flutter-plugins .flutter-plugins-dependencies local.properties".split()
FORBIDDEN_PARTS = ".pytest_cache .mypy_cache .ruff_cache .tox .nox __pycache__ .dart_tool node_modules build dist out DerivedData".split()
FORBIDDEN_SUFFIXES = "~ .tmp .temp .bak .orig .rej .swp .swo .log .sqlite .sqlite3 .db .db-journal .parquet .arrow .npy .npz .pkl .pickle .dump .dmp .profraw .profdata .gcda .gcno .zip .tar .tgz .tar.gz .7z .rar".split()
MAX_BYTES = 5 * 1024 * 1024
BINARY_DATA = ".arrow .avro .db .feather .orc .parquet .sqlite .sqlite3 .xls .xlsx".split()
DATA_DUMPS = ".csv .tsv .sql .dump .jsonl .ndjson".split()
LOCAL_PREFIXES = ["docs/plans/", "docs/reports/", "cache/", "build/"]
AGENT_PREFIXES = ["skills/", ".agents/skills/", ".codex/skills/"]
REQUIRED_DOCUMENTS = "README.md README.zh-CN.md PRODUCT.md CONTRIBUTING.md CODE_OF_CONDUCT.md CHANGELOG.md LICENSE SECURITY.md docs/README.md docs/RUNBOOK.md docs/COMPATIBILITY.md docs/ENTITY-CONFIG-LAYOUT.md docs/adrs/README.md".split()
REQUIRED_SECTIONS = ["docs/architecture/", "docs/functionality/", "docs/protocols/", "docs/examples/"]
FORMAL_PREFIXES = REQUIRED_SECTIONS + ["docs/adrs/"]
FORMAL_FILES = ["docs/README.md", "docs/RUNBOOK.md", "docs/COMPATIBILITY.md", "docs/ENTITY-CONFIG-LAYOUT.md", "docs/STATUS.md"]
LINK = r"!?\[[^\]]*\]\(([^)]+)\)"
GENERATED = r"(?im)(?:<!--\s*generated(?:\s+projection)?\s*-->|^generated\s*:\s*(?:true|yes)\s*$)"
GENERATED_SOURCE = "(?i)(?:generated from|projection source|生成来源)"
GENERATED_UPDATE = "(?i)(?:regenerate|update (?:command|process)|更新方式|重新生成)"
LICENSE_FILES = ["LICENSE", "LICENSE.md", "LICENSE.txt", "COPYING", "COPYING.md", "COPYING.txt"]
NOTICE_FILES = ["LICENSE-POLICY.md", "NOTICE", "NOTICE.md", "README.md", "docs/LICENSE-POLICY.md"]
DEPENDENCY_MARKERS = ["dependency|依赖", "commercial|商业", "authorization|授权", "usage boundary|使用边界|边界"]
COMMERCIAL_TERMS = ["commercial license", "commercial authorization", "paid license", "subscription", "membership", "member-only", "trial license", "evaluation only", "proprietary", "商业授权", "商业许可证", "付费授权", "订阅", "会员制", "试用授权", "专有许可证"]
RESTRICTED_GLOBS = ".env .env.* **/.env **/.env.* **/.kube/** **/*kubeconfig* **/*.tfstate **/*.tfstate.* **/*.tfvars **/ansible/** **/deploy/prod/** **/deploy/production/** **/infra/** **/inventory.ini **/ops/** **/private/** **/prod/** **/production/** **/*.p12 **/*.pfx **/id_rsa **/id_ed25519 **/private/*.key **/private/*.pem **/production/*.key **/production/*.pem **/*prod*secret*.json **/*production*secret*.json".split()
BENIGN_MARKERS = "example sample template test fixture fake dummy placeholder public".split()
SCAN_SUFFIXES = ".c .cc .cpp .cxx .h .hh .hpp .py .sh .bash .yml .yaml .dart .js .ts .go .rs .java .kt .swift .md .toml .txt".split()
IGNORED_PARTS = ".git .dart_tool .pytest_cache .ruff_cache .venv __pycache__ build dist node_modules venv".split()
DANGEROUS = {
    "auth-bypass": ["allow_anonymous=true", "allow_anonymous = true", "skip_auth=true", "skip_auth = true", "auth_disabled=true", "auth_disabled = true", "disable_auth=true", "disable_auth = true"],
    "command-injection": ["shell=true", "shell = true", "os.system("],
    "custom-cryptography": ["custom crypto", "custom cryptography", "homegrown crypto", "roll your own crypto", "proprietary cipher", "xor cipher"],
    "csrf-disabled": ["csrf=false", "csrf = false", "csrf_disabled=true", "csrf_disabled = true", "csrf_exempt", "disable_csrf=true", "disable_csrf = true"],
    "cors-wildcard": ["access-control-allow-origin: *", "allow_origins=['*']", 'allow_origins=["*"]'],
    "jwt-none": ['"alg":"none"', '"alg": "none"', "'alg':'none'", "'alg': 'none'", "alg=none", "algorithm none"],
    "disabled-verification": ["verify_signature=false", "verify_signature = false", '"verify_signature": false', "rejectunauthorized: false", "ssl_verify=false", "tls_verify=false", "--no-check-certificate"],
    "default-credential": ["admin:admin", "password=password", "password = password", "default_password", "default_admin_password"],
    "debug-public-exposure": ["app.run(debug=true", "app.run(debug = true", "flask_debug=1", "django_debug=true"],
    "insecure-cookie": ["httponly=false", "http_only=false", "secure=false", "cookie_secure=false"],
    "insecure-random-secret": ["random.random secret", "random.random token", "random.random password", "math.random secret", "math.random token", "math.random password"],
    "rate-limit-disabled": ["rate_limit=false", "rate_limit = false", "rate_limit=0", "disable_rate_limit=true"],
    "ssrf-unrestricted-fetch": ["requests.get(url", "requests.post(url", "requests.put(url", "requests.delete(url", "urllib.request.urlopen(url", "fetch(url"],
    "weak-password-hash": ["hashlib.md5(password", "hashlib.sha1(password", "md5 password", "sha1 password", "password md5", "password sha1"],
    "plaintext-password-storage": ["plain text password", "plaintext password", "cleartext password", "store password as plain text", "store passwords as plain text", "password stored in plain text"],
}
TOOL_IDENTITY = r"(?i)(?<![a-z0-9])cursor(?:ai|bot|agent|[\s_.-]+(?:ai|bot|agent))?(?![a-z0-9])"
CONTRIBUTOR_FIELD = r"(?i)\b(?:authors?|contributors?|maintainers?|developers?|credits?)\b\s*[\"']?\s*[:=]"
CONTRIBUTOR_FILES = ".all-contributorsrc .mailmap authors authors.md authors.txt contributors contributors.md contributors.txt".split()
ATTRIBUTION_SUFFIXES = ".md .json .toml .yaml .yml .txt .xml".split()
LOOKBACK, FIELD_REACH = 1024, 512
FIELD_BEHIND = rf"(?dUs){CONTRIBUTOR_FIELD}.{{0,{FIELD_REACH}}}\z"
HEADED = r"(?dUims)\A(?:.*^|)#{1,6}\s+(?:authors?|contributors?|maintainers?|credits?)\s*?$(.*)\z"
TRAILER_LINE = r"(?i)^(?:co-authored-by|signed-off-by|authored-by|committed-by|generated-by|assisted-by|made-with)\s*:"
METADATA_FILES = "cargo.toml citation.cff composer.json package.json pom.xml pubspec.yaml pyproject.toml".split()

COLUMNS = ("rule", "file", "line", "detail")


def _rows(df: DataFrame, rule: str, file="path", line=None, detail="") -> DataFrame:
    line = F.lit(1) if line is None else line
    detail = F.lit(detail) if isinstance(detail, str) else detail
    return df.select(F.lit(rule).alias("rule"), F.col(file).alias("file"), line.cast("int").alias("line"), detail.alias("detail"))


def _list(spark: SparkSession, values: list[str], name: str = "value") -> DataFrame:
    return spark.createDataFrame([(x,) for x in values], f"{name} string")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/", -1), -1)


def suffix(path: Column) -> Column:
    """The lower-case suffix with its dot, or nothing."""
    return F.lower(F.regexp_extract(base_name(path), "(?s)^.+(\\.[^.]+)\\z", 1))


def places(tree: DataFrame) -> DataFrame:
    """All paths and all of their directories, once each: what a required path or a link may name."""
    parts = F.split("path", "/", -1)
    return tree.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("place")).distinct()


def marker_norm(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "(?U)\\s+", " ")


def has_marker(text: Column, group: str) -> Column:
    """Whether any alternative of a|b|c stands in the text, without case and with single spaces."""
    out = F.lit(False)
    for one in group.split("|"):
        if one:
            out = out | marker_norm(text).contains(re.sub(r"\s+", " ", one.lower()))
    return out


def required_paths(tree: DataFrame, required: list[str]) -> DataFrame:
    want = _list(tree.sparkSession, required, "path").withColumn("place", F.regexp_replace("path", "/+\\z", ""))
    return _rows(want.join(places(tree), "place", "left_anti"), "repository.required-path")


def hygiene(tree: DataFrame) -> DataFrame:
    name = base_name(F.col("path"))
    bad = name.isin(FORBIDDEN_NAMES) | F.arrays_overlap(F.split("path", "/", -1), F.array(*map(F.lit, FORBIDDEN_PARTS))) | name.rlike(tx.one_of(FORBIDDEN_SUFFIXES) + "\\z")
    return _rows(tree.where(bad | (F.col("size") > MAX_BYTES)), "repository.hygiene", detail=F.when(bad, "artifact").otherwise("size"))


def data_verdict(fixtures: list[str] = ()) -> Column:
    """binary or dump for a data artifact, else null; admitted dump fixtures may hold table and index definitions only."""
    ok = F.col("path").isin(list(fixtures)) & schema_only(F.col("text")) if fixtures else F.lit(False)
    s = suffix(F.col("path"))
    return F.when(s.isin(BINARY_DATA), "binary").when(s.isin(DATA_DUMPS) & ~ok, "dump")


def data_files(tree: DataFrame, fixtures: list[str] = ()) -> DataFrame:
    """Data artifacts that no fixture admits."""
    judged = tree.withColumn("_verdict", data_verdict(fixtures)).where("_verdict is not null")
    return _rows(judged, "repository.data-file-admission", detail=F.col("_verdict"))


def _json_verdict(tree: DataFrame, admissions: DataFrame, paths: list[str], shapes: list[sh.Shape]) -> DataFrame:
    """The tree's JSON with admitted (the kind, profile, or null), json, and rule: what is wrong with it, or null.

    An admission of the very path decides by its kind; else a path that the profile admits must have one of its shapes.
    """
    some = tree.where((suffix(F.col("path")) == ".json") & (F.coalesce("kind", F.lit("blob")) == "blob"))
    one = admissions.groupBy("path").agg(F.min("kind").alias("admitted"))
    joined = some.join(one, "path", "left").withColumn("admitted", F.coalesce("admitted", F.when(sh.admitted(F.col("path"), paths), "profile")))
    parsed = joined.withColumn("json", F.try_parse_json("text"))
    shape = F.schema_of_variant("json")
    items = F.expr("try_variant_get(json, '$', 'array<string>')")
    pairs = F.expr("try_variant_get(json, '$', 'map<string,string>')")
    fits = (
        F.when(F.col("admitted") == "profile", sh.fits(F.col("json"), F.col("path"), shapes))
        .when(F.col("admitted") == "config-object", shape.startswith("OBJECT"))
        .when(F.col("admitted") == "json", shape.startswith("OBJECT") | shape.startswith("ARRAY"))
        .when(F.col("admitted") == "string-array", shape.isin("ARRAY<STRING>", "ARRAY<VOID>") & (F.size(items) <= 1000) & F.forall(items, lambda x: F.trim(x) != ""))
        .when(F.col("admitted") == "string-map", shape.startswith("OBJECT") & (F.size(pairs) <= 1000) & ~shape.rlike(": (?!STRING)"))
    )
    verdict = F.when(F.col("admitted").isNull(), "repository.json-not-allowlisted").when(F.col("json").isNull(), "repository.json-invalid").when(~F.coalesce(fits, F.lit(False)), "repository.json-shape-invalid")
    return parsed.withColumn("rule", verdict)


def json_files(tree: DataFrame, admissions: DataFrame, paths: list[str] = sh.COMMON_PATHS, shapes: list[sh.Shape] = sh.COMMON) -> DataFrame:
    """JSON outside the admissions (path, kind) and the profile's paths, JSON that isn't strict, and JSON of another shape than its kind or path."""
    out = _json_verdict(tree, admissions, paths, shapes).where(F.col("rule").isNotNull())
    return out.select("rule", F.col("path").alias("file"), F.lit(1).alias("line"), F.coalesce("admitted", F.lit("")).alias("detail"))


def historical_data(versions: DataFrame, head: DataFrame, admissions: DataFrame, fixtures: list[str] = (), paths: list[str] = sh.COMMON_PATHS, shapes: list[sh.Shape] = sh.COMMON) -> DataFrame:
    """The data contracts, shapes too, over versions (path, oid, commit, kind, size, text) that the head (path, oid) no longer has: rule, file, commit, detail, severity.

    Each version is judged once, like a file of a tree, at the commit where it first stands. JSON outside the admissions that is valid
    and gone from the head is a warning, everything else an error.
    """
    h = head.select("path", F.col("oid").alias("head_oid"))
    old = versions.join(h, "path", "left").where(~F.col("oid").eqNullSafe(F.col("head_oid")))
    once = old.groupBy("path", "oid").agg(F.min(F.struct("seq", "commit")).alias("first"), F.first("kind").alias("kind"), F.first("size").alias("size"), F.first("text").alias("text"), F.first("head_oid").isNull().alias("gone"))
    commit = F.col("first.commit").alias("commit")
    dumps = once.withColumn("detail", data_verdict(fixtures)).where("detail is not null")
    dumps = dumps.select(F.lit("repository.data-file-admission").alias("rule"), F.col("path").alias("file"), commit, "detail", F.lit("error").alias("severity"))
    judged = _json_verdict(once, admissions, paths, shapes).where(F.col("rule").isNotNull())
    mild = (F.col("rule") == "repository.json-not-allowlisted") & F.col("json").isNotNull() & F.col("gone")
    texts = judged.select("rule", F.col("path").alias("file"), commit, F.lit("").alias("detail"), F.when(mild, "warning").otherwise("error").alias("severity"))
    return dumps.unionByName(texts)


def incomplete_text(tree: DataFrame, rule: str) -> DataFrame:
    """What a contract that reads text can't judge: rule, file and reason of rows that aren't blobs, or have no text."""
    reason = F.when((F.coalesce("kind", F.lit("blob")) != "blob") | (F.coalesce("mode", F.lit("")) == "120000"), "non-text Git object").when(F.col("text").isNull() | F.col("text").contains("\x00"), "text unavailable")
    return tree.select(F.lit(rule).alias("rule"), F.col("path").alias("file"), reason.alias("reason")).where("reason is not null")


def is_document() -> Column:
    return F.col("path").startswith("docs/") & F.lower("path").endswith(".md")


def documents(tree: DataFrame, required: list[str] = REQUIRED_DOCUMENTS, sections: list[str] = REQUIRED_SECTIONS) -> DataFrame:
    """Entry points, sections, local assets, agent bundles, formal places and cross links of a documentation tree."""
    spark = tree.sparkSession
    p = F.col("path")
    missing = _rows(_list(spark, required, "path").join(tree.select("path"), "path", "left_anti"), "repository.documentation-required-path")
    want = _list(spark, [s.rstrip("/") for s in sections], "place")
    held = _rows(want.join(places(tree.where(is_document())), "place", "left_anti"), "repository.documentation-required-section", file="place")
    starts = lambda prefixes: F.greatest(*(p.startswith(x) for x in prefixes)) if len(prefixes) > 1 else p.startswith(prefixes[0])
    local = _rows(tree.where(starts(LOCAL_PREFIXES)), "repository.documentation-local-asset")
    agents = _rows(tree.where(starts(AGENT_PREFIXES) & (base_name(p) == "SKILL.md")), "repository.documentation-agent-entrypoint")
    localized = [f[:-3] + ".zh-CN.md" for f in FORMAL_FILES]
    formal = _rows(tree.where(is_document() & ~starts(FORMAL_PREFIXES) & ~p.isin(FORMAL_FILES + localized)), "repository.documentation-formal-path")
    other = F.when(p == "README.md", "README.zh-CN.md").when(p == "README.zh-CN.md", "README.md")
    pair = tree.where(other.isNotNull()).withColumn("other", other)
    pair = pair.join(tree.select(F.col("path").alias("other")), "other", "left_semi")
    linked = F.exists(F.regexp_extract_all("text", F.lit(r"(?<!!)\[[^\]]*\]\(([^)]+)\)"), 1), lambda x: F.regexp_replace(F.trim(x), "[#? ].*", "").rlike("(?:^|/)README(?:\\.zh-CN)?\\.md/*\\z") & F.regexp_replace(F.trim(x), "[#? ].*", "").endswith(F.col("other")))
    cross = _rows(pair.where(F.col("text").isNotNull() & ~linked), "repository.documentation-readme-cross-link")
    out = missing
    for more in (held, local, agents, formal, cross):
        out = out.unionByName(more)
    return out


def resolve(source: Column, target: Column) -> Column:
    """A link's path from the file that holds it; a folder above the root is the root."""
    clean = F.regexp_replace(F.try_url_decode(F.replace(F.regexp_replace(target, "[#?].*", ""), F.lit("+"), F.lit("%2B"))), "^\\s+|\\s+\\z", "")
    base = F.when(clean.startswith("/"), F.array().cast("array<string>")).otherwise(F.slice(F.split(source, "/", -1), F.lit(1), F.size(F.split(source, "/", -1)) - 1))
    parts = F.concat(base, F.split(clean, "/", -1))
    up = lambda a, x: F.when(x.isin("", "."), a).when(x == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(x)))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), up), "/")


def links(tree: DataFrame) -> DataFrame:
    """path, line and resolved target of every local link in Markdown files other than the root readmes."""
    md = tree.where(F.lower("path").endswith(".md") & ~F.col("path").isin("README.md", "README.zh-CN.md") & F.col("text").isNotNull())
    found = tx.with_places(F.col("text"), tx.spans(F.col("text"), LINK), lambda s, line, _: F.struct(s["value"].alias("value"), line.alias("line")))
    each = md.where(F.col("text").rlike(LINK)).select("path", F.explode(found).alias("s"))
    raw = F.trim(F.regexp_extract("s.value", LINK, 1))
    target = F.when(raw.startswith("<") & raw.endswith(">"), F.trim(F.regexp_replace(raw, "^<|>\\z", ""))).otherwise(F.regexp_extract(raw, "^\\S*", 0))
    local = each.withColumn("target", target).where((F.col("target") != "") & ~F.col("target").rlike("(?i)^(?:#|//|[a-z][a-z0-9+.-]*:)"))
    return local.select("path", F.col("s.line").alias("line"), resolve(F.col("path"), F.col("target")).alias("place"))


def broken_links(tree: DataFrame) -> DataFrame:
    lost = links(tree).join(places(tree), "place", "left_anti")
    return _rows(lost, "repository.documentation-link-target", line=F.col("line"), detail=F.col("place"))


def generated(tree: DataFrame) -> DataFrame:
    md = tree.where(F.lower("path").endswith(".md") & ~F.col("path").isin("README.md", "README.zh-CN.md") & F.col("text").isNotNull())
    made = md.where(F.col("path").endswith(".generated.md") | F.col("text").rlike(GENERATED))
    return _rows(made.where(~F.col("text").rlike(GENERATED_SOURCE)), "repository.documentation-generated-source").unionByName(_rows(made.where(~F.col("text").rlike(GENERATED_UPDATE)), "repository.documentation-generated-update"))


def required_refs(refs: DataFrame, required: list[str]) -> DataFrame:
    want = _list(refs.sparkSession, required, "path")
    have = refs.where(F.col("ref").startswith("refs/heads/")).select(F.substring("ref", 12, 1 << 20).alias("path")).distinct()
    return _rows(want.join(have, "path", "left_anti"), "repository.branch-required-ref")


def promotion_flow(requests: DataFrame, flows: list[tuple[str, str]], development: list[str]) -> DataFrame:
    """Pull requests (id, head, base) against the declared head-to-base flow: up to four breaches each."""
    heads, bases = [h for h, _ in flows], [b for _, b in flows]
    table = requests.sparkSession.createDataFrame(flows, "head string, expected string")
    r = requests.join(F.broadcast(table), "head", "left")  # as many rows as the policy has flows
    head, base, expected = F.col("head"), F.col("base"), F.col("expected")
    breaches = F.array(
        F.when(~base.isin(heads + bases + development), "base outside the flow"),
        F.when(expected.isNotNull() & (expected != base), "other base than declared"),
        F.when(expected.isNull() & head.isin(heads + bases) & ~head.isin(development), "managed branch outside its flow"),
        F.when(expected.isNull() & ~base.isin(development) & base.isin(bases), "not the declared predecessor"),
    )
    out = r.withColumn("detail", F.explode(F.array_compact(breaches)))
    return out.select(F.lit("repository.branch-promotion-flow").alias("rule"), F.col("id").cast("string").alias("file"), F.lit(1).alias("line"), "detail")


def license_evidence(tree: DataFrame, files: list[str] = LICENSE_FILES, spdx: list[str] = ("Apache-2.0",), markers: list[str] = ("Apache License", "Version 2.0"), notices: list[str] = NOTICE_FILES, notice_markers: list[str] = ("Apache", "License", "Version 2.0")) -> DataFrame:
    norm = marker_norm(F.col("text"))
    every = lambda ms: F.array_min(F.array(*(norm.contains(m.lower()) for m in ms)))
    good = F.array_max(F.array(*(norm.contains(s.lower()) for s in spdx))) | every(markers)
    facts = tree.where(F.col("path").isin(list(files) + list(notices))).agg(
        F.min(F.when(F.col("path").isin(list(files)), F.col("path"))).alias("file"),
        F.coalesce(F.bool_or(F.col("path").isin(list(files)) & F.coalesce(good, F.lit(False))), F.lit(False)).alias("valid"),
        F.coalesce(F.bool_or(F.col("path").isin(list(notices)) & F.coalesce(every(notice_markers), F.lit(False))), F.lit(False)).alias("noticed"),
    )
    wrong = F.array(
        F.when(F.col("file").isNull(), F.struct(F.lit(files[0]).alias("file"), F.lit("missing").alias("detail"))).when(~F.col("valid"), F.struct(F.col("file").alias("file"), F.lit("no evidence").alias("detail"))),
        F.when(~F.col("noticed"), F.struct(F.lit(notices[0]).alias("file"), F.lit("no notice").alias("detail"))),
    )
    return facts.select(F.explode(F.array_compact(wrong)).alias("w")).select(F.lit("repository.license-evidence").alias("rule"), "w.file", F.lit(1).alias("line"), "w.detail")


def _sections(text: Column) -> Column:
    """The tables of a TOML text: (header, body), the part before the first header under an empty one."""
    cut = F.split(F.concat(F.lit("\n"), F.regexp_replace(text, "\r\n", "\n")), "\n[ \\t]*\\[(?!\\[)", -1)
    return F.transform(cut, lambda x, i: F.struct(F.when(i > 0, F.trim(F.regexp_extract(x, "^([^\\n]*?)\\][ \\t]*(?:#[^\\n]*)?(?:\\n|\\z)", 1))).otherwise("").alias("header"), F.when(i > 0, F.regexp_replace(x, "^[^\\n]*", "")).otherwise(x).alias("body")))


def _strings(text: Column) -> Column:
    """What stands between quotes."""
    return F.transform(F.regexp_extract_all(text, F.lit("\"([^\"\\n]*)\"|'([^'\\n]*)'"), 0), lambda x: F.substring(x, F.lit(2), F.length(x) - 2))


def _array_of(body: Column, key: str) -> Column:
    """The strings of the arrays that stand under a key (a regular expression)."""
    return _strings(F.array_join(F.regexp_extract_all(body, F.lit(f"(?m)^[ \\t]*(?:{key})[ \\t]*=[ \\t]*\\[((?:[^\\]\"'#]|#[^\\n]*|\"[^\"\\n]*\"|'[^'\\n]*')*)\\]"), 1), " "))


def _keys(body: Column) -> Column:
    return F.transform(F.regexp_extract_all(body, F.lit("(?m)^[ \\t]*(\"[^\"]+\"|[A-Za-z0-9_.-]+)[ \\t]*="), 1), lambda x: F.regexp_replace(x, '"', ""))


def _requirement(x: Column) -> Column:
    """The name that a requirement begins with; nothing for options, paths and comments."""
    return F.regexp_extract(F.trim(F.regexp_replace(x, "[#;].*", "")), "^([A-Za-z0-9][A-Za-z0-9_.-]*)(?:\\s|\\[|[<>=!~@]|\\z)", 1)


def _members(x: Column, key: str) -> Column:
    """The keys of a JSON object, or the strings of a JSON array, under a key."""
    value = F.get_json_object(x, f"$.{key}")
    return F.coalesce(F.json_object_keys(value), F.from_json(value, "array<string>"), F.array().cast("array<string>"))


def _bare(text: Column, comment: str) -> Column:
    """A source without its comments; strings stay."""
    return F.regexp_replace(text, '(?s)("(?:\\\\.|[^"\\\\])*+")|' + comment, "$1")


def manifest_names(tree: DataFrame) -> DataFrame:
    """(path, name) of the dependencies that manifests of nine formats declare, as far as their lines and tables say so.

    Nothing is executed. A text that doesn't parse gives no names; manifest_errors tells which ones these are.
    """
    t, name = F.col("text"), base_name(F.col("path"))
    flat = lambda xs: F.flatten(F.transform(*xs))
    npm = F.concat(*(_members(t, k) for k in ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies", "bundledDependencies", "bundleDependencies")))

    def python_table(s: Column) -> Column:
        h, b = s["header"], s["body"]
        listed = F.when(h == "project", _array_of(b, "dependencies")).when(h == "project.optional-dependencies", _array_of(b, "[\"A-Za-z0-9_.-]+")).when(h == "build-system", _array_of(b, "requires")).otherwise(F.array().cast("array<string>"))
        poetry = F.when(h.rlike("^tool\\.poetry\\.(?:dev-)?dependencies\\z|^tool\\.poetry\\.group\\.[^.]+\\.dependencies\\z"), F.filter(_keys(b), lambda k: F.lower(k) != "python")).otherwise(F.array().cast("array<string>"))
        return F.concat(F.transform(listed, _requirement), poetry)

    def cargo_table(s: Column) -> Column:
        h, b = s["header"], s["body"]
        table = h.rlike("(?:^|\\.)(?:[a-z]+-)?dependencies\\z")
        one = F.regexp_extract(h, "(?:^|\\.)(?:[a-z]+-)?dependencies\\.([^.]+)\\z", 1)
        actual = F.regexp_extract_all(b, F.lit("\\bpackage\\s*=\\s*\"([^\"]+)\""), 1)
        return F.when(table, F.concat(_keys(b), actual)).when(one != "", F.concat(F.array(one), actual)).otherwise(F.array().cast("array<string>"))

    cmake = _bare(t, r"#\[(=*)\[.*?\]\2\]|#[^\n]*")
    named = F.regexp_extract_all(cmake, F.lit(r"""(?is)\b(?:find_package|FetchContent_Declare|ExternalProject_Add)\s*\(\s*["']?([A-Za-z0-9_.+-]+)|\bCPMAddPackage\s*\([^)]*?\bNAME\s+["']?([A-Za-z0-9_.+-]+)|"(?:\\.|[^"\\])*+\""""), 0)
    cmake_names = F.transform(F.filter(named, lambda x: ~x.startswith('"')), lambda x: F.regexp_extract(x, "([A-Za-z0-9_.+-]+)\\z", 1))
    go = F.regexp_replace(t, "//[^\n]*", "")
    block = F.array_join(F.regexp_extract_all(go, F.lit(r"(?ms)^\s*require\s*\(\s*$(.*?)^\s*\)\s*$"), 1), "\n")
    go_names = F.concat(F.regexp_extract_all(go, F.lit(r"(?m)^[ \t]*require[ \t]+([^\s(]+)[ \t]+v\S+[ \t]*$"), 1), F.regexp_extract_all(block, F.lit(r"(?m)^[ \t]*(\S+)[ \t]+v\S+[ \t]*$"), 1))

    def pub_part(part: Column) -> Column:
        lines = F.filter(F.split(part, "\n", -1), lambda x, i: (i > 0) & (F.trim(x) != "") & ~F.ltrim(x).startswith("#"))
        indent = F.regexp_extract(F.get(lines, F.lit(0)), "^( +)", 1)
        same = F.filter(lines, lambda x: (F.regexp_extract(x, "^( *)", 1) == indent) & x.rlike("^ *[A-Za-z0-9_]+:(?:\\s|\\z)"))
        return F.transform(same, lambda x: F.regexp_extract(x, "([A-Za-z0-9_]+):", 1))

    parts = F.filter(F.split(F.regexp_replace(t, "\r", ""), "(?m)^(?=[^\\s#])", -1), lambda x: x.rlike("^(?:dependencies|dev_dependencies|dependency_overrides):\\s*(?:\\{\\})?\\s*(?:#[^\n]*)?(?:\n|\\z)"))
    feature = F.map_values(F.coalesce(F.from_json(F.get_json_object(t, "$.features"), "map<string,struct<dependencies:array<string>>>"), F.create_map().cast("map<string,struct<dependencies:array<string>>>")))
    ports = F.concat(_members(t, "dependencies"), F.flatten(F.transform(feature, lambda x: F.coalesce(x["dependencies"], F.array().cast("array<string>")))))
    vcpkg = F.transform(ports, lambda x: F.when(x.startswith("{"), F.get_json_object(x, "$.name")).otherwise(x))
    calls = F.regexp_extract_all(_bare(t, r"/\*.*?\*/|//[^\n]*"), F.lit(r'\.package\s*\(((?:[^()"]|"[^"]*"|\([^()]*\))*)\)'), 1)
    last = lambda x: F.regexp_replace(F.element_at(F.split(F.regexp_replace(x, "/+\\z", ""), "/", -1), -1), "\\.git\\z", "")
    swift = F.flatten(F.transform(calls, lambda x: F.concat(F.regexp_extract_all(x, F.lit(r'\bname\s*:\s*"([^"\\]+)"'), 1), F.transform(F.regexp_extract_all(x, F.lit(r'\b(?:url|path)\s*:\s*"([^"\\]+)"'), 1), last))))
    found = (
        F.when(name.isin("package.json", "package-lock.json"), npm)
        .when(name == "pyproject.toml", flat((_sections(t), python_table)))
        .when(name == "Cargo.toml", flat((_sections(t), cargo_table)))
        .when(name == "CMakeLists.txt", cmake_names)
        .when(name == "go.mod", go_names)
        .when(name.rlike("^requirements.*\\.txt\\z"), F.transform(F.split(t, "\r?\n", -1), _requirement))
        .when(name == "pubspec.yaml", flat((parts, pub_part)))
        .when(name == "vcpkg.json", vcpkg)
        .when(name == "Package.swift", swift)
    )
    return tree.where(t.isNotNull()).select("path", F.explode(F.array_distinct(found)).alias("name")).where("name <> ''")


def manifest_errors(tree: DataFrame) -> DataFrame:
    """Manifests that can't be read: JSON that doesn't parse or whose groups are of another type, open headers and values, open groups and calls, inline mappings."""
    t, name = F.col("text"), base_name(F.col("path"))
    group = lambda k: F.coalesce(F.get_json_object(t, f"$.{k}"), F.lit("{}"))
    odd = F.exists(F.array(*(group(k) for k in ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies"))), lambda x: ~x.rlike("^[{\\[]"))
    toml = t.rlike("(?m)^[ \\t]*\\[[^\\]\n]*$|(?m)^[ \\t]*[A-Za-z0-9_-]+[ \\t]*=[ \\t]*$") | t.rlike("(?m)^[ \\t]*dependencies[ \\t]*=[ \\t]*[\"'0-9]")
    balance = lambda x: F.length(F.regexp_replace(F.regexp_replace(x, '"[^"]*"', ""), "[^(]", "")) != F.length(F.regexp_replace(F.regexp_replace(x, '"[^"]*"', ""), "[^)]", ""))
    bad = (
        F.when(name.isin("package.json", "package-lock.json"), F.try_parse_json(t).isNull() | odd)
        .when(name == "vcpkg.json", F.try_parse_json(t).isNull() | F.exists(_members(t, "dependencies"), lambda x: x.rlike("^[0-9]")))
        .when(name.isin("pyproject.toml", "Cargo.toml"), toml)
        .when(name == "CMakeLists.txt", balance(_bare(t, r"#\[(=*)\[.*?\]\2\]|#[^\n]*")))
        .when(name == "Package.swift", balance(_bare(t, r"/\*.*?\*/|//[^\n]*")))
        .when(name == "go.mod", balance(F.regexp_replace(t, "//[^\n]*", "")))
        .when(name == "pubspec.yaml", t.rlike("(?m)^(?:dependencies|dev_dependencies|dependency_overrides):[ \\t]*[^\\s#{]|^(?:dependencies|dev_dependencies|dependency_overrides):[ \\t]*\\{[^}]"))
        .when(name.rlike("^requirements.*\\.txt\\z"), F.exists(F.split(t, "\r?\n", -1), lambda x: ~F.trim(x).rlike("^(?:[#.-]|\\z)") & (_requirement(x) == "")))
    )
    return _rows(tree.where(t.isNotNull() & F.coalesce(bad, F.lit(False))), "repository.dependency-manifest-parse")


def dependencies(tree: DataFrame) -> DataFrame:
    """(name, path) of what manifests declare, in lower case."""
    return manifest_names(tree).select(F.lower("name").alias("name"), "path").groupBy("name").agg(F.min("path").alias("path"))


def dependency_boundary(tree: DataFrame, files: list[str], groups: list[str] = DEPENDENCY_MARKERS) -> DataFrame:
    """Missing boundary evidence or topics, and declared dependencies that the evidence doesn't name."""
    text = tree.where(F.col("path").isin(files) & F.col("text").isNotNull()).agg(F.min("path").alias("file"), F.array_join(F.sort_array(F.collect_list("text")), "\n").alias("text"))  # a few named files
    rule = "repository.dependency-boundary-evidence"
    topics = F.array(*(F.when(~has_marker(F.col("text"), g), F.lit(g)) for g in groups))
    lacks = text.where("file is not null").select(F.lit(rule).alias("rule"), "file", F.lit(1).alias("line"), F.explode(F.array_compact(topics)).alias("detail"))
    none = text.where("file is null").select(F.lit(rule).alias("rule"), F.lit(files[0]).alias("file"), F.lit(1).alias("line"), F.lit("missing").alias("detail"))
    named = dependencies(tree).join(F.broadcast(text.where("file is not null").select("text")))  # one row
    unnamed = named.where(~F.lower("text").contains(F.col("name")))
    return lacks.unionByName(none).unionByName(_rows(unnamed, rule, detail=F.col("name")))


def commercial_signals(tree: DataFrame, terms: list[str] = COMMERCIAL_TERMS) -> DataFrame:
    """The first place of each term in each manifest."""
    manifest = base_name(F.col("path")).rlike("^(?:package\\.json|pyproject\\.toml|pubspec\\.yaml|CMakeLists\\.txt|requirements.*\\.txt|Cargo\\.toml|go\\.mod|Package\\.swift|vcpkg\\.json)\\z")
    ignored = F.arrays_overlap(F.split("path", "/", -1), F.array(F.lit("node_modules"), F.lit("vendor")))
    return _first_marks(tree.where(manifest & ~ignored), "repository.dependency-commercial-signal", {t: [t] for t in terms})


def _first_marks(files: DataFrame, rule: str, groups: dict[str, list[str]]) -> DataFrame:
    quote = lambda t: "\\s+".join(re.sub(r"([^\w])", r"\\\1", x) for x in t.split())
    at = lambda ts: F.regexp_instr("text", F.lit("(?iu)" + "|".join(f"(?:{quote(t)})" for t in ts)))
    marks = F.array(*(F.struct(F.lit(k).alias("detail"), at(ts).alias("at")) for k, ts in groups.items()))
    hits = F.transform(F.filter(marks, lambda m: m["at"] > 0), lambda m: F.struct(m["detail"].alias("detail"), (m["at"] - 1).alias("start")))
    lined = tx.bind(hits, lambda h: F.when(F.size(h) > 0, tx.with_places(F.col("text"), h, lambda m, line, _: F.struct(m["detail"].alias("detail"), line.alias("line")))))
    each = files.where(F.col("text").isNotNull()).select("path", F.explode(lined).alias("m"))
    return _rows(each, rule, line=F.col("m.line"), detail=F.col("m.detail"))


def resource_scopes(tree: DataFrame, scopes: dict[str, list[str]]) -> DataFrame:
    """Resources none of whose globs match a path: one boolean aggregate per resource in a single pass."""
    hit = tree.agg(*(F.coalesce(F.bool_or(tx.in_scope(F.col("path"), globs)), F.lit(False)).alias(f"r{i}") for i, globs in enumerate(scopes.values())))
    each = F.array(*(F.struct(F.lit(globs[0]).alias("file"), F.lit(name).alias("detail"), F.col(f"r{i}").alias("hit")) for i, (name, globs) in enumerate(scopes.items())))
    return hit.select(F.explode(each).alias("r")).where("not r.hit").select(F.lit("repository.resource-scope").alias("rule"), "r.file", F.lit(1).alias("line"), "r.detail")


def marker_files(tree: DataFrame, rule: str, wanted: dict[str, list[str]]) -> DataFrame:
    """Files that must exist and hold all of their marker groups."""
    want = tree.sparkSession.createDataFrame([(p, m) for p, ms in wanted.items() for m in (ms or [""])], "path string, marker string")
    got = want.join(tree.select("path", "text", F.lit(1).alias("there")), "path", "left")
    norm = marker_norm(F.col("text"))
    met = F.exists(F.split(F.lower("marker"), "\\|", -1), lambda a: (a != "") & norm.contains(F.regexp_replace(a, "\\s+", " ")))
    missing = F.col("there").isNull()
    return _rows(got.where(missing | ((F.col("marker") != "") & F.col("text").isNotNull() & ~met)), rule, detail=F.when(missing, "missing file").otherwise(F.col("marker"))).distinct()


def jobs(tree: DataFrame) -> DataFrame:
    """path, id, name and runs_on of the jobs in workflow files, from their lines: a key of two spaces begins a job."""
    flow = tree.where(F.col("path").startswith(".github/workflows/") & suffix(F.col("path")).isin(".yml", ".yaml"))
    each = flow.select("path", F.posexplode(F.split("text", "\r?\n", -1)).alias("n", "l")).where(~F.col("l").rlike("^\\s*(?:#.*)?$"))
    w = Window.partitionBy("path").orderBy("n")  # one file's lines
    top = each.withColumn("top", F.last(F.when(~F.col("l").startswith(" "), F.col("l")), True).over(w)).where((F.col("top") == "jobs:") & F.col("l").startswith(" "))
    key = F.regexp_extract("l", "^  ([A-Za-z0-9_-]+):\\s*(?:#.*)?$", 1)
    owned = top.withColumn("id", F.last(F.when(key != "", key), True).over(w)).where("id is not null")
    value = lambda k: F.last(F.when(F.col("l").rlike(f"^    {k}:\\s*.+$"), F.regexp_replace(F.regexp_extract("l", f"^    {k}:\\s*(.+)$", 1), "^[\\s'\"]+|[\\s'\"]+$", "")), True)
    got = owned.groupBy("path", "id").agg(value("name").alias("name"), value("runs-on").alias("runs_on"))
    return got.select("path", "id", F.coalesce("name", "id").alias("name"), F.coalesce("runs_on", F.lit("")).alias("runs_on"))


def ci_gates(tree: DataFrame, gates: list[str], platforms: dict[str, str] = {}) -> DataFrame:  # noqa: B006
    """Gates that don't appear exactly once, and platform gates on another platform's runner."""
    spark = tree.sparkSession
    found = jobs(tree)
    want = _list(spark, sorted({*gates, *platforms.values()}), "name")
    count = want.join(found.groupBy("name").count(), "name", "left").where(F.coalesce("count", F.lit(0)) != 1)
    rule = "repository.ci-gate-contract"
    out = count.select(F.lit(rule).alias("rule"), F.lit(".github/workflows/").alias("file"), F.lit(1).alias("line"), F.col("name").alias("detail"))
    marks = {"linux": "ubuntu|linux", "macos": "macos", "windows": "windows"}
    rows = [(name, marks[p.lower()]) for p, name in platforms.items() if p.lower() in marks]
    if rows:
        once = found.join(found.groupBy("name").count().where("count = 1"), "name")
        wrong = once.join(spark.createDataFrame(rows, "name string, marks string"), "name").where("not lower(runs_on) rlike marks")
        out = out.unionByName(wrong.select(F.lit(rule).alias("rule"), F.col("path").alias("file"), F.lit(1).alias("line"), F.col("name").alias("detail")))
    return out


def server_material(tree: DataFrame, globs: list[str] = RESTRICTED_GLOBS) -> DataFrame:
    low = F.lower("path")
    benign = low.rlike("|".join(BENIGN_MARKERS))
    return _rows(tree.where(tx.in_scope(F.col("path"), globs) & ~benign), "repository.server-material-path")


def server_signals(tree: DataFrame) -> DataFrame:
    some = tree.where(suffix(F.col("path")).isin(SCAN_SUFFIXES) & ~F.arrays_overlap(F.split("path", "/", -1), F.array(*map(F.lit, IGNORED_PARTS))))
    return _first_marks(some, "repository.server-security-signal", DANGEROUS)


def boundary_manifest(spark: SparkSession, boundaries: list[str], groups: list[str]) -> DataFrame:
    text = spark.createDataFrame([("\n".join(boundaries),)], "text string")
    lacking = F.array_compact(F.array(*(F.when(~has_marker(F.col("text"), g), F.lit(g)) for g in groups)))
    return text.select(F.lit("repository.server-boundary-manifest").alias("rule"), F.lit("<profile>").alias("file"), F.lit(1).alias("line"), F.explode(lacking).alias("detail"))


def defect_records(tree: DataFrame, root: str, closed: list[str], audit: list[str], closure: list[str]) -> DataFrame:
    """Markdown records under a root: audit fields, a status that is closed, and closure fields and evidence."""
    here = tree.where(F.col("path").startswith(root.rstrip("/") + "/"))
    md = F.lower("path").endswith(".md")
    quote = lambda f: re.sub(r"([^\w])", r"\\\1", f)
    has = lambda f: F.col("text").rlike(f"(?dm)^{quote(f)}\\s*\\S+")
    status = F.regexp_extract("text", "(?im)^\\*\\*Status:\\*\\*\\s*(.+?)\\s*$", 1)
    evidence = F.lower(F.regexp_extract("text", "(?im)^\\*\\*Closure evidence:\\*\\*\\s*(.+?)\\s*$", 1))
    shut = F.lower(status).isin([c.lower() for c in closed])
    wrong = F.when(~md, F.array(F.lit("not markdown"))).when(F.col("text").isNull(), F.array().cast("array<string>")).otherwise(
        F.array_compact(
            F.array(
                *(F.when(~has(f), F.lit(f"audit field {f}")) for f in audit),
                F.when(status == "", "no status").when(~shut, "not closed"),
                *(F.when(shut & ~has(f), F.lit(f"closure field {f}")) for f in closure),
                F.when(shut & evidence.isin("", "tbd", "todo", "none", "n/a"), "empty evidence"),
            )
        )
    )
    return _rows(here.withColumn("w", F.explode(wrong)), "repository.defect-record-closure", detail=F.col("w"))


def attribution(tree: DataFrame, only_documents: bool = True) -> DataFrame:
    """Tool identities where contributors are named.

    That is: in a contributors' file; on a trailer's line; in a metadata file, at most 512 characters behind the last
    contributor field; or under a contributors' heading, if no other heading stands between. Fields and headings are
    looked for in the 1,024 characters before. Only files with the suffix of a document or a known name are read,
    unless all are asked for.
    """
    name = F.lower(base_name(F.col("path")))
    known = name.isin(CONTRIBUTOR_FILES + METADATA_FILES)
    read = known | suffix(F.col("path")).isin(ATTRIBUTION_SUFFIXES) if only_documents else F.lit(True)
    text = F.col("text")

    def judged(s: Column, line: Column, column: Column) -> Column:
        from_ = F.greatest(s["start"] - LOOKBACK, F.lit(0))

        def near(before: Column) -> Column:
            here = F.substring(text, s["start"] - column + 2, F.least(column - 1 + F.length(s["value"]), F.lit(LOOKBACK)))
            behind = F.regexp_extract(before, HEADED, 1)
            headed = before.rlike(HEADED) & ~behind.rlike(r"(?dm)^#{1,6}\s+")
            return name.isin(CONTRIBUTOR_FILES) | here.rlike(TRAILER_LINE) | (name.isin(METADATA_FILES) & before.rlike(FIELD_BEHIND)) | headed

        return F.struct(line.alias("line"), tx.bind(F.substring(text, from_ + 1, s["start"] - from_), near).alias("ok"))

    found = F.filter(tx.with_places(text, tx.spans(text, TOOL_IDENTITY), judged), lambda s: s["ok"])
    each = tree.where(read & text.rlike(TOOL_IDENTITY)).select("path", F.explode(found).alias("s"))
    return _rows(each, "contribution.cursor-attribution", line=F.col("s.line"))


def commit_attribution(meta: DataFrame) -> DataFrame:
    said = F.exists(F.concat(F.array("author", "committer"), F.coalesce("trailers", F.array().cast("array<string>"))), lambda x: F.coalesce(x.rlike(TOOL_IDENTITY), F.lit(False)))
    return meta.where(said).select(F.lit("contribution.commit-attribution").alias("rule"), F.lit("<commit-metadata>").alias("file"), F.lit(1).alias("line"), F.col("commit").alias("detail"))


def branch_prefix(refs: DataFrame) -> DataFrame:
    name = F.lower(F.regexp_replace("ref", "^refs/heads/", ""))
    any_ = refs.agg(F.coalesce(F.bool_or(name.rlike("^codex(?:\\z|[/_-])")), F.lit(False)).alias("hit"))
    return any_.where("hit").select(F.lit("contribution.branch-prefix").alias("rule"), F.lit("<branch-ref>").alias("file"), F.lit(1).alias("line"), F.lit("").alias("detail"))


def governance(settings: DataFrame, policy: DataFrame) -> DataFrame:
    """Repository settings (repository, pull_access, branches array, bypass_visible, verified) against the policy's rows of the same names."""
    j = policy.withColumnsRenamed({c: f"want_{c}" for c in policy.columns if c != "repository"}).join(settings, "repository", "left")
    differ = (F.size(F.array_except("branches", "want_branches")) > 0) | (F.size(F.array_except("want_branches", "branches")) > 0)
    found = F.when(~F.coalesce("verified", F.lit(False)), F.array(F.lit("governance.verification-unavailable"))).otherwise(
        F.array_compact(F.array(F.when(F.col("pull_access") != F.col("want_pull_access"), "governance.pull-request-access"), F.when(differ, "governance.maintainer-branches"), F.when(~F.col("bypass_visible"), "governance.bypass-visibility")))
    )
    out = j.withColumn("rule", F.explode(found))
    return out.select("rule", F.col("repository").alias("file"), F.lit(1).alias("line"), F.when(F.col("rule").isin("governance.verification-unavailable", "governance.bypass-visibility"), "unverified").otherwise("configuration_drift").alias("detail"))
