"""Relational steps, sources and contracts beyond what the SQL comparison covers."""

from pyspark.sql import functions as F

from lodestone.operators import contracts as ct
from lodestone.operators import relate
from lodestone.operators.detect import candidates, first_versions
from lodestone.plans.scan import scan
from lodestone.sources.versions import admissible, files


def test_introducing_commit_is_kept(spark):
    rows = [(1, "c1", 1, "a.txt", "o1", "8.8.8.8"), (2, "c2", 2, "a.txt", "o1", "8.8.8.8"), (3, "c3", 3, "a.txt", "o2", "gone"), (4, "c3", 3, "b.txt", "o1", "8.8.8.8")]
    v = spark.createDataFrame(rows, "doc_id long, commit string, seq int, path string, oid string, text string")
    assert sorted((r.path, r.commit) for r in scan(v).collect()) == [("a.txt", "c1"), ("b.txt", "c3")]
    assert first_versions(v).count() == 3


def test_exceptions_are_exact_and_counted(spark):
    df = spark.createDataFrame([("a.txt", "8.8.8.8 8.8.4.4"), ("b.txt", "8.8.8.8")], "path string, text string")
    exceptions = spark.createDataFrame([("privacy.endpoint.ip-address", "a.txt", "8.8.8.8")], "rule string, path string, value string")
    kept, gone = relate.split_exempt(candidates(df), exceptions)
    assert sorted((r.path, r.value) for r in kept.collect()) == [("a.txt", "8.8.4.4"), ("b.txt", "8.8.8.8")] and gone.count() == 1


def test_allowlists(spark):
    df = spark.createDataFrame([("a.txt", "2606:4700:0:0::1111 https://Db.Corp.io./x ftp://db.corp.io"), ("b/a.txt", "2606:4700::1111 http://db.corp.io/x")], "path string, text string")
    found = candidates(df)
    ips = spark.createDataFrame([("2606:4700::1111", "^a[.]txt$")], "ip string, path_regex string")
    hosts = spark.createDataFrame([("db.corp.io", "https", ".*")], "host string, scheme string, path_regex string")
    ip = "privacy.endpoint.ip-address"
    assert [r.path for r in relate.without_allowed_ips(found, ips).where(F.col("rule") == ip).collect()] == ["b/a.txt"]
    assert [r.path for r in relate.without_allowed_hosts(found, hosts).where("rule like '%private-host'").collect()] == ["b/a.txt"]
    bound = candidates(spark.createDataFrame([("c.tf", 'host = "db.corp.io"'), ("d.tf", 'host = "db.other.io"')], "path string, text string"))
    any_scheme = spark.createDataFrame([("DB.corp.io.", None, ".*"), ("db.other.io", "https", ".*")], "host string, scheme string, path_regex string")
    assert [r.value for r in relate.without_allowed_hosts(bound, any_scheme).where("rule like '%host-binding'").collect()] == ["db.other.io"]


def test_allowlists_by_globs(spark):
    rows = [("src/a.txt", "8.8.8.8 https://db.corp.io/x"), ("src/deep/b.txt", "8.8.8.8 http://db.corp.io/x"), ("docs/c.md", "8.8.8.8 https://DB.corp.io./x")]
    found = candidates(spark.createDataFrame(rows, "path string, text string"))
    ips = spark.createDataFrame([("8.8.8.8", "src/?.txt"), ("8.8.8.8", "docs/*.txt")], "ip string, path_glob string")
    hosts = spark.createDataFrame([("db.corp.io", "https", "*.md"), ("db.corp.io", None, "src/deep/*"), ("other.io", None, "*")], "host string, scheme string, path_glob string")
    ip = "privacy.endpoint.ip-address"
    kept = relate.without_allowed_ips(found, ips)
    assert "NestedLoop" not in kept._jdf.queryExecution().toString()
    assert sorted(r.path for r in kept.where(F.col("rule") == ip).collect()) == ["docs/c.md", "src/deep/b.txt"]
    assert [r.path for r in relate.without_allowed_hosts(found, hosts).where("rule like '%private-host'").collect()] == ["src/a.txt"]


def test_a_scan_reads_each_text_once(spark, capsys):
    """Exceptions and both allowlists in one plan, with one explode."""
    v = spark.createDataFrame([(1, "c1", 1, "a.txt", "o1", "8.8.8.8")], "doc_id long, commit string, seq int, path string, oid string, text string")
    exceptions = spark.createDataFrame([("r", "a", "v")], "rule string, path string, value string")
    ips = spark.createDataFrame([("8.8.8.8", ".*")], "ip string, path_regex string")
    hosts = spark.createDataFrame([("a.b", None, ".*")], "host string, scheme string, path_regex string")
    out = scan(v, exceptions, ips, hosts)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 1 and out.count() == 0


def test_status_precedence(spark):
    f = lambda *s: spark.createDataFrame([(x,) for x in s], "severity string")
    i = lambda n: spark.range(n)
    got = [tuple(relate.run_status(a, b).first())[:2] for a, b in ((f("error"), i(1)), (f("error", "warning"), i(0)), (f("warning"), i(0)), (f(), i(0)))]
    assert got == [("incomplete", 1), ("policy_failure", 2), ("completed_with_warnings", 0), ("completed", 0)]


def test_attribution_dedupe_is_null_safe(spark):
    cols = "file string, commit string, rule string, line int"
    a = spark.createDataFrame([("a", None, "r", 1), ("a", "c", "r", 1), ("b", None, "r", 1)], cols)
    b = spark.createDataFrame([("a", None, "r", 1)], cols)
    assert sorted((r.file, r.commit) for r in relate.unrepeated(a, b).collect()) == [("a", "c"), ("b", None)]


def test_ledger_conflicts(spark):
    cols = "id string, finished_at long, content string"
    h = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], cols)
    saved, conflicts = relate.ledger(h, spark.createDataFrame([("a", 1, "z"), ("c", 3, "w")], cols))
    assert [r.id for r in saved.collect()] == ["c", "b", "a"] and [r.id for r in conflicts.collect()] == ["a"]


def test_files_source(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.txt").write_text("mail bob@corp-mail.de")
    (tmp_path / "b.bin").write_bytes(b"\xff\x00x")
    (tmp_path / "c.txt").write_text("version https://git-lfs.github.com/spec/v1\noid x")
    got = {r.path: (r.reason, r.text) for r in admissible(files(spark, str(tmp_path))).collect()}
    assert got == {"d/a.txt": (None, "mail bob@corp-mail.de"), "b.bin": ("non-UTF-8 or binary", None), "c.txt": ("LFS pointer", None)}


def test_schema_fixture_grammar(spark):
    rows = [("a.sql", "CREATE TABLE t (x int);\n-- c\nCREATE UNIQUE INDEX i ON t(x);"), ("b.sql", "create table t as select 1;"), ("c.sql", "insert into t values (1);"), ("d.sql", "")]
    tree = spark.createDataFrame(rows, "path string, text string").withColumn("size", F.lit(1).cast("long"))
    assert sorted(r.file for r in ct.data_files(tree, ["a.sql", "b.sql", "c.sql", "d.sql"]).collect()) == ["b.sql", "c.sql", "d.sql"]


def test_versions_of_one_path_are_judged_apart(spark):
    rows = [("a.sql", "o1", "c0", 0, "create table t (x int);"), ("a.sql", "o2", "c1", 1, "insert into t values (1);"), ("a.sql", "o1", "c2", 2, "create table t (x int);"), ("b.json", "o3", "c1", 1, '{"a": 1}'), ("b.json", "o4", "c2", 2, "{")]
    v = spark.createDataFrame(rows, "path string, oid string, commit string, seq int, text string").withColumns({"kind": F.lit("blob"), "size": F.lit(1)})
    head = spark.createDataFrame([("b.json", "o4")], "path string, oid string")
    none = spark.createDataFrame([], "path string, kind string")
    got = sorted((r.file, r.commit, r.detail, r.severity) for r in ct.historical_data(v, head, none, ["a.sql"]).collect())
    assert got == [("a.sql", "c1", "dump", "error"), ("b.json", "c1", "", "error")]


MANIFESTS = [
    ("package.json", '{"dependencies": {"a": "1"}, "devDependencies": {"b": "1"}, "bundledDependencies": ["c"], "bundleDependencies": {"d": "1"}, "x": {"y": 1}}', {"a", "b", "c", "d"}),
    ("pyproject.toml", '[project]\nname = "x"\ndependencies = [\n  "req[sec]>=2; python_version >= \'3\'",  # note\n  "direct @ https://x.invalid/d.whl",\n]\n[project.optional-dependencies]\ntest = ["pyt>=8"]\n[build-system]\nrequires = ["st>=68", "wh"]\n[tool.poetry.dependencies]\npython = "^3.11"\nrich = "*"\n[tool.poetry.group.docs.dependencies]\nsph = "*"\n[tool.other]\nnone = "*"\n', {"req", "direct", "pyt", "st", "wh", "rich", "sph"}),
    ("Cargo.toml", '[package]\nname = "x"\n[dependencies]\nserde = "1"\nren = { package = "act", version = "1" }\n[dev-dependencies]\nfix = "1"\n[target.\'cfg(unix)\'.dependencies]\nlibc = "1"\n[workspace.dependencies]\nsh = "1"\n[dependencies.tab]\nversion = "1"\n', {"serde", "ren", "act", "fix", "libc", "sh", "tab"}),
    ("CMakeLists.txt", '# find_package(No)\n#[[ FetchContent_Declare(No2) ]]\nmessage("find_package(No3)")\nfind_package(Threads REQUIRED)\nFetchContent_Declare(fmt URL "https://x.invalid/f.tgz")\nExternalProject_Add(dep-p URL "u")\nCPMAddPackage(NAME Cat2 VERSION 3.0)\n', {"Threads", "fmt", "dep-p", "Cat2"}),
    ("requirements-dev.txt", "# doc\nreq[sec]>=2; python_version > '3'\ndirect @ https://x.invalid/p.whl\n-r more.txt\n--index-url https://x.invalid\n./local\n", {"req", "direct"}),
    ("pubspec.yaml", "name: x\ndependencies:\n  flutter:\n    sdk: flutter\n  http: ^1.0\ndev_dependencies:\n  ft:\n    sdk: flutter\ndependency_overrides:\n  cus:\n    git:\n      url: u\nflutter:\n  uses: true\n", {"flutter", "http", "ft", "cus"}),
    ("go.mod", "module x.invalid/self\ngo 1.22\nrequire x.invalid/one v1.0.0\nrequire (\n  x.invalid/two v1.1.0 // indirect\n  x.invalid/three v2.0.0\n)\nreplace x.invalid/o v1.0.0 => x.invalid/n v1.0.0\n", {"x.invalid/one", "x.invalid/two", "x.invalid/three"}),
    ("Package.swift", '// .package(url: "https://x.invalid/no.git")\nlet p = [\n.package(name: "Nam", url: "https://x.invalid/rep.git", from: "1.0.0"),\n.package(url: "https://x.invalid/dot.name.git", .upToNextMajor(from: "2.0.0")),\n.package(path: "../loc")]\n', {"Nam", "rep", "dot.name", "loc"}),
    ("vcpkg.json", '{"dependencies": ["fmt", {"name": "boost", "features": ["s"]}], "features": {"n": {"dependencies": ["curl"]}}}', {"fmt", "boost", "curl"}),
]
BROKEN = [("package.json", '{"dependencies":'), ("package.json", '{"dependencies":23}'), ("pyproject.toml", "[project\n"), ("pyproject.toml", '[project]\ndependencies = "bad"'), ("Cargo.toml", "[dependencies]\nx = "), ("CMakeLists.txt", "find_package(Gone"), ("go.mod", "require (\nx.invalid/i v1.0.0"), ("Package.swift", '.package(url: "u"'), ("vcpkg.json", '{"dependencies":[12]}'), ("pubspec.yaml", "dependencies: [bad]"), ("requirements.txt", "??? bad")]


def test_manifest_grammars(spark):
    tree = spark.createDataFrame([(f"d{k}/{n}", t) for k, (n, t, _) in enumerate(MANIFESTS)] + [("x.txt", None), ("a/package.json", None)], "path string, text string")
    got = {}
    for r in ct.manifest_names(tree).collect():
        got.setdefault(r.path, set()).add(r.name)
    for k, (n, _, want) in enumerate(MANIFESTS):
        assert got.get(f"d{k}/{n}") == want, n
    assert ct.manifest_errors(tree).count() == 0
    bad = spark.createDataFrame([(f"d{k}/{n}", t) for k, (n, t) in enumerate(BROKEN)], "path string, text string")
    assert sorted(r.file for r in ct.manifest_errors(bad).collect()) == sorted(f"d{k}/{n}" for k, (n, _) in enumerate(BROKEN))


def test_link_resolution(spark):
    cases = [("docs/a.md", "../x.md#y", "x.md"), ("docs/a.md", "b%20c.md", "docs/b c.md"), ("a.md", "../../x", "x"), ("docs/a.md", "/r.md", "r.md"), ("docs/d/a.md", "./", "docs/d")]
    df = spark.createDataFrame(cases, "s string, t string, want string")
    assert df.where(ct.resolve(F.col("s"), F.col("t")) != F.col("want")).count() == 0


def test_readme_links_each_other(spark):
    rows = [("README.md", "[x](README.zh-CN.md)"), ("README.zh-CN.md", "![x](README.md) nothing")]
    tree = spark.createDataFrame(rows, "path string, text string")
    out = ct.documents(tree, ["README.md"], ["docs/adrs/"]).where("rule like '%cross-link'")
    assert [r.file for r in out.collect()] == ["README.zh-CN.md"]


ATTRIBUTED = [
    ("AUTHORS", "Cursor\n\nCursor Agent", [1, 3]),
    ("src/a.md", "the cursor moves", []),
    ("log.txt", "Co-authored-by: Cursor Agent <x@example.invalid>\nSigned-off-by: B", [1]),
    ("log2.txt", "see Co-authored-by: Cursor", []),
    ("package.json", '{"contributors": ["cursor"]}', [1]),
    ("package.json", '{"author": "' + "x" * 500 + ' cursor"}', [1]),
    ("package.json", '{"author": "' + "x" * 520 + ' cursor"}', []),
    ("package.json", '{"author": "a", "note": "' + "x" * 600 + '", "maintainers": ["cursor"]}', [1]),
    ("other.json", '{"author": "cursor"}', []),
    ("docs/team.md", "# Team\n\n## Contributors\n\n- Cursor\n- B\n", [5]),
    ("docs/team2.md", "## Contributors\n\n- A\n\n## Usage\n\nthe cursor\n", []),
    ("docs/team3.md", "## Usage\n\n### credits\n text\n" + "y" * 980 + "\ncursor\n", [6]),
    ("docs/team4.md", "### Credits\n" + "y" * 1030 + "\ncursor\n", []),
    ("docs/team5.md", "## Contributors and more\n\n- Cursor\n", []),
    ("docs/team6.md", "## Authors\n#hash no heading\n- cursor-bot\n", [3]),
    ("docs/team7.md", "####### Authors\n- cursor\n", []),
    ("docs/team8.md", "## Old\n\n## Authors\n\ncursorai, precursor, cursors", [5]),
    ("src/code.py", "# Authors\n- cursor", []),
]


def test_tool_attribution(spark):
    tree = spark.createDataFrame([(f"d{i}/{p}", t) for i, (p, t, _) in enumerate(ATTRIBUTED)] + [("x.md", None)], "path string, text string")
    got = {}
    for r in ct.attribution(tree).collect():
        got.setdefault(r.file, []).append(r.line)
    assert {f: sorted(x) for f, x in got.items()} == {f"d{i}/{p}": x for i, (p, _, x) in enumerate(ATTRIBUTED) if x}
    assert [r.file for r in ct.attribution(tree, only_documents=False).collect() if r.file.endswith(".py")] == [f"d{len(ATTRIBUTED) - 1}/src/code.py"]


def test_findings_of_repeated_versions_meet_once(spark):
    """Both ways of a scan give the same findings, at the version that introduces them, also where rows repeat."""
    rows = [(i, f"c{i % 3}", i % 3, f"{i % 2}.txt", f"o{i % 4}", f"mail bob{i % 4}@corp-mail.de") for i in range(40)]
    rows += rows[:5] + [(None, "c0", 0, "1.txt", "o1", "mail bob1@corp-mail.de")]
    v = spark.createDataFrame(rows, "doc_id long, commit string, seq int, path string, oid string, text string")
    key = lambda r: (r.path, r.oid, r.rule, r.start, r.line, r.doc_id)
    one, two = (sorted(map(str, map(key, scan(v, history=h).collect()))) for h in (False, True))
    assert one == two and len(one) == 4
    plan = scan(v)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 1


def test_boundary_manifest(spark):
    assert [r.detail for r in ct.boundary_manifest(spark, ["We use TLS and  RBAC"], ["tls|cors", "rbac", "sbom|cve"]).collect()] == ["sbom|cve"]


def test_stream_counts(spark, tmp_path):
    from lodestone.streaming.incremental import stream_counts, stream_findings, stream_versions

    schema = "at timestamp, doc_id long, text string, lang string, source string"
    rows = [("2024-01-01 00:00:00", 1, "8.8.8.8", "en", "s"), ("2024-01-01 00:01:00", 2, "8.8.8.8", "en", "s"), ("2024-01-01 00:02:00", 3, "8.8.8.8", "de", "s")]
    spark.createDataFrame([(a, *r) for a, *r in rows], "at string, doc_id long, text string, lang string, source string").withColumn("at", F.to_timestamp("at")).write.parquet(str(tmp_path / "in"))
    found = stream_findings(stream_versions(spark, str(tmp_path / "in"), schema))
    q = found.writeStream.format("memory").queryName("found").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.path for r in spark.table("found").collect()) == ["documents/de.txt", "documents/en.txt"]
    assert stream_counts(found).isStreaming
