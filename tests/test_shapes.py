"""Shapes of JSON files, case by case."""

from lodestone.operators import contracts as ct

BAD, WRONG, LOOSE = "repository.json-invalid", "repository.json-shape-invalid", "repository.json-not-allowlisted"
RELEASE = '{"schemaVersion": 1, "changelog": "c", "tagPrefix": "v", "versionSources": [%s]}'
CASES = [
    ("package.json", '{"name": "x"}', None),
    ("package.json", '{"name": null}', None),
    ("package.json", "{}", None),
    ("package.json", '{"nam": 1}', WRONG),
    ("package.json", '["name"]', WRONG),
    ("package.json", '"name"', WRONG),
    ("package.json", '{"name": 1, "name": 2}', BAD),
    ("package.json", '{"x": {"name": 1}}', WRONG),
    ("package.json", "{'name': 1}", BAD),
    ("package.json", None, BAD),
    ("a/package.json", '{"name": 1}', LOOSE),
    ("TSCONFIG.json", '{"extends": "x"}', None),
    ("a/b/tsconfig.base.json", '{"files": []}', None),
    ("a/.mcp.json", '{"mcpServers": {}, "more": 1}', None),
    ("a/mcp.json", '{"mcpservers": {}}', WRONG),
    ("github/rulesets/main.json", '{"rules": [], "name": "n"}', None),
    ("github/rulesets/main.json", '{"rules": []}', WRONG),
    ("github/rulesets/a/b.json", '{"name": 1}', LOOSE),
    ("workflow-templates/a.properties.json", '{"name": "n", "description": "d", "categories": []}', None),
    ("workflow-templates/a.properties.json", '{"name": "n"}', WRONG),
    ("workflow-templates/a.properties.json", '{"name": "n", "description": 5}', WRONG),
    ("workflow-templates/a.properties.json", '{"name": "", "description": "d"}', WRONG),
    ("workflow-templates/a.properties.json", '{"name": "%s", "description": "d"}' % ("n" * 161), WRONG),
    ("workflow-templates/a.properties.json", '{"name": "%s", "description": "%s"}' % ("é" * 160, "d" * 320), None),
    ("workflow-templates/a.properties.json", '{"name": "n", "description": "d", "other": 1}', WRONG),
    ("tools/release/source-version.json", RELEASE % '{"path": "a", "pointer": "/v"}', None),
    ("tools/release/source-version.json", RELEASE % '{"path": "a", "key": "v", "format": "toml"}, {"path": "a", "pattern": "v", "format": "regex"}', None),
    ("tools/release/source-version.json", RELEASE % '{"path": "a", "key": "v", "format": "ini"}', WRONG),
    ("tools/release/source-version.json", RELEASE % '{"path": "a", "pointer": 1}', WRONG),
    ("tools/release/source-version.json", RELEASE % '{"path": "a", "pointer": "/v", "more": 1}', WRONG),
    ("tools/release/source-version.json", RELEASE % "", WRONG),
    ("tools/release/source-version.json", RELEASE % '"a"', WRONG),
    ("tools/release/source-version.json", RELEASE.replace("1", "2") % '{"path": "a", "pointer": "/v"}', WRONG),
    ("x/agents/plugins/marketplace.json", '{"entries": [1, {"a": null}]}', None),
    ("listed.json", "[]", None),
    ("listed.json", '{"any": 1}', None),
    ("listed.json", "5", WRONG),
]


def test_shapes(spark):
    tree = spark.createDataFrame([(p, t, i) for i, (p, t, _) in enumerate(CASES)], "path string, text string, i int").selectExpr("path", "text", "i", "'blob' AS kind")
    admissions = spark.createDataFrame([("listed.json", "json")], "path string, kind string")
    verdicts = {r.i: r.rule for r in ct._json_verdict(tree, admissions, ct.sh.COMMON_PATHS, ct.sh.COMMON).collect()}
    assert [(p, t, verdicts[i]) for i, (p, t, _) in enumerate(CASES)] == CASES


def test_profiles_of_the_caller(spark):
    shapes = [ct.sh.Shape(r"data/.*", all_of=("a", "b"), only=("a", "b", "c")), *ct.sh.COMMON]
    tree = spark.createDataFrame([("data/1.json", '{"a": 1, "b": 2}'), ("data/2.json", '{"a": 1, "b": 2, "d": 3}'), ("data/3.json", '{"a": 1}'), ("package.json", '{"name": 1}')], "path string, text string").selectExpr("*", "'blob' AS kind")
    none = spark.createDataFrame([], "path string, kind string")
    got = ct.json_files(tree, none, [r"data/[0-9]\.json", *ct.sh.COMMON_PATHS], shapes).collect()
    assert sorted((r.file, r.rule) for r in got) == [("data/2.json", WRONG), ("data/3.json", WRONG)]


def test_old_versions_have_shapes_too(spark):
    v = spark.createDataFrame([("package.json", "o1", "c0", 0, '{"nam": 1}'), ("package.json", "o2", "c1", 1, '{"name": 1}'), ("package.json", "o3", "c2", 2, '{"name": 2}')], "path string, oid string, commit string, seq int, text string").selectExpr("*", "'blob' AS kind", "1 AS size")
    head = spark.createDataFrame([("package.json", "o3")], "path string, oid string")
    got = ct.historical_data(v, head, spark.createDataFrame([], "path string, kind string")).collect()
    assert [(r.rule, r.commit, r.severity) for r in got] == [(WRONG, "c0", "error")]
