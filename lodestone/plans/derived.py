"""Queries of contracts whose files, jobs, records and settings are derived from the documents, row by row."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values as v
from ..operators import contracts as ct
from ..operators import detect as de
from ..operators import relate as re_
from ..sources import seen
from ..sources.versions import table
from .catalog import ALL_FOUND, TREE_SQL, _files, _tree, _versions
from .oracle import FIRST, VERSIONS
from .registry import query
from .scan import scan
from .shared import shared_dir, written

#: Resources by their globs: which of them the tree has depends on the documents' ids.
SCOPES = {f"s{k}": [f"src/m{k}??.py", f"docs/guide/p?{k}.md"] for k in range(60)} | {"none": ["none/**", "void/*"], "any": ["src/*"]}


@query(f"WITH {TREE_SQL} SELECT 'repository.resource-scope' AS rule, g1 AS file, n AS detail FROM (VALUES " + ", ".join(f"('{n}', '{g[0]}', '{g[-1]}')" for n, g in SCOPES.items()) + ") x(n, g1, g2) WHERE NOT EXISTS (SELECT 1 FROM t WHERE path GLOB g1 OR path GLOB g2)")
def resource_scopes(spark: SparkSession, d: str) -> DataFrame:
    """Declared resources that match no file."""
    return _files(ct.resource_scopes(_tree(spark, d), SCOPES))


LANGS = ("de", "en", "es", "fr")


@query(
    "WITH n AS (SELECT lang, count(*) AS c FROM documents GROUP BY lang), l AS (SELECT x.lang, coalesce(c, 0) AS c FROM (VALUES ('de'), ('en'), ('es'), ('fr')) x(lang) LEFT JOIN n ON n.lang = x.lang)"
    " SELECT lang, 'LICENSE' AS file, CASE WHEN c % 3 = 0 THEN 'missing' ELSE 'no evidence' END AS detail FROM l WHERE c % 3 = 0 OR c % 2 = 1 UNION ALL SELECT lang, 'LICENSE-POLICY.md', 'no notice' FROM l WHERE c % 5 < 3 OR c % 3 = 0"
)
def license_evidence(spark: SparkSession, d: str) -> DataFrame:
    """License and notice evidence of one tree for each language; what its license says depends on the number of its documents."""
    counts = table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("c"))
    out = None
    for lang in LANGS:
        mine = spark.createDataFrame([(lang,)], "lang string").join(counts, "lang", "left").select(F.coalesce("c", F.lit(0)).alias("c"))
        said = F.when(F.col("c") % 2 == 1, "All rights reserved").otherwise("Apache  License,\nversion 2.0")
        notice = F.when(F.col("c") % 5 < 3, "nothing here").otherwise("Licensed under the Apache License, Version 2.0")
        own = mine.where("c % 3 <> 0").select(F.explode(F.array(F.struct(F.lit("LICENSE").alias("path"), said.alias("text")), F.struct(F.lit("NOTICE").alias("path"), notice.alias("text")))).alias("x")).select("x.*")
        tree = _tree(spark, d).select("path", "text").unionByName(own)
        one = ct.license_evidence(tree).select(F.lit(lang).alias("lang"), "file", "detail")
        out = one if out is None else out.unionByName(one)
    return out


GATES = [f"j{k}" for k in range(40)]
PLATFORMS = {"linux": "j4", "macOS": "j6", "windows": "j8"}


@query(
    "WITH w AS (SELECT '.github/workflows/w' || doc_id || '.yml' AS file, 'j' || doc_id // 2 AS name, CASE doc_id % 5 WHEN 0 THEN 'macos-14' WHEN 1 THEN 'ubuntu-latest' ELSE 'windows-2022' END AS os FROM documents WHERE doc_id % 4 <> 1), c AS (SELECT name, count(*) AS n FROM w GROUP BY name)"
    " SELECT 'repository.ci-gate-contract' AS rule, '.github/workflows/' AS file, g AS detail FROM (SELECT unnest([" + ", ".join(f"'{g}'" for g in GATES) + "]) AS g) LEFT JOIN c ON c.name = g WHERE coalesce(n, 0) <> 1"
    " UNION ALL SELECT 'repository.ci-gate-contract', w.file, w.name FROM w JOIN c ON c.name = w.name AND n = 1 JOIN (VALUES ('j4', 'ubuntu'), ('j6', 'macos'), ('j8', 'windows')) p(name, mark) ON p.name = w.name WHERE NOT contains(os, mark)"
)
def ci_gates(spark: SparkSession, d: str) -> DataFrame:
    """Workflow gates: exactly once, and on their platform's runner; a workflow for each document, its text as comments."""
    n = F.col("doc_id")
    name = F.concat(F.lit("j"), F.floor(n / 2).cast("string"))
    runner = F.when(n % 5 == 0, "macos-14").when(n % 5 == 1, "ubuntu-latest").otherwise("windows-2022")
    comments = F.concat(F.lit("# "), F.regexp_replace(F.coalesce("text", F.lit("")), "\r?\n|\r", "\n# "))
    job = F.when(n % 4 == 1, "env:\n  x: 1\n").otherwise(F.concat(F.lit("jobs:\n  build:\n    name: '"), name, F.lit("'\n    runs-on: "), runner, F.lit("\n    steps:\n      - run: x\nenv:\n  lint: 1\n")))
    flows = table(spark, d, "documents").select(F.concat(F.lit(".github/workflows/w"), n.cast("string"), F.lit(".yml")).alias("path"), F.concat(comments, F.lit("\n"), job).alias("text"))
    return _files(ct.ci_gates(flows, GATES, PLATFORMS))


MARKED = {f"docs/guide/p{k}.md": ["the|der", "zzz-never|qqq", "de|la", "and"] for k in range(4, 204, 10)} | {"docs/guide/none.md": ["x", "y"]}


@query(
    f"WITH {TREE_SQL}, w AS (SELECT * FROM (VALUES " + ", ".join(f"('{p}', '{m}')" for p, ms in MARKED.items() for m in ms) + ") x(file, marker))"
    r" SELECT DISTINCT 'repository.ci-required-marker' AS rule, w.file, CASE WHEN t.path IS NULL THEN 'missing file' ELSE marker END AS detail FROM w LEFT JOIN t ON t.path = w.file WHERE t.path IS NULL OR (t.text IS NOT NULL AND len(list_filter(string_split(marker, '|'), lambda x: contains(lower(t.text), x))) = 0)"
)
def marker_files(spark: SparkSession, d: str) -> DataFrame:
    """Marker files that are missing or lack a marker."""
    return _files(ct.marker_files(_tree(spark, d).select("path", "text"), "repository.ci-required-marker", MARKED))


RECORD = """CASE doc_id % 6 WHEN 0 THEN concat('**Status:** Closed\\n**Owner:** x\\n**Closure evidence:** ', CASE WHEN doc_id % 4 = 0 THEN 'TBD' ELSE 'run 7' END, '\\n') WHEN 1 THEN '**Status:** open\\n' WHEN 2 THEN '' WHEN 3 THEN '**Owner:** y\\n**Status:** fixed \\n' WHEN 4 THEN '**Owner:** z\\n**Status:** Fixed\\n**Closure evidence:** see log\\n' ELSE '**Status:** later\\n**Owner:** w\\n' END"""


@query(
    "WITH r AS (SELECT doc_id, 'audit/' || CASE WHEN doc_id % 9 = 0 THEN 'x/' ELSE '' END || 'r' || doc_id || CASE WHEN doc_id % 7 = 0 THEN '.txt' ELSE '.md' END AS file, doc_id % 6 AS k, doc_id % 7 = 0 AS other FROM documents)"
    " SELECT file, 'not markdown' AS detail FROM r WHERE other UNION ALL SELECT file, 'audit field **Owner:**' FROM r WHERE NOT other AND k IN (1, 2) UNION ALL SELECT file, 'no status' FROM r WHERE NOT other AND k = 2 UNION ALL SELECT file, 'not closed' FROM r WHERE NOT other AND k IN (1, 5)"
    " UNION ALL SELECT file, 'closure field **Closure evidence:**' FROM r WHERE NOT other AND k = 3 UNION ALL SELECT file, 'empty evidence' FROM r WHERE NOT other AND (k = 3 OR (k = 0 AND doc_id % 4 = 0))"
)
def defect_records(spark: SparkSession, d: str) -> DataFrame:
    """Defect records that aren't closed with evidence: one for each document, with its text below."""
    n = F.col("doc_id")
    path = F.concat(F.lit("audit/"), F.when(n % 9 == 0, "x/").otherwise(""), F.lit("r"), n.cast("string"), F.when(n % 7 == 0, ".txt").otherwise(".md"))
    rows = table(spark, d, "documents").select(path.alias("path"), F.concat(F.expr(RECORD), F.lit("\n"), F.coalesce("text", F.lit(""))).alias("text"))
    return ct.defect_records(rows, "audit", ["closed", "fixed"], ["**Owner:**"], ["**Closure evidence:**"]).select("file", "detail")


SETTINGS = """s AS (SELECT source, count(*) FILTER (lang = 'en') AS e FROM documents WHERE source IS NOT NULL GROUP BY source), g AS (SELECT source AS file, rule, detail FROM (
  SELECT source, 'governance.verification-unavailable' AS rule, 'unverified' AS detail, e % 5 = 0 AS hit FROM s UNION ALL SELECT source, 'governance.pull-request-access', 'configuration_drift', e % 5 <> 0 AND e % 2 = 1 FROM s
  UNION ALL SELECT source, 'governance.maintainer-branches', 'configuration_drift', e % 5 <> 0 AND e % 3 = 0 FROM s UNION ALL SELECT source, 'governance.bypass-visibility', 'unverified', e % 5 <> 0 AND e % 4 = 0 FROM s) WHERE hit)"""


@query(f"WITH {SETTINGS} SELECT rule, file, detail FROM g")
def governance(spark: SparkSession, d: str) -> DataFrame:
    """Repository settings against the central policy: a repository for each source, its settings from the number of its English documents."""
    english = F.count(F.when(F.col("lang") == "en", 1))
    per = table(spark, d, "documents").where("source is not null").groupBy(F.col("source").alias("repository")).agg(english.alias("e"))
    policy = per.select("repository", F.lit("maintainers").alias("pull_access"), F.array(F.lit("main"), F.lit("dev")).alias("branches"))
    access = F.when(F.col("e") % 2 == 1, "all").otherwise("maintainers")
    held = F.when(F.col("e") % 3 == 0, F.array(F.lit("main"), F.lit("x"))).otherwise(F.array(F.lit("dev"), F.lit("main")))
    settings = per.select("repository", access.alias("pull_access"), held.alias("branches"), (F.col("e") % 4 != 0).alias("bypass_visible"), (F.col("e") % 5 != 0).alias("verified"))
    return ct.governance(settings, policy).select("rule", "file", "detail")


@query(f"""WITH {SETTINGS}, {VERSIONS}, {FIRST}, a AS (SELECT count(*) AS n FROM {ALL_FOUND}), x AS (SELECT count(*) AS n, coalesce(bool_or(detail = 'unverified'), false) AS u FROM g)
SELECT CASE WHEN u THEN 'incomplete' WHEN a.n + x.n > 0 THEN 'completed_with_warnings' ELSE 'completed' END AS status, x.n AS governance FROM a, x""")
def governance_fold(spark: SparkSession, d: str) -> DataFrame:
    """The run's status after the sources' governance findings."""
    return re_.governance_status(re_.run_status(scan(_versions(spark, d), places=False), spark.range(0)), governance(spark, d))


RULES = ", ".join(f"('{r}', '{c}', {repr(v.TOPICS.get(c)) if v.TOPICS.get(c) else 'NULL'})" for r, c in sorted({**v.CATEGORIES, **{r: c for r, c, _, _ in v.PATTERN_RULES}}.items()))


@query(f"WITH {VERSIONS}, {FIRST}, a AS (SELECT rule, count(*) AS findings FROM {ALL_FOUND} GROUP BY rule) SELECT t.rule, category, topic, coalesce(findings, 0) AS findings FROM (VALUES {RULES}) t(rule, category, topic) LEFT JOIN a ON a.rule = t.rule")
def rule_catalog(spark: SparkSession, d: str) -> DataFrame:
    """The catalog's rules outside the credential families, with their findings in the documents."""
    found = scan(_versions(spark, d), places=False).groupBy("rule").agg(F.count("*").alias("findings"))
    return de.rules_table(spark).where("category <> 'Credentials'").join(found, "rule", "left").select("rule", "category", "topic", F.coalesce("findings", F.lit(0)).alias("findings"))


@query(f"WITH {VERSIONS}, {FIRST} SELECT CASE WHEN CAST(substr(commit, 2) AS INT) < 4 THEN 1 ELSE 2 END AS run, rule, path, count(*) AS findings FROM {ALL_FOUND} GROUP BY ALL")
def incremental_scan(spark: SparkSession, d: str) -> DataFrame:
    """Two runs, over the first half of the commits and over all of them: the second scans what the first has not seen."""
    at = f"{shared_dir(spark)}/lodestone/{uuid.uuid4().hex}"
    all_, out = _versions(spark, d), None
    for run, now in ((1, all_.where("seq < 4")), (2, all_)):
        chosen = written(seen.unseen(now, seen.read_seen(spark, at)))
        found = scan(seen.with_text(now, chosen), places=False).groupBy("rule", "path").agg(F.count("*").alias("findings")).withColumn("run", F.lit(run))
        seen.remember(chosen, at)
        out = found if out is None else out.unionByName(found)
    return out.select("run", "rule", "path", "findings")


LINES = "length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), ''))"
NAMED = "CASE doc_id % 6 WHEN 0 THEN 'docs/team' || doc_id || '.md' WHEN 1 THEN 'docs/use' || doc_id || '.md' WHEN 2 THEN 'm' || doc_id || '/AUTHORS' WHEN 3 THEN 'log' || doc_id || '.txt' WHEN 4 THEN 'm' || doc_id || '/package.json' ELSE 'src/x' || doc_id || '.py' END"


@query(f"SELECT 'contribution.cursor-attribution' AS rule, {NAMED} AS file, CAST(CASE doc_id % 6 WHEN 0 THEN 5 WHEN 3 THEN 1 ELSE {LINES} + 2 END AS INT) AS line FROM documents WHERE doc_id % 6 NOT IN (1, 5)")
def attribution_marks(spark: SparkSession, d: str) -> DataFrame:
    """Tool identities under headings, in contributors' files, on trailers and behind contributor fields, around the documents' texts."""
    k, text = F.col("doc_id") % 6, F.coalesce("text", F.lit(""))
    made = (
        F.when(k == 0, F.concat(F.lit("# Team\n\n## Contributors\n\n- Cursor\n"), text))
        .when(k == 1, F.concat(text, F.lit("\n## Contributors\n\n## Usage\n\nthe cursor\n")))
        .when(k == 2, F.concat(text, F.lit("\nCursor Agent")))
        .when(k == 3, F.concat(F.lit("Co-authored-by: Cursor <x@example.invalid>\n"), text))
        .when(k == 4, F.concat(text, F.lit('\n{"author": "cursor"}')))
        .otherwise(F.concat(F.lit("# Authors\n- cursor\n"), text))
    )
    return ct.attribution(table(spark, d, "documents").select(F.expr(NAMED).alias("path"), made.alias("text"))).select("rule", "file", "line")
