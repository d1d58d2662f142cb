"""All registered queries of the audit engine, each with its SQL form where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import values as v
from ..operators import contracts as ct
from ..operators import detect as de
from ..operators import relate as re_
from ..sources.versions import admissible, branches, changed, commit_meta, pages_as_versions, table, versions
from . import formats, policies  # noqa: F401 (they register their queries)
from . import oracle as o
from .registry import ORACLE_SQL, QUERIES, query
from .scan import scan
from .shared import written


def _versions(spark, d) -> DataFrame:
    return versions(table(spark, d, "documents"))


def _located(spark, d, family, value: bool = True) -> DataFrame:
    found = de.candidates(_versions(spark, d), (family,))
    return found.select("doc_id", "path", "commit", "start", F.col("end").alias("finish"), "line", F.col("column").alias("col"), "value", "basis")


LOCATED = "SELECT doc_id, path, commit, start, finish, CAST(line AS INT) AS line, CAST(col AS INT) AS col, value FROM "


def _only(basis: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _located(spark, d, de.personal).where(F.col("basis").startswith(basis)).drop("basis")

    return run


for _name, _basis, _sql in (
    ("email_findings", "Email", o.spans("v", o.EMAIL)),
    ("phone_findings", "International", o.spans("v", o.PHONE)),
    ("ssn_findings", "National", o.ssns("v")),
    ("card_findings", "Payment", o.cards("v")),
):
    QUERIES[_name] = _only(_basis)
    ORACLE_SQL[_name] = f"WITH {o.VERSIONS} {LOCATED} {_sql}"


@query(f"WITH {o.VERSIONS} {LOCATED} {o.ips('v')}")
def ip_findings(spark: SparkSession, d: str) -> DataFrame:
    """IP literals outside loopback and documentation ranges."""
    return _located(spark, d, de.network).drop("basis")


TOKENS = r'token\s*=\s*"[^"]*"'
ESCAPED = r"token\s*=\s*&quot"  # a bare value in HTML
PASSWORDS = r"\bpassword=[^\s,;#}\]\"'][^\s,;#}\]]*"
BINDINGS = f"""(SELECT doc_id, path, commit, value, rule FROM (
  SELECT doc_id, path, commit, regexp_extract(value, '"([^"]*)"', 1) AS value, 'privacy.credential.binding' AS rule FROM {o.spans("v", TOKENS)}
  UNION ALL SELECT doc_id, path, commit, substr(value, 10) AS value, 'privacy.credential.binding' AS rule FROM {o.spans("v", PASSWORDS)}))"""


@query(f"WITH {o.VERSIONS} SELECT * FROM {BINDINGS}")
def credential_bindings(spark: SparkSession, d: str) -> DataFrame:
    """Literal assignments to credential fields."""
    found = de.candidates(_versions(spark, d), (de.bound,), places=False).where(F.col("rule").startswith("privacy.credential"))
    return found.select("doc_id", "path", "commit", "value", "rule")


ALL_FOUND = f"""(SELECT path, commit, doc_id, rule, value FROM (
  SELECT path, commit, doc_id, value, 'privacy.personal.identifier' AS rule FROM (SELECT * FROM {o.spans('f', o.EMAIL)} UNION ALL SELECT * FROM {o.spans('f', o.PHONE)} UNION ALL SELECT * FROM {o.ssns('f')} UNION ALL SELECT * FROM {o.cards('f')})
  UNION ALL SELECT path, commit, doc_id, value, 'privacy.endpoint.ip-address' AS rule FROM {o.ips('f')}
  UNION ALL SELECT path, commit, doc_id, value, rule FROM {BINDINGS.replace('FROM v ', 'FROM f ')}
  UNION ALL SELECT path, commit, doc_id, value, CASE WHEN regexp_matches(value, '^(?:AKIA|ASIA)[A-Z2-7]{{16}}$') THEN 'privacy.credential.format.aws-key-id' ELSE 'privacy.credential.format.candidate-prefix' END AS rule FROM {o.spans('f', chr(92) + 'b(?:AKIA|ASIA)[A-Z0-9]{16}' + chr(92) + 'b')}))"""


@query(f"WITH {o.VERSIONS}, {o.FIRST} SELECT rule, count(*) AS findings, count(DISTINCT path) AS paths FROM {ALL_FOUND} GROUP BY rule")
def findings_by_rule(spark: SparkSession, d: str) -> DataFrame:
    """The whole catalog over each version once: findings and paths per rule."""
    return scan(_versions(spark, d), places=False).groupBy("rule").agg(F.count("*").alias("findings"), F.countDistinct("path").alias("paths"))


@query(f"WITH {o.VERSIONS}, {o.FIRST} SELECT path, commit, rule, count(*) AS findings FROM {ALL_FOUND} GROUP BY ALL")
def finding_counts(spark: SparkSession, d: str) -> DataFrame:
    """Findings per file version and rule."""
    return re_.finding_counts(scan(_versions(spark, d), places=False))


@query(f"""WITH {o.VERSIONS}, {o.FIRST} SELECT DISTINCT path, CASE WHEN rule LIKE 'privacy.credential%' THEN 'privacy-credentials' WHEN rule LIKE 'privacy.endpoint%' THEN 'privacy-endpoints' ELSE 'privacy-personal-data' END AS topic FROM {ALL_FOUND}""")
def semantic_topics(spark: SparkSession, d: str) -> DataFrame:
    """Review topics that each file's findings call for."""
    return scan(_versions(spark, d), places=False).where("topic is not null").select("path", "topic").distinct()


def _exceptions(found: DataFrame) -> DataFrame:
    return found.where("rule = 'privacy.endpoint.ip-address'").groupBy("rule", "path").agg(F.min("value").alias("value"))


@query(f"""WITH {o.VERSIONS}, {o.FIRST}, a AS (SELECT * FROM {ALL_FOUND}), e AS (SELECT rule, path, min(value) AS value FROM a WHERE rule = 'privacy.endpoint.ip-address' GROUP BY ALL)
SELECT a.path, a.rule, count(e.value) AS exempted, count(*) - count(e.value) AS kept FROM a LEFT JOIN e USING (rule, path, value) GROUP BY ALL""")
def exact_exceptions(spark: SparkSession, d: str) -> DataFrame:
    """Suppression by exact exceptions: exempted candidates are counted, not lost."""
    found = written(de.introduced(de.candidates(_versions(spark, d), places=False).select("path", "oid", "rule", "start", "end", "value", *de.ORDER)))
    x = F.col("exempt").cast("long")
    return re_.with_exempt(found, _exceptions(found)).groupBy("path", "rule").agg(F.sum(x).alias("exempted"), F.sum(1 - x).alias("kept"))


@query(f"""WITH {o.VERSIONS}, {o.FIRST}, a AS (SELECT * FROM {o.ips('f')}), w AS (SELECT min(value) AS ip FROM a)
SELECT path, count(*) AS findings FROM a WHERE NOT (value IN (SELECT ip FROM w) AND path LIKE 'documents/e%.txt') GROUP BY path""")
def allowed_addresses(spark: SparkSession, d: str) -> DataFrame:
    """IP findings less an address that is allowed in two paths only."""
    found = written(de.introduced(de.candidates(_versions(spark, d), (de.network,), places=False).select("path", "oid", "rule", "start", "end", "value", *de.ORDER)))
    allow = found.agg(F.min("value").alias("ip")).withColumn("path_regex", F.lit(tx.glob_regex("documents/e*.txt")))
    return re_.without_allowed_ips(found, allow).groupBy("path").agg(F.count("*").alias("findings"))


HOST = "lower(regexp_extract(url, '^[^:]+://([^/:?#]*)', 1))"


@query(f"SELECT {HOST} AS host, count(*) AS pages, CAST(sum(CASE WHEN {HOST} IN ('example.com', 'example.org', 'example.net') OR regexp_matches({HOST}, '[.]example[.](com|org|net)$') THEN 0 ELSE 1 END) AS BIGINT) AS findings FROM pages GROUP BY 1")
def endpoint_hosts(spark: SparkSession, d: str) -> DataFrame:
    """Pages' hosts and how many of their URLs are endpoint findings (example hosts never are)."""
    url = F.col("url")
    found = F.size(de.endpoints(url, F.lit("pages.txt")))
    return table(spark, d, "pages").select(de.url_host(url).alias("host"), found.cast("long").alias("n")).groupBy("host").agg(F.count("*").alias("pages"), F.sum("n").alias("findings"))


@query(f"""WITH f AS (SELECT page_id AS doc_id, 'pages/' || page_id || '.html' AS path, 'c0' AS commit, html AS text FROM pages WHERE html IS NOT NULL) SELECT rule, count(*) AS findings FROM (SELECT rule FROM {ALL_FOUND} UNION ALL SELECT 'privacy.credential.binding' FROM {o.spans('f', ESCAPED)}) GROUP BY rule""")
def page_findings(spark: SparkSession, d: str) -> DataFrame:
    """The whole catalog over the pages' HTML."""
    return scan(pages_as_versions(table(spark, d, "pages")), places=False).groupBy("rule").agg(F.count("*").alias("findings"))


@query(f"""WITH f AS (SELECT conv_id AS doc_id, 'conversations/' || conv_id || '.txt' AS path, 'c0' AS commit, coalesce(text, '') || CASE turn % 3 WHEN 0 THEN ' write to bob' || conv_id || '@corp-mail.de' WHEN 1 THEN chr(10) || 'the server is 8.8.' || conv_id % 250 || '.4 now' ELSE '' END AS text FROM conversations)
SELECT rule, count(*) AS findings, count(DISTINCT path) AS paths FROM {ALL_FOUND} GROUP BY rule""")
def conversation_findings(spark: SparkSession, d: str) -> DataFrame:
    """The whole catalog over conversation turns, one file per conversation; an address stands behind two of three turns."""
    turn, conv = F.col("turn") % 3, F.col("conv_id").cast("string")
    more = F.when(turn == 0, F.concat(F.lit(" write to bob"), conv, F.lit("@corp-mail.de"))).when(turn == 1, F.concat(F.lit("\nthe server is 8.8."), (F.col("conv_id") % 250).cast("string"), F.lit(".4 now"))).otherwise("")
    turns = table(spark, d, "conversations").select(F.concat(F.lit("conversations/"), conv, F.lit(".txt")).alias("path"), "turn", F.concat(F.coalesce("text", F.lit("")), more).alias("text"))
    return de.candidates(turns, places=False).groupBy("rule").agg(F.count("*").alias("findings"), F.countDistinct("path").alias("paths"))


def _admitted(spark, d) -> DataFrame:
    n = F.col("doc_id")
    raw = _versions(spark, d).withColumns(
        {
            "kind": F.when(n % 50 == 0, "commit").otherwise("blob"),
            "mode": F.when(n % 50 == 1, "120000").otherwise("100644"),
            "content": F.when(n % 50 == 2, F.concat(F.unhex(F.lit("FF00")), F.col("text").cast("binary"))).when(n % 50 == 3, F.concat(F.lit("version https://git-lfs.github.com/spec/v1\n").cast("binary"), F.col("text").cast("binary"))).otherwise(F.col("text").cast("binary")),
        }
    )
    return admissible(raw.drop("text"))


REASON = "CASE doc_id % 50 WHEN 0 THEN 'submodule' WHEN 1 THEN 'symlink' WHEN 2 THEN 'non-UTF-8 or binary' WHEN 3 THEN 'LFS pointer' END"


@query(f"SELECT coalesce({REASON}, 'text') AS state, count(*) AS versions FROM documents GROUP BY 1")
def admissibility(spark: SparkSession, d: str) -> DataFrame:
    """Versions by what they are: text, or the first reason to leave them out."""
    return _admitted(spark, d).select(F.coalesce("reason", F.lit("text")).alias("state")).groupBy("state").agg(F.count("*").alias("versions"))


@query(f"WITH {o.VERSIONS} SELECT count(*) FILTER (doc_id % 50 > 3) AS text_versions, CAST(sum(size) FILTER (doc_id % 50 > 3) AS BIGINT) AS bytes, count(DISTINCT commit) AS commits, count(*) FILTER (doc_id % 50 <= 3) AS excluded FROM v")
def scan_coverage(spark: SparkSession, d: str) -> DataFrame:
    """What a scan covered."""
    return re_.scan_coverage(_admitted(spark, d))


@query(f"WITH {o.VERSIONS} SELECT path, array_to_string(list_sort(list(DISTINCT commit)), ',') AS commits, count(*) FILTER (doc_id % 50 > 3) AS inspected, count(*) FILTER (doc_id % 50 <= 3) AS excluded FROM v GROUP BY path")
def review_files(spark: SparkSession, d: str) -> DataFrame:
    """Per file its commits in order, and inspected and excluded versions."""
    return re_.review_files(_admitted(spark, d)).withColumn("commits", F.array_join("commits", ","))


@query(f"WITH {o.VERSIONS}, {o.FIRST} SELECT doc_id, path, commit, oid FROM f")
def introducing_versions(spark: SparkSession, d: str) -> DataFrame:
    """Each (path, object) at the commit that introduces it."""
    return de.first_versions(_versions(spark, d).select("doc_id", "path", "commit", "seq", "oid")).select("doc_id", "path", "commit", "oid")


@query(f"WITH {o.VERSIONS} SELECT doc_id, path, commit FROM v WHERE seq = 0 OR (seq IN (2, 4, 6) AND (seq % 4 = 0) = (path IN ('documents/de.txt', 'documents/fr.txt')))")
def range_scan(spark: SparkSession, d: str) -> DataFrame:
    """Versions of a range's commits that changed against the first parent; a root commit's all."""
    vs = _versions(spark, d)
    commits = spark.createDataFrame([("c0", None), ("c2", "c1"), ("c4", "c3"), ("c6", "c5")], "commit string, parent string")
    touched = vs.where(F.col("seq") % 2 == 0).where((F.col("seq") % 4 == 0) == F.col("path").isin("documents/de.txt", "documents/fr.txt")).select("commit", "path")
    return changed(commits, vs, touched).select("doc_id", "path", "commit")


HEAD = "h AS (SELECT path, oid FROM v QUALIFY row_number() OVER (PARTITION BY path ORDER BY seq DESC, doc_id DESC) = 1)"


@query(f"WITH {o.VERSIONS}, {HEAD}, g AS (SELECT * FROM h WHERE path <> 'documents/es.txt') SELECT v.path, g.oid IS NULL AS removed, count(*) AS versions FROM v LEFT JOIN g USING (path) WHERE g.oid IS NULL OR v.oid <> g.oid GROUP BY ALL")
def superseded_versions(spark: SparkSession, d: str) -> DataFrame:
    """Versions that the head no longer has, and whether their path is gone from it."""
    vs = _versions(spark, d)
    head = vs.groupBy("path").agg(F.max_by("oid", F.struct("seq", "doc_id")).alias("oid")).where("path <> 'documents/es.txt'")
    return re_.superseded(vs, head).groupBy("path", "removed").agg(F.count("*").alias("versions"))


@query(f"""WITH {o.VERSIONS}, {o.FIRST}, n AS (SELECT (SELECT count(*) FROM {ALL_FOUND}) AS findings, (SELECT count(*) FROM documents WHERE doc_id % 50 <= 3) AS incomplete)
SELECT CASE WHEN incomplete > 0 THEN 'incomplete' WHEN findings > 0 THEN 'completed_with_warnings' ELSE 'completed' END AS status, CASE WHEN incomplete > 0 THEN 1 ELSE 0 END AS exit_code, findings, incomplete FROM n""")
def run_status(spark: SparkSession, d: str) -> DataFrame:
    """The run's status from the scan's findings and the versions that aren't text."""
    return re_.run_status(scan(_versions(spark, d), places=False), _admitted(spark, d).where("reason is not null"))


@query(f"""WITH {o.VERSIONS}, {o.FIRST}, a AS (SELECT rule, count(*) AS findings FROM {ALL_FOUND} GROUP BY 1), c AS (SELECT unnest(['privacy.personal.identifier', 'privacy.endpoint.ip-address', 'privacy.credential.binding', 'repository.hygiene']) AS rule)
SELECT coalesce(c.rule, a.rule) AS rule, coalesce(c.rule, '') = 'repository.hygiene' AS evaluated, false AS blocking, coalesce(findings, 0) AS findings FROM c FULL JOIN a ON c.rule = a.rule""")
def rule_sets(spark: SparkSession, d: str) -> DataFrame:
    """The rules of a run: those of the catalog (four here), those evaluated, those with findings, and which of them block."""
    names = spark.createDataFrame([("privacy.personal.identifier",), ("privacy.endpoint.ip-address",), ("privacy.credential.binding",)], "rule string")
    evaluated = spark.createDataFrame([("repository.hygiene",)], "rule string")
    return re_.rule_sets(scan(_versions(spark, d), places=False), evaluated, names)


REQUEST = "r AS (SELECT doc_id AS index, sha256(coalesce(text, '')) AS identity FROM documents)"
REVIEW = "w AS (SELECT CASE WHEN index % 31 = 4 THEN index + 10000000 ELSE index END AS index, CASE WHEN index % 29 = 3 THEN 'x' ELSE identity END AS identity, CASE index % 4 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'false_positive' WHEN 2 THEN 'uncertain' ELSE CASE WHEN index % 23 = 2 THEN 'maybe' ELSE 'confirmed' END END AS verdict FROM r WHERE index % 37 <> 0)"


def _receipt(spark, d) -> tuple[DataFrame, DataFrame]:
    r = table(spark, d, "documents").select(F.col("doc_id").alias("index"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("identity"))
    i = F.col("index")
    verdict = F.when(i % 4 == 0, "confirmed").when(i % 4 == 1, "false_positive").when(i % 4 == 2, "uncertain").otherwise(F.when(i % 23 == 2, "maybe").otherwise("confirmed"))
    w = r.where(i % 37 != 0).select(F.when(i % 31 == 4, i + 10000000).otherwise(i).alias("index"), F.when(i % 29 == 3, "x").otherwise(F.col("identity")).alias("identity"), verdict.alias("verdict"))
    return r, w


@query(f"""WITH {REQUEST}, {REVIEW} SELECT coalesce(r.index, w.index) AS index, CASE WHEN w.index IS NULL THEN 'missing' WHEN r.index IS NULL THEN 'unknown' WHEN r.identity <> w.identity THEN 'identity' ELSE 'verdict' END AS violation
FROM r FULL JOIN w ON r.index = w.index WHERE w.index IS NULL OR r.index IS NULL OR r.identity <> w.identity OR w.verdict = 'maybe'""")
def review_reconciliation(spark: SparkSession, d: str) -> DataFrame:
    """Violations of the one-to-one match between requested findings and a receipt's reviews."""
    return re_.reconcile(*_receipt(spark, d))


@query(f"WITH {REQUEST}, {REVIEW}, k AS (SELECT unnest(['confirmed', 'false_positive', 'uncertain']) AS verdict) SELECT k.verdict, count(w.verdict) AS reviews FROM k LEFT JOIN w ON w.verdict = k.verdict GROUP BY 1")
def verdict_counts(spark: SparkSession, d: str) -> DataFrame:
    """Reviews by verdict, with all three verdicts present."""
    return re_.verdict_counts(_receipt(spark, d)[1])


@query(f"WITH {REQUEST}, {REVIEW} SELECT 'incomplete' AS status, CASE WHEN count(*) FILTER (verdict IN ('confirmed', 'uncertain')) > 0 THEN 'action_required' ELSE 'no_action' END AS disposition FROM w")
def receipt_disposition(spark: SparkSession, d: str) -> DataFrame:
    """A receipt's completion and disposition, with a limitation stated."""
    return re_.disposition(re_.verdict_counts(_receipt(spark, d)[1]), True, 0, 1)


@query(f"WITH {REQUEST}, {REVIEW} SELECT r.index, coalesce(w.verdict, 'unreviewed') AS judgment FROM r LEFT JOIN w ON r.index = w.index")
def reviewed_findings(spark: SparkSession, d: str) -> DataFrame:
    """Findings under their verdicts."""
    r, w = _receipt(spark, d)
    return re_.reviewed(r.withColumn("judgment", F.lit("unreviewed")), w).select("index", "judgment")


IDENTITY = f"""a AS (SELECT doc_id, path, commit, start, finish, value, row_number() OVER (ORDER BY doc_id, start, value) AS k FROM (SELECT * FROM {o.spans('v', o.EMAIL)}))"""


@query(f"""WITH {o.VERSIONS}, {IDENTITY} SELECT doc_id AS index, violation FROM (SELECT doc_id, CASE WHEN doc_id % 7 = 1 THEN 'no rule' WHEN doc_id % 7 = 2 THEN 'literal evidence' WHEN doc_id % 7 = 3 THEN 'other version' WHEN doc_id % 7 = 4 THEN 'path' END AS violation FROM a) WHERE violation IS NOT NULL""")
def identity_violations(spark: SparkSession, d: str) -> DataFrame:
    """Findings' identities, some of them broken: without a rule, with other evidence, of another version, outside the repository."""
    found = de.candidates(_versions(spark, d), (de.personal,)).where(F.col("basis").startswith("Email"))
    k = F.col("doc_id") % 7
    made = found.select(
        F.col("doc_id").alias("index"),
        F.when(k == 4, F.concat(F.lit("../"), "path")).otherwise(F.col("path")).alias("file"),
        F.when(k == 1, "").otherwise(F.col("rule")).alias("rule"),
        F.col("start").alias("start"),
        F.when(k == 2, F.col("end") + 1).otherwise(F.col("end")).alias("end"),
        "line",
        F.col("line").alias("end_line"),
        "commit",
        F.col("value").alias("matched"),
        F.concat(F.lit("> "), "value").alias("context"),
        F.when(k == 3, "c-other").otherwise(F.col("commit")).alias("provenance_commit"),
    )
    return re_.identity_violations(made)


@query("""WITH p AS (SELECT source, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY 1), t AS (SELECT 'profile:' || source || ':' || i AS id, i FROM p, range(0, 3) r(i))
SELECT id, CASE i WHEN 1 THEN 'missing' ELSE 'text' END AS violation FROM t WHERE i > 0 UNION ALL SELECT 'privacy-endpoints', 'repeated' UNION ALL SELECT 'other', 'unknown'""")
def task_reviews(spark: SparkSession, d: str) -> DataFrame:
    """Review tasks of fixed topics, detectors and each source's profile, against reviews that leave some out."""
    made = lambda *ids: spark.createDataFrame([(i, i, "look") for i in ids], "id string, title string, prompt string")
    profile = table(spark, d, "documents").where("source is not null").select(F.col("source").alias("repository")).distinct()
    profile = profile.select("repository", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("index"), F.lit("check it").alias("prompt"))
    tasks = re_.review_tasks(made("scope"), made("privacy-endpoints"), profile)
    own = tasks.where("not endswith(id, ':1')").select("id", F.lit("done").alias("conclusion"), F.when(F.col("id").endswith(":2"), " ").otherwise("seen").alias("evidence"))
    more = spark.createDataFrame([("privacy-endpoints", "done", "again"), ("other", "done", "seen")], "id string, conclusion string, evidence string")
    return re_.task_violations(tasks, own.union(more))


@query(f"""WITH {o.VERSIONS} SELECT path, 'commits' AS violation FROM (SELECT path, max(seq) AS last FROM v GROUP BY 1) WHERE last >= 6 UNION ALL SELECT '/abs/x', 'path'""")
def manifest_violations(spark: SparkSession, d: str) -> DataFrame:
    """The files of a review against a scan of six of the eight commits."""
    files = re_.review_files(_admitted(spark, d)).union(spark.createDataFrame([("/abs/x", ["c0"], 1, 0)], "path string, commits array<string>, inspected long, excluded long"))
    commits = _versions(spark, d).where("seq < 6").select("commit").distinct()
    return re_.manifest_violations(files, commits, "range")


@query("""SELECT doc_id AS index, CASE doc_id % 6 WHEN 1 THEN 'path' WHEN 2 THEN 'line' WHEN 3 THEN 'verdict' WHEN 4 THEN 'no commit' WHEN 5 THEN CASE WHEN doc_id % 8 = 7 THEN 'commit outside' END END AS violation FROM documents WHERE doc_id % 6 IN (1, 2, 3, 4) OR (doc_id % 6 = 5 AND doc_id % 8 = 7)""")
def additional_violations(spark: SparkSession, d: str) -> DataFrame:
    """Additional findings of a receipt, one for each document, some of them broken."""
    k = F.col("doc_id") % 6
    some = _versions(spark, d).select(
        F.col("doc_id").alias("index"),
        F.when(k == 1, "a/../b").otherwise(F.col("path")).alias("path"),
        F.when(k == 2, 0).otherwise(1).alias("line"),
        F.when(k != 4, F.when((k != 5) & (F.col("seq") == 7), "c0").otherwise(F.col("commit"))).alias("commit"),
        F.when(k == 3, "maybe").otherwise("confirmed").alias("verdict"),
        *(F.lit("said").alias(c) for c in ("category", "rule", "basis", "impact", "action")),
    )
    return re_.additional_violations(some, _versions(spark, d).where("seq < 7").select("commit"), "range")


RUNS = "(SELECT 'run' || (doc_id % 40) AS id, max(doc_id) AS finished_at, sum(n_chars)::VARCHAR AS content FROM documents GROUP BY 1)"


@query(f"SELECT id, CAST(finished_at AS BIGINT) AS finished_at FROM {RUNS} UNION ALL SELECT 'run-new', 10000000")
def run_ledger(spark: SparkSession, d: str) -> DataFrame:
    """The history with one known and one new run saved, newest first."""
    runs = table(spark, d, "documents").groupBy(F.concat(F.lit("run"), (F.col("doc_id") % 40).cast("string")).alias("id")).agg(F.max("doc_id").alias("finished_at"), F.sum("n_chars").cast("string").alias("content"))
    new = spark.createDataFrame([("run-new", 10000000, "x")], runs.schema)
    saved, _ = re_.ledger(runs, new.unionByName(runs.where("id = 'run3'")))
    return saved.select("id", "finished_at")


@query(f"""WITH {o.VERSIONS}, {o.FIRST} SELECT count(DISTINCT repository) AS repositories, count(DISTINCT repository || ' ' || commit) AS runs, CAST(max(doc_id) AS BIGINT) AS latest, (SELECT CAST(count(*) AS BIGINT) FROM {ALL_FOUND}) AS findings FROM v""")
def report_totals(spark: SparkSession, d: str) -> DataFrame:
    """Totals over runs, one for each repository and commit: repositories, runs, the latest, and the scan's findings."""
    vs, on = _versions(spark, d), ["repository", "commit"]
    found = scan(vs, places=False).groupBy(*on).agg(F.count("*").alias("findings"))
    runs = vs.groupBy(*on).agg(F.max("doc_id").alias("finished_at")).join(found, on, "left").withColumn("id", F.concat_ws(" ", *on))
    return re_.report_totals(runs)


@query("SELECT doc_id % 300 AS key, count(*) AS count FROM documents GROUP BY 1 HAVING count(*) > 1")
def repeated_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys that break a uniqueness rule."""
    return re_.duplicates(table(spark, d, "documents").select((F.col("doc_id") % 300).alias("key")), "key")


@query(f"WITH {o.VERSIONS} SELECT DISTINCT 'refs/heads/' || repository AS ref FROM v WHERE repository <> 'src1'")
def branch_inventory(spark: SparkSession, d: str) -> DataFrame:
    """Branch names from local and remote refs."""
    names = _versions(spark, d).select("repository", "doc_id")
    ref = F.when(F.col("repository") == "src1", F.lit("refs/remotes/origin/HEAD")).when(F.col("doc_id") % 2 == 0, F.concat(F.lit("refs/remotes/origin/"), "repository")).otherwise(F.concat(F.lit("refs/heads/"), "repository"))
    return branches(names.select(ref.alias("ref")))


@query("SELECT 'k' || doc_id AS commit, 'A' || doc_id || ' <a@example.com>' AS author, CAST(CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS INT) AS trailers, doc_id % 6 = 0 AS tool FROM documents")
def commit_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Authors and trailers of commit objects, and whether a tool is credited."""
    n = F.col("doc_id")
    text = F.concat(F.lit("tree 1\nauthor A"), n.cast("string"), F.lit(" <a@example.com>\ncommitter C <c@example.com>\n\nwork\n"), F.when(n % 6 == 0, "Co-authored-by: Cursor Agent <x@example.com>\n").when(n % 3 == 0, "Signed-off-by: B <b@example.com>\n").otherwise(""))
    meta = commit_meta(table(spark, d, "documents").select(F.concat(F.lit("k"), n.cast("string")).alias("commit"), text.alias("text")))
    hit = ct.commit_attribution(meta).select(F.col("detail").alias("commit"), F.lit(True).alias("tool"))
    return meta.join(hit, "commit", "left").select("commit", "author", F.size("trailers").alias("trailers"), F.coalesce("tool", F.lit(False)).alias("tool"))


# A tree of files made from documents: the path depends on the id, the text is the document's.
#: Line ends of a document's text.
NEWLINES = "length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), ''))"
KINDS = ("src/m{}.py", "build/o{}.log", "data/t{}.csv", "conf/c{}.json", "docs/guide/p{}.md", "docs/adrs/a{}.md", "ops/prod/{}.tfvars", "ops/sample/{}.tfvars", "data/s{}.parquet", "skills/x{}/SKILL.md")
TREE_SQL = "t AS (SELECT doc_id, CASE doc_id % 10 " + " ".join("WHEN {} THEN {}".format(k, " || ".join(f"'{x}'" if i % 2 == 0 else x for i, x in enumerate(p.replace("{}", "\0doc_id\0").split("\0")) if x)) for k, p in enumerate(KINDS)) + " END AS path, CASE WHEN doc_id % 10 = 3 AND doc_id % 3 = 0 THEN '{\"name\": 1, \"name\": 2}' WHEN doc_id % 10 = 3 AND doc_id % 3 = 1 THEN '[\"a\", \"b\"]' WHEN doc_id % 10 = 3 THEN '{\"name\": \"x\"}' ELSE text END AS text, 1000 * n_chars AS size FROM documents)"


def _tree(spark, d) -> DataFrame:
    n = F.col("doc_id").cast("string")
    k = F.col("doc_id") % 10
    path = F.coalesce(*(F.when(k == i, F.concat(F.lit(a), n, F.lit(b))) for i, (a, b) in enumerate(p.split("{}") for p in KINDS)))
    third = F.col("doc_id") % 3
    text = F.when((k == 3) & (third == 0), '{"name": 1, "name": 2}').when((k == 3) & (third == 1), '["a", "b"]').when(k == 3, '{"name": "x"}').otherwise(F.col("text"))
    return table(spark, d, "documents").select("doc_id", path.alias("path"), F.lit("blob").alias("kind"), (1000 * F.col("n_chars")).alias("size"), text.alias("text"))


def _files(df: DataFrame) -> DataFrame:
    return df.select("rule", "file", "detail")


@query(f"WITH {TREE_SQL} SELECT 'repository.required-path' AS rule, p AS file FROM (SELECT unnest(['src', 'src/', 'docs/guide', 'docs/none', 'README.md', 'data/t2.csv']) AS p) WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.path = p OR starts_with(t.path, rtrim(p, '/') || '/'))")
def required_paths(spark: SparkSession, d: str) -> DataFrame:
    """Declared paths that neither a file nor a directory has."""
    return ct.required_paths(_tree(spark, d), ["src", "src/", "docs/guide", "docs/none", "README.md", "data/t2.csv"]).select("rule", "file")


@query(f"WITH {TREE_SQL} SELECT 'repository.hygiene' AS rule, path AS file, CASE WHEN doc_id % 10 IN (1, 8) THEN 'artifact' ELSE 'size' END AS detail FROM t WHERE doc_id % 10 IN (1, 8) OR size > 5242880")
def hygiene(spark: SparkSession, d: str) -> DataFrame:
    """Temporary, generated and oversized files."""
    return _files(ct.hygiene(_tree(spark, d)))


@query(f"WITH {TREE_SQL} SELECT 'repository.data-file-admission' AS rule, path AS file, CASE doc_id % 10 WHEN 8 THEN 'binary' ELSE 'dump' END AS detail FROM t WHERE doc_id % 10 IN (2, 8)")
def data_files(spark: SparkSession, d: str) -> DataFrame:
    """Binary data and dumps that no fixture admits."""
    return _files(ct.data_files(_tree(spark, d)))


@query(f"""WITH {TREE_SQL} SELECT CASE WHEN doc_id % 4 = 1 THEN 'repository.json-not-allowlisted' WHEN doc_id % 3 = 0 THEN 'repository.json-invalid' ELSE 'repository.json-shape-invalid' END AS rule, path AS file,
CASE WHEN doc_id % 4 = 1 THEN '' WHEN doc_id % 20 < 10 THEN 'config-object' ELSE 'string-array' END AS detail FROM t
WHERE doc_id % 10 = 3 AND (doc_id % 4 = 1 OR doc_id % 3 = 0 OR (doc_id % 3 = 1 AND doc_id % 20 < 10) OR (doc_id % 3 = 2 AND doc_id % 20 >= 10))""")
def json_files(spark: SparkSession, d: str) -> DataFrame:
    """JSON outside its admissions, not strict, or of another shape."""
    t = _tree(spark, d)
    admitted = t.where((F.col("doc_id") % 10 == 3) & (F.col("doc_id") % 4 != 1)).select("path", F.when(F.col("doc_id") % 20 < 10, "config-object").otherwise("string-array").alias("kind"))
    return _files(ct.json_files(t, admitted))


@query(f"""WITH {TREE_SQL} SELECT rule, file FROM (
SELECT 'repository.documentation-required-path' AS rule, unnest(['README.md', 'docs/README.md']) AS file
UNION ALL SELECT 'repository.documentation-required-section', 'docs/protocols'
UNION ALL SELECT 'repository.documentation-local-asset', path FROM t WHERE starts_with(path, 'build/')
UNION ALL SELECT 'repository.documentation-agent-entrypoint', path FROM t WHERE starts_with(path, 'skills/')
UNION ALL SELECT 'repository.documentation-formal-path', path FROM t WHERE starts_with(path, 'docs/guide/'))""")
def documentation(spark: SparkSession, d: str) -> DataFrame:
    """Entry points, sections, local assets, agent bundles and formal places of documentation."""
    return ct.documents(_tree(spark, d), ["README.md", "docs/README.md"], ["docs/adrs/", "docs/protocols/"]).select("rule", "file")


@query(f"WITH {TREE_SQL} SELECT 'repository.documentation-link-target' AS rule, path AS file, CAST({NEWLINES} + 3 AS INT) AS line, 'docs/guide/p' || (doc_id + 5) || '.md' AS detail FROM t WHERE doc_id % 10 = 5 AND doc_id % 20 = 5")
def broken_links(spark: SparkSession, d: str) -> DataFrame:
    """Local Markdown links without a target in the tree."""
    t = _tree(spark, d)
    n = F.col("doc_id")
    whole = F.coalesce("text", F.lit(""))
    to = F.when(n % 20 == 5, n + 5).otherwise(n - 1).cast("string")
    text = F.concat(whole, F.lit("\nsee [home](https://example.com) and [all](../guide/)\n![x](<../guide/p"), to, F.lit('.md>) [top](#top "t")'))
    return ct.broken_links(t.withColumn("text", F.when(n % 10 == 5, text).otherwise(whole)))


@query(f"WITH {TREE_SQL} SELECT r AS rule, path AS file FROM t, (SELECT unnest(['repository.documentation-generated-source', 'repository.documentation-generated-update']) AS r) WHERE doc_id % 10 = 4 AND ((r LIKE '%source' AND doc_id % 3 <> 0) OR (r LIKE '%update' AND doc_id % 4 <> 0))")
def generated_documents(spark: SparkSession, d: str) -> DataFrame:
    """Generated documentation without its source or its way of update."""
    n = F.col("doc_id")
    whole = F.coalesce("text", F.lit(""))
    text = F.concat(whole, F.lit("\n<!-- generated -->\n"), F.when(n % 3 == 0, "Generated from x\n").otherwise(""), F.when(n % 4 == 0, "update command: make\n").otherwise(""))
    return ct.generated(_tree(spark, d).withColumn("text", F.when(n % 10 == 4, text).otherwise(whole))).select("rule", "file")


@query(f"WITH {TREE_SQL} SELECT 'repository.server-material-path' AS rule, path AS file FROM t WHERE doc_id % 10 = 6")
def server_material(spark: SparkSession, d: str) -> DataFrame:
    """Deployment and secret material by path."""
    return ct.server_material(_tree(spark, d)).select("rule", "file")


@query(f"WITH {TREE_SQL} SELECT 'repository.server-security-signal' AS rule, path AS file, CAST({NEWLINES} + 3 AS INT) AS line, CASE WHEN doc_id % 20 = 0 THEN 'command-injection' ELSE 'weak-password-hash' END AS detail FROM t WHERE doc_id % 10 = 0")
def server_signals(spark: SparkSession, d: str) -> DataFrame:
    """The first place of each kind of security marker in each source file."""
    n = F.col("doc_id")
    whole = F.coalesce("text", F.lit(""))
    text = F.concat(whole, F.when(n % 20 == 0, "\nx\nrun(a, Shell  =   TRUE)\nshell=true").otherwise("\nx\nhashlib.MD5(password)"))
    return ct.server_signals(_tree(spark, d).withColumn("text", F.when(n % 10 == 0, text).otherwise(whole)))


@query(f"WITH {TREE_SQL} SELECT 'repository.dependency-commercial-signal' AS rule, 'src/m' || doc_id || '/package.json' AS file, CAST({NEWLINES} + 2 AS INT) AS line, 'proprietary' AS detail FROM t WHERE doc_id % 10 = 0 UNION ALL SELECT 'repository.dependency-commercial-signal', 'src/m' || doc_id || '/package.json', CAST({NEWLINES} + 3 AS INT), 'commercial license' FROM t WHERE doc_id % 20 = 0")
def commercial_signals(spark: SparkSession, d: str) -> DataFrame:
    """Commercial terms in dependency manifests."""
    n = F.col("doc_id")
    whole = F.coalesce("text", F.lit(""))
    own = F.concat(whole, F.lit("\n"), F.when(n % 20 == 0, '{"license": "Proprietary",\n"x": "commercial   LICENSE"}').otherwise('{"license": "Proprietary"}'))
    path = F.when(n % 10 == 0, F.concat(F.lit("src/m"), n.cast("string"), F.lit("/package.json"))).otherwise(F.col("path"))
    return ct.commercial_signals(_tree(spark, d).select("doc_id", path.alias("path"), F.when(n % 10 == 0, own).otherwise(whole).alias("text")))


@query(f"WITH {TREE_SQL} SELECT 'repository.dependency-boundary-evidence' AS rule, 'src/m' || doc_id || '/package.json' AS file, 'lib' || doc_id AS detail FROM t WHERE doc_id % 10 = 0 AND doc_id <> 10 UNION ALL SELECT 'repository.dependency-boundary-evidence', 'docs/dependencies.md', 'authorization|授权'")
def dependency_boundary(spark: SparkSession, d: str) -> DataFrame:
    """Declared dependencies and topics that the boundary evidence lacks."""
    n = F.col("doc_id")
    manifest = F.to_json(F.struct(F.col("text").alias("description"), F.create_map(F.concat(F.lit("Lib"), n.cast("string")), F.lit("1")).alias("dependencies")))
    path = F.when(n % 10 == 0, F.concat(F.lit("src/m"), n.cast("string"), F.lit("/package.json"))).otherwise(F.col("path"))
    made = _tree(spark, d).select(path.alias("path"), F.when(n % 10 == 0, manifest).otherwise(F.col("text")).alias("text"))
    page = spark.createDataFrame([("docs/dependencies.md", "Dependency and Commercial use\n\nusage\n boundary: lib10 only")], "path string, text string")
    return _files(ct.dependency_boundary(made.unionByName(page), ["docs/dependencies.md", "DEPENDENCY-USAGE.md"]))


@query("SELECT 'repository.branch-promotion-flow' AS rule, CAST(doc_id AS VARCHAR) AS file, d AS detail FROM documents, (VALUES (1, 'base outside the flow'), (2, 'other base than declared'), (2, 'base outside the flow'), (3, 'managed branch outside its flow'), (4, 'not the declared predecessor'), (3, 'not the declared predecessor')) x(k, d) WHERE doc_id % 5 = k")
def promotion_flow(spark: SparkSession, d: str) -> DataFrame:
    """Pull requests against a declared promotion flow."""
    k = F.col("doc_id") % 5
    head = F.when(k == 0, "beta").when(k == 1, "fix").when(k == 2, "beta").when(k == 3, "main").otherwise("fix")
    base = F.when(k == 0, "main").when(k == 1, "odd").when(k == 2, "odd").when(k == 3, "main").otherwise("main")
    pulls = table(spark, d, "documents").select(F.col("doc_id").alias("id"), head.alias("head"), base.alias("base"))
    return ct.promotion_flow(pulls, [("beta", "main")], ["dev"]).select("rule", "file", "detail")


@query("SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN '[absolute-path]' WHEN 1 THEN 'a/[redacted-email]/b' WHEN 2 THEN 'logs/[redacted-ip]/x' WHEN 3 THEN 'k/[redacted-id].txt' WHEN 4 THEN 'cfg/[credential]/y' ELSE 'src/m' || doc_id || '.py' END AS file FROM documents")
def redacted_paths(spark: SparkSession, d: str) -> DataFrame:
    """Locations without what is sensitive in them."""
    n = F.col("doc_id").cast("string")
    k = F.col("doc_id") % 6
    path = F.when(k == 0, F.concat(F.lit("/srv/"), n)).when(k == 1, F.concat(F.lit("a/u"), n, F.lit("@corp-mail.de/b"))).when(k == 2, F.lit("logs\\10.1.2.3\\x")).when(k == 3, F.concat(F.lit("k/"), F.repeat(F.lit("ab12"), 13), F.lit(".txt"))).when(k == 4, F.concat(F.lit("cfg/api_key="), n, F.lit("/y"))).otherwise(F.concat(F.lit("src/m"), n, F.lit(".py")))
    return table(spark, d, "documents").select("doc_id", tx.redact_path(path).alias("file"))


@query("""SELECT rule, count(*) AS findings FROM documents, (VALUES ('security.shell-execution', 0), ('security.disabled-verification', 0), ('workflow.mutable-action', 1)) r(rule, k) WHERE doc_id % 10 = k GROUP BY rule""")
def pattern_rules(spark: SparkSession, d: str) -> DataFrame:
    """The opt-in rule groups on source files and workflows made from documents, behind whose texts a case stands."""
    n = F.col("doc_id")
    case = F.when(n % 10 == 0, "\nsubprocess.run(x, shell=True)\nverify_signature = False\n").otherwise("\n- uses: a/b@v1\n")
    text = F.concat(F.coalesce("text", F.lit("")), case)
    path = F.when(n % 10 == 1, F.concat(F.lit(".github/workflows/w"), n.cast("string"), F.lit(".yml"))).otherwise(F.col("path"))
    t = _tree(spark, d).withColumn("text", text).withColumn("path", path)
    return de.candidates(t, (), ["code", "workflows", "dependencies"]).groupBy("rule").agg(F.count("*").alias("findings"))


@query("""SELECT CASE doc_id % 3 WHEN 0 THEN 'repository.data-file-admission' ELSE 'repository.json-not-allowlisted' END AS rule, CASE doc_id % 3 WHEN 0 THEN 'data/t' || doc_id || '.csv' ELSE 'conf/c' || doc_id || '.json' END AS file, 'c0' AS commit, CASE doc_id % 3 WHEN 0 THEN 'dump' ELSE '' END AS detail, CASE doc_id % 3 WHEN 1 THEN 'warning' ELSE 'error' END AS severity
FROM documents WHERE doc_id % 2 = 0""")
def historical_data(spark: SparkSession, d: str) -> DataFrame:
    """Data files that half of the paths' heads no longer have: dumps are errors, removed valid JSON a warning, invalid JSON an error."""
    n, k = F.col("doc_id"), F.col("doc_id") % 3
    name = F.when(k == 0, F.concat(F.lit("data/t"), n.cast("string"), F.lit(".csv"))).otherwise(F.concat(F.lit("conf/c"), n.cast("string"), F.lit(".json")))
    text = F.when(k == 1, F.to_json(F.struct("text"))).when(k == 2, F.concat(F.lit("{"), F.coalesce("text", F.lit("")))).otherwise(F.col("text"))
    docs = table(spark, d, "documents").select("doc_id", name.alias("path"), F.lit("o1").alias("oid"), F.lit("c0").alias("commit"), F.lit(0).alias("seq"), F.lit("blob").alias("kind"), F.col("n_chars").alias("size"), text.alias("text"))
    head = docs.where(n % 2 == 1).select("path", "oid")
    return ct.historical_data(docs, head, spark.createDataFrame([], "path string, kind string"))


@query(f"WITH {TREE_SQL} SELECT 'repository.documentation-markdown-read' AS rule, path AS file, CASE WHEN doc_id % 50 = 5 THEN 'non-text Git object' ELSE 'text unavailable' END AS reason FROM t WHERE doc_id % 50 IN (5, 15)")
def unread_documents(spark: SparkSession, d: str) -> DataFrame:
    """Markdown files that the documentation contracts can't read."""
    n = F.col("doc_id") % 50
    t = _tree(spark, d).withColumns({"mode": F.when(n == 5, "120000").otherwise("100644"), "text": F.when(n == 15, F.lit(None)).otherwise(F.coalesce("text", F.lit("")))})
    return ct.incomplete_text(t.where(F.lower("path").endswith(".md")), "repository.documentation-markdown-read")


from . import derived  # noqa: E402, F401 (registers its queries, which build on those above)
