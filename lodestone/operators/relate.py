"""Relational steps over candidates and findings: suppression, counts, coverage, status, review, ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scopes import in_scopes


def with_exempt(found: DataFrame, exceptions: DataFrame) -> DataFrame:
    """found with exempt: whether an exact exception (rule, path, value) names the candidate. One join; found is read once."""
    on = ["rule", "path", "value"]
    named = exceptions.select(*on).distinct().withColumn("exempt", F.lit(True))
    return found.join(named, on, "left").withColumn("exempt", F.coalesce("exempt", F.lit(False)))


def split_exempt(found: DataFrame, exceptions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, exempted) candidates by exact exceptions."""
    both = with_exempt(found, exceptions)
    return both.where(~F.col("exempt")).drop("exempt"), both.where("exempt").drop("exempt")


def canonical_ip(value: Column) -> Column:
    """One spelling of an address: IPv4 as it is, IPv6 in lower case with its zeros written out."""
    halves = F.split(F.lower(value), "::", -1)
    groups = lambda h: F.filter(F.split(h, ":", -1), lambda g: g != "")
    left, right = groups(F.get(halves, F.lit(0))), groups(F.coalesce(F.get(halves, F.lit(1)), F.lit("")))
    fill = F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - F.size(left) - F.size(right)))
    whole = F.transform(F.concat(left, fill, right), lambda g: F.regexp_replace(g, "^0+(?=.)", ""))
    return F.when(value.contains(":"), F.array_join(whole, ":")).otherwise(value)


def _without(found: DataFrame, keys: dict[str, Column], allow: DataFrame, on: Column) -> DataFrame:
    """found without rows that a row of allow matches; the keys are null for rows of other rules, which no row matches."""
    return found.withColumns(keys).join(allow, on, "left_anti").drop(*keys)


def _places(found: DataFrame, allow: DataFrame) -> tuple[DataFrame, Column]:
    """allow with the paths that it is for, and the condition that a candidate's path is one.

    A path_glob is resolved against the distinct paths first, by its literal parts, so that a candidate meets a rule by
    equal paths; a path_regex is compared with the path of each candidate whose other keys are equal.
    """
    if "path_glob" in allow.columns:
        pairs = in_scopes(found, allow, "path", "path_glob", policy=False).select(F.col("path").alias("_path"), F.col("pattern").alias("path_glob"))
        return allow.join(pairs, "path_glob").drop("path_glob"), F.col("path") == F.col("_path")
    return allow.withColumnRenamed("path_regex", "_path"), F.expr("path rlike _path")


def without_allowed_ips(found: DataFrame, allow: DataFrame) -> DataFrame:
    """Drops addresses that the allowlist (ip, and path_glob or path_regex) has for their path; other rules' candidates pass."""
    ip = F.when(F.col("rule") == "privacy.endpoint.ip-address", canonical_ip(F.col("value")))
    rules, here = _places(found, allow)
    allowed = rules.select(canonical_ip(F.col("ip")).alias("_allowed"), "_path")
    return _without(found, {"_ip": ip}, allowed, (F.col("_ip") == F.col("_allowed")) & here)


def without_allowed_hosts(found: DataFrame, allow: DataFrame) -> DataFrame:
    """Likewise for endpoints and for bindings of a host, by (host, scheme or null for any, and path_glob or path_regex).

    A binding has no scheme, so that only rows for any scheme allow it.
    """
    value, rule = F.col("value"), F.col("rule")
    url = F.regexp_extract(value, "^[^:]+://(?:[^/?#@]*@)?(\\[[^\\]]*\\]|[^/:?#]*)", 1)
    bare = F.regexp_replace(F.regexp_extract(value, "^(?:[^@]*@)?([^:/?#]*)", 1), "\\.+\\z", "")
    host = F.lower(F.when(rule == "privacy.endpoint.private-host", F.regexp_replace(url, "\\.+\\z", "")).when(rule == "privacy.endpoint.host-binding", bare))
    scheme = F.when(rule == "privacy.endpoint.private-host", F.lower(F.regexp_extract(value, "^([^:]+):", 1)))
    rules, here = _places(found, allow)
    a = rules.select(F.regexp_replace(F.lower("host"), "\\.+\\z", "").alias("_h"), F.lower("scheme").alias("_s"), "_path")
    on = (F.col("_host") == F.col("_h")) & (F.col("_s").isNull() | (F.col("_s") == F.col("_scheme"))) & here
    return _without(found, {"_host": host, "_scheme": scheme}, a, on)


def finding_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("path", "commit", "rule").agg(F.count("*").alias("findings"))


def with_topics(found: DataFrame, rules: DataFrame) -> DataFrame:
    """Category and topic by rule; the catalog has about a hundred rows."""
    return found.join(F.broadcast(rules), "rule", "left")


def scan_coverage(versions: DataFrame) -> DataFrame:
    """Text versions, their bytes, commits, and exclusions; versions have reason (null for text)."""
    return versions.agg(
        F.count(F.when(F.col("reason").isNull(), 1)).alias("text_versions"),
        F.coalesce(F.sum(F.when(F.col("reason").isNull(), F.col("size"))), F.lit(0)).cast("long").alias("bytes"),
        F.countDistinct("commit").alias("commits"),
        F.count("reason").alias("excluded"),
    )


def review_files(versions: DataFrame) -> DataFrame:
    """Per path its commits in order and how many versions were inspected and excluded."""
    per = versions.groupBy("path", "commit").agg(F.min("seq").alias("seq"), F.count(F.when(F.col("reason").isNull(), 1)).alias("i"), F.count("reason").alias("x"))
    return per.groupBy("path").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "commit"))), lambda s: s["commit"]).alias("commits"), F.sum("i").alias("inspected"), F.sum("x").alias("excluded"))


def superseded(versions: DataFrame, head: DataFrame) -> DataFrame:
    """Versions whose path has another object at the head, or none there (removed)."""
    h = head.select("path", F.col("oid").alias("head_oid"))
    return versions.join(h, "path", "left").where(~F.col("oid").eqNullSafe(F.col("head_oid"))).withColumn("removed", F.col("head_oid").isNull())


def run_status(findings: DataFrame, incomplete: DataFrame) -> DataFrame:
    """incomplete before policy_failure before completed_with_warnings before completed."""
    f = findings.agg(F.coalesce(F.bool_or(F.col("severity") == "error"), F.lit(False)).alias("failed"), F.count("*").alias("findings"))
    i = incomplete.agg(F.count("*").alias("incomplete"))
    status = F.when(F.col("incomplete") > 0, "incomplete").when(F.col("failed"), "policy_failure").when(F.col("findings") > 0, "completed_with_warnings").otherwise("completed")
    code = F.when(F.col("incomplete") > 0, 1).when(F.col("failed"), 2).otherwise(0)
    return f.join(i).select(status.alias("status"), code.alias("exit_code"), "findings", "incomplete")  # one row each


def reconcile(requested: DataFrame, reviews: DataFrame, verdicts: list[str] = ("confirmed", "false_positive", "uncertain")) -> DataFrame:
    """Violations of the one-to-one match of findings (index, identity) with reviews (index, identity, verdict)."""
    seen = reviews.groupBy("index").agg(F.count("*").alias("n"), F.first("identity").alias("given"), F.first("verdict").alias("verdict"))
    j = requested.join(seen, "index", "full_outer")
    what = F.when(F.col("n").isNull(), "missing").when(F.col("identity").isNull(), "unknown").when(F.col("n") > 1, "repeated").when(F.col("identity") != F.col("given"), "identity").when(~F.coalesce(F.col("verdict").isin(list(verdicts)), F.lit(False)), "verdict")
    return j.select("index", what.alias("violation")).where("violation is not null")


def verdict_counts(reviews: DataFrame) -> DataFrame:
    """All three verdicts, with their numbers."""
    domain = reviews.sparkSession.createDataFrame([("confirmed",), ("false_positive",), ("uncertain",)], "verdict string")
    return domain.join(reviews.groupBy("verdict").agg(F.count("*").alias("n")), "verdict", "left").select("verdict", F.coalesce("n", F.lit(0)).alias("reviews"))


def disposition(counts: DataFrame, scan_complete: bool, excluded: int, limitations: int) -> DataFrame:
    act = F.coalesce(F.sum(F.when(F.col("verdict").isin("confirmed", "uncertain"), F.col("reviews"))), F.lit(0))
    done = scan_complete and not excluded and not limitations
    return counts.agg(act.alias("open")).select(F.lit("complete" if done else "incomplete").alias("status"), F.when(F.col("open") > 0, "action_required").otherwise("no_action").alias("disposition"))


def reviewed(found: DataFrame, reviews: DataFrame, additional: DataFrame | None = None) -> DataFrame:
    """Findings with their verdicts where they have one, and additional ones behind them."""
    r = reviews.select("index", F.col("verdict").alias("judgment_new"))
    out = found.join(r, "index", "left").withColumn("judgment", F.coalesce("judgment_new", "judgment")).drop("judgment_new")
    return out if additional is None else out.unionByName(additional, allowMissingColumns=True)


def ledger(history: DataFrame, run: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(history with the run, newest first; conflicts: runs of a known id with other content)."""
    known = history.select("id", F.col("content").alias("was"))
    conflicts = run.join(known, "id").where(~F.col("content").eqNullSafe(F.col("was"))).select("id")
    new = run.join(known.select("id"), "id", "left_anti")
    return history.unionByName(new).orderBy(F.col("finished_at").desc(), F.col("id").desc()), conflicts


def duplicates(df: DataFrame, *cols: str) -> DataFrame:
    """Keys that aren't unique."""
    return df.groupBy(*cols).count().where("count > 1")


def unrepeated(policy: DataFrame, blobs: DataFrame) -> DataFrame:
    """Policy findings that the blob scan doesn't already have at the same (file, commit, rule, line); commits may be null."""
    on = [policy[c].eqNullSafe(blobs[c]) for c in ("file", "commit", "rule", "line")]
    return policy.join(blobs, on, "left_anti")


def report_totals(runs: DataFrame) -> DataFrame:
    """Totals over runs (id, repository, finished_at, findings)."""
    return runs.agg(F.countDistinct("repository").alias("repositories"), F.count("*").alias("runs"), F.max("finished_at").alias("latest"), F.coalesce(F.sum("findings"), F.lit(0)).alias("findings"))


def rule_sets(findings: DataFrame, evaluated: DataFrame, catalog: DataFrame) -> DataFrame:
    """Every rule of a run once: whether it was evaluated, has an error (blocks), and its findings.

    findings: rule, severity; evaluated and catalog: rule. The rules of a run are all three together.
    """
    per = findings.groupBy("rule").agg(F.count("*").alias("findings"), F.bool_or(F.col("severity") == "error").alias("blocking"))
    rules = catalog.select("rule").union(evaluated.select("rule")).union(findings.select("rule")).distinct()
    seen = evaluated.select("rule").distinct().withColumn("evaluated", F.lit(True))
    none = F.lit(False)
    return rules.join(seen, "rule", "left").join(per, "rule", "left").select("rule", F.coalesce("evaluated", none).alias("evaluated"), F.coalesce("blocking", none).alias("blocking"), F.coalesce("findings", F.lit(0)).alias("findings"))


def governance_status(status: DataFrame, governance: DataFrame) -> DataFrame:
    """A run's status (one row) after governance findings (detail): unverified makes it incomplete, others raise completed to warnings."""
    g = governance.agg(F.coalesce(F.bool_or(F.col("detail") == "unverified"), F.lit(False)).alias("unverified"), F.count("*").alias("governance"))
    folded = F.when(F.col("unverified"), "incomplete").when((F.col("governance") > 0) & (F.col("status") == "completed"), "completed_with_warnings").otherwise(F.col("status"))
    return status.join(g).select(folded.alias("status"), "governance")  # one row each


def is_relative(path: Column) -> Column:
    """Whether a path stays inside its repository: not absolute, no backslash, no empty part, no dots alone."""
    return F.coalesce((path != "") & ~path.contains("\\") & ~F.exists(F.split(path, "/", -1), lambda p: p.isin("", ".", "..")), F.lit(False))


def is_text(value: Column) -> Column:
    """Whether a receipt's text says something and holds no control characters but tabs and line ends."""
    return F.coalesce((F.trim(F.regexp_replace(value, "\\s+", " ")) != "") & ~value.rlike("[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]"), F.lit(False))


def identity_violations(findings: DataFrame) -> DataFrame:
    """The first breach of each finding's identity: index, violation. findings: index, file, rule, start, end, line, end_line, commit, matched, context, provenance_commit."""
    positive = lambda c, least: F.col(c).isNotNull() & (F.col(c) < least)
    literal = F.col("matched").isNotNull() & ~F.coalesce((F.col("end") - F.col("start") == F.length("matched")) & F.col("context").contains(F.col("matched")), F.lit(False))
    what = (
        F.when(F.coalesce(F.col("rule"), F.lit("")) == "", "no rule")
        .when(positive("line", 1) | positive("end_line", 1) | positive("start", 0) | positive("end", 0), "location")
        .when(literal, "literal evidence")
        .when(~F.col("provenance_commit").eqNullSafe(F.col("commit")), "other version")
        .when(F.col("end") < F.col("start"), "span")
        .when(F.col("end_line") < F.col("line"), "line range")
        .when(~is_relative(F.col("file")), "path")
    )
    return findings.select("index", what.alias("violation")).where("violation is not null")


def review_tasks(fixed: DataFrame, topics: DataFrame, profile: DataFrame) -> DataFrame:
    """The union of review tasks (id, title, prompt): fixed ones, detector topics, and one for each of a profile's requirements (repository, index, prompt)."""
    key = F.regexp_replace(F.regexp_replace("repository", "[^A-Za-z0-9._-]+", "-"), "^[-.]+|[-.]+\\z", "")
    own = profile.select(F.concat(F.lit("profile:"), key, F.lit(":"), F.col("index").cast("string")).alias("id"), F.concat(F.lit("Repository review requirement "), (F.col("index") + 1).cast("string")).alias("title"), "prompt")
    return fixed.select("id", "title", "prompt").union(topics.select("id", "title", "prompt")).union(own)


def task_violations(tasks: DataFrame, reviews: DataFrame) -> DataFrame:
    """id and violation: tasks that repeat, lack a review or have several, reviews of no task, and reviews without conclusion or evidence."""
    t = tasks.groupBy("id").agg(F.count("*").alias("tasks"))
    r = reviews.groupBy("id").agg(F.count("*").alias("reviews"), F.bool_and(is_text(F.col("conclusion")) & is_text(F.col("evidence"))).alias("said"))
    what = F.when(F.col("tasks").isNull(), "unknown").when(F.col("tasks") > 1, "task repeats").when(F.col("reviews").isNull(), "missing").when(F.col("reviews") > 1, "repeated").when(~F.col("said"), "text")
    return t.join(r, "id", "full_outer").select("id", what.alias("violation")).where("violation is not null")


def manifest_violations(files: DataFrame, commits: DataFrame, scope: str) -> DataFrame:
    """path and violation of review files (path, commits array, inspected, excluded) against the scan's commits (commit)."""
    known = commits.agg(F.collect_set("commit").alias("known"))  # the commits of one run
    outside = F.size(F.array_except("commits", "known")) > 0
    empty = (F.size("commits") == 0) & F.lit(scope not in ("staged", "worktree"))
    repeats = files.groupBy("path").agg(F.count("*").alias("times"))
    what = F.when(~is_relative(F.col("path")), "path").when(F.col("times") > 1, "path repeats").when(empty | outside, "commits").when(F.size(F.array_distinct("commits")) < F.size("commits"), "commit repeats").when(F.least("inspected", "excluded") < 0, "states").when(F.col("inspected") + F.col("excluded") == 0, "no version")
    return files.join(repeats, "path").join(F.broadcast(known)).select("path", what.alias("violation")).where("violation is not null")  # one row


def additional_violations(additional: DataFrame, commits: DataFrame, scope: str, verdicts: list[str] = ("confirmed", "false_positive", "uncertain")) -> DataFrame:
    """index and violation of a receipt's additional findings (index, path, line, commit, verdict, category, rule, basis, impact, action)."""
    known = commits.select("commit").distinct().withColumn("known", F.lit(True))
    said = F.array_min(F.array(*(is_text(F.col(c)) for c in ("category", "rule", "basis", "impact", "action"))))
    what = (
        F.when(~is_relative(F.col("path")), "path")
        .when(~F.coalesce(F.col("line") >= 1, F.lit(False)), "line")
        .when(F.trim("commit") == "", "commit")
        .when(~F.coalesce(F.col("verdict").isin(list(verdicts)), F.lit(False)), "verdict")
        .when(~said, "text")
        .when(F.col("commit").isNull() & F.lit(scope not in ("staged", "worktree")), "no commit")
        .when(F.col("commit").isNotNull() & F.col("known").isNull(), "commit outside")
    )
    return additional.join(known, "commit", "left").select("index", what.alias("violation")).where("violation is not null")
