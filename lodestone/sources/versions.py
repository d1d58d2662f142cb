"""Sources: files as rows. Versions of texts come from a table, a folder of files, or a Git history's exported rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Commits of a synthesized history, in order.
COMMITS = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def versions(documents: DataFrame, commits: int = COMMITS) -> DataFrame:
    """Documents as versions of files: one path per language, one commit per residue of the id.

    Columns: doc_id, repository, commit, seq, path, mode, kind, oid (sha-256 of the text), size (bytes), text.
    """
    seq = F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(commits)).cast("int")
    return documents.select(
        "doc_id",
        F.coalesce("source", F.lit("none")).alias("repository"),
        F.concat(F.lit("c"), seq.cast("string")).alias("commit"),
        seq.alias("seq"),
        F.concat(F.lit("documents/"), F.coalesce("lang", F.lit("none")), F.lit(".txt")).alias("path"),
        F.lit("100644").alias("mode"),
        F.lit("blob").alias("kind"),
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("oid"),
        F.octet_length("text").cast("long").alias("size"),
        "text",
    )


def pages_as_versions(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("page_id").alias("doc_id"), F.lit("web").alias("repository"), F.lit("c0").alias("commit"), F.lit(0).alias("seq"), F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.lit("100644").alias("mode"), F.lit("blob").alias("kind"), F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256).alias("oid"), F.octet_length("html").cast("long").alias("size"), F.col("html").alias("text"))


def files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """A folder's files as uncommitted versions (commit and oid are null), with their bytes as content."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    base = root.rstrip("/") + "/"
    path = F.regexp_replace(F.col("path"), "^[a-z]+:/*(?=/)", "")
    rel = F.when(path.startswith(base), F.substring(path, F.lit(len(base) + 1), F.length(path))).otherwise(path)
    none = F.lit(None).cast("string")
    return raw.select(none.alias("commit"), F.lit(0).alias("seq"), rel.alias("path"), F.lit("100644").alias("mode"), F.lit("blob").alias("kind"), none.alias("oid"), F.col("length").alias("size"), "content")


def exclusion(content: Column, kind: Column, mode: Column) -> Column:
    """Why a version isn't text, the first reason that holds; null if it is."""
    bad = F.try_validate_utf8(content.cast("string")).isNull() | content.cast("string").contains("\x00")
    return (
        F.when(kind != "blob", "submodule")
        .when(mode == "120000", "symlink")
        .when(content.isNotNull() & bad, "non-UTF-8 or binary")
        .when(content.cast("string").startswith("version https://git-lfs.github.com/spec/v1"), "LFS pointer")
    )


def admissible(df: DataFrame) -> DataFrame:
    """Adds reason, and text where there is none; df has content (binary), kind and mode."""
    out = df.withColumn("reason", exclusion(F.col("content"), F.col("kind"), F.col("mode")))
    return out.withColumn("text", F.when(F.col("reason").isNull(), F.col("content").cast("string")))


def changed(commits: DataFrame, versions_: DataFrame, changed_paths: DataFrame) -> DataFrame:
    """A range scan: versions of the range's commits whose path changed against the first parent; all of a root commit's."""
    roots = commits.where(F.col("parent").isNull()).select("commit")
    rest = commits.where(F.col("parent").isNotNull()).select("commit")
    some = versions_.join(changed_paths.select("commit", "path").distinct(), ["commit", "path"], "left_semi").join(rest, "commit", "left_semi")
    return some.unionByName(versions_.join(roots, "commit", "left_semi"))


def branches(refs: DataFrame) -> DataFrame:
    """Distinct branch names, remote ones under the same name, HEAD left out, sorted."""
    name = F.regexp_replace("ref", "^refs/remotes/[^/]+/", "refs/heads/")
    return refs.select(name.alias("ref")).where(~F.col("ref").endswith("/HEAD")).distinct().orderBy("ref")


TRAILER = "(?im)^(?:co-authored-by|signed-off-by|authored-by|committed-by|generated-by|assisted-by|made-with)\\s*:[^\\r\\n]*"


def commit_meta(raw: DataFrame) -> DataFrame:
    """commit, author, committer and trailers from the text of commit objects (commit, text)."""
    line = lambda k: F.regexp_extract("text", f"(?dm)^{k} (.*)$", 1)
    return raw.select("commit", line("author").alias("author"), line("committer").alias("committer"), F.regexp_extract_all("text", F.lit(TRAILER), 0).alias("trailers"))
