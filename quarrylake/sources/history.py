"""Version histories as concepts. Commits are rows (hash, parents, author_name, author_email, at, message, ord), ord rising from the
latest; changes are rows (commit, path, change), as harvest.tree_diff gives them. Texts are fixed values: they are the expected output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrylake.functions import filled, short_hash, trim_space
from quarrylake.model import as_concepts
from quarrylake.sources.harvest import contributor_stats, recent_commits, repo_summary

RECENT = 15
LISTED = 30
# What `git log --format=` is to be given for read_log, and what separates fields and commits there.
LOG_FORMAT = "%H%x1f%P%x1f%an%x1f%ae%x1f%aI%x1f%B%x1e"
FIELD, RECORD = "\x1f", "\x1e"


def _stamp(at: Column | str) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ssXXX")


def _concept(df: DataFrame, ident: Column, **columns: Column) -> DataFrame:
    return as_concepts(df, id=ident, path=F.concat(ident, F.lit(".md")), **columns)


def repository_concept(commits: DataFrame, branch: str, remotes: list[str] | None = None, now: Column | None = None) -> DataFrame:
    """One row: the history's sums."""
    short = short_hash("last_commit")
    last = F.when(F.col("last_commit").isNull(), F.lit("")).otherwise(F.concat(F.lit("* **Last Commit**: ["), short, F.lit("](commits/"), short, F.lit(".md)\n")))
    origin = F.lit(f"* **Remote Origin**: {', '.join(remotes)}\n" if remotes else "")
    body = F.concat(F.lit("# Git Repository Summary\n\n"), origin, F.lit(f"* **Active Branch**: `{branch}`\n* **Total Commits**: "), F.col("total_commits").cast("string"), F.lit("\n* **Total Contributors**: "), F.col("contributors").cast("string"), F.lit("\n"), last)
    extra = F.create_map(F.lit("branch"), F.lit(branch), F.lit("total_commits"), F.col("total_commits").cast("string"), F.lit("total_contributors"), F.col("contributors").cast("string"), F.lit("last_commit"), filled("last_commit"))
    return _concept(repo_summary(commits), F.lit("git/repository"), type=F.lit("Git Repository"), title=F.lit("Git Repository"), description=F.lit("Summary statistics of the git repository status and history."), timestamp=F.lit(None) if now is None else _stamp(now), extra=extra, body=body)


def file_list(changes: DataFrame, most: int = LISTED) -> DataFrame:
    """(commit, files): the first `most` changed files of each commit by path, one line each, and how many more there are. Ranks and
    counts run by commit and file, so no commit's files meet in one row but those listed."""
    ranked = changes.withColumn("rank", F.row_number().over(Window.partitionBy("commit").orderBy("path"))).where(F.col("rank") <= most)
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.concat(F.lit("- **"), "change", F.lit("**: `"), "path", F.lit("`\n")).alias("line")))), lambda x: x["line"]), "")
    shown, n = ranked.groupBy("commit").agg(lines.alias("files")), changes.groupBy("commit").agg(F.count("*").alias("n"))
    more = F.when(F.col("n") > most, F.concat(F.lit("\n... and "), (F.col("n") - most).cast("string"), F.lit(" more files."))).otherwise(F.lit(""))
    return shown.join(n, "commit").select("commit", F.concat("files", more).alias("files"))


def commit_concepts(commits: DataFrame, changes: DataFrame, n: int = RECENT) -> DataFrame:
    """The latest n commits; n is a small number of rows."""
    latest = commits.orderBy("ord").limit(n)
    files = file_list(changes.join(F.broadcast(latest.select(F.col("hash").alias("commit"))), "commit", "left_semi"))
    c = latest.join(files, F.col("hash") == F.col("commit"), "left").withColumn("short", short_hash("hash"))
    parents = F.array_join(F.transform(F.coalesce("parents", F.array().cast("array<string>")), lambda p: F.concat(F.lit("- ["), short_hash(p), F.lit("]("), short_hash(p), F.lit(".md)\n"))), "")
    body = F.concat(
        F.lit("# Commit "), "hash", F.lit("\n\n* **Author**: "), filled("author_name"), F.lit(" (<"), filled("author_email"), F.lit(">)\n* **Date**: "), _stamp("at"), F.lit("\n\n## Message\n\n```\n"), trim_space(filled("message")), F.lit("\n```\n\n"),
        F.when(parents != "", F.concat(F.lit("## Parents\n"), parents, F.lit("\n"))).otherwise(F.lit("")), F.lit("## File Diffs\n\n"), F.coalesce("files", F.lit("*No file changes detected (possibly a merge commit).*")),
    )
    extra = F.create_map(F.lit("hash"), F.col("hash"), F.lit("author_name"), filled("author_name"), F.lit("author_email"), filled("author_email"), F.lit("parents"), F.to_json(F.coalesce("parents", F.array().cast("array<string>"))))
    about = F.concat(F.lit("Git commit hash "), "short", F.lit(" by "), filled("author_name"), F.lit("."))
    return _concept(c, F.concat(F.lit("git/commits/"), "short"), type=F.lit("Git Commit"), title=F.concat(F.lit("Commit: "), "short"), description=about, timestamp=_stamp("at"), extra=extra, body=body)


def contributor_concepts(commits: DataFrame, now: Column | None = None) -> DataFrame:
    """One row for each address."""
    s = contributor_stats(commits).withColumns({"first": _stamp("first_at"), "last": _stamp("last_at"), "n": F.col("commits").cast("string")})
    body = F.concat(F.lit("# Contributor Profile: "), filled("name"), F.lit("\n\n* **Email Address**: "), "email", F.lit("\n* **Total Commits**: "), "n", F.lit("\n* **First Contribution**: "), "first", F.lit("\n* **Latest Contribution**: "), "last", F.lit("\n"))
    extra = F.create_map(F.lit("commits"), F.col("n"), F.lit("first_commit"), F.col("first"), F.lit("last_commit"), F.col("last"), F.lit("email"), F.col("email"))
    title, about = F.concat(F.lit("Contributor: "), filled("name")), F.concat(F.lit("Contributor metrics for "), filled("name"), F.lit(" in this project."))
    return _concept(s, F.concat(F.lit("git/contributors/"), "slug"), type=F.lit("Git Contributor"), title=title, description=about, timestamp=F.lit(None) if now is None else _stamp(now), extra=extra, body=body)


def history_concepts(commits: DataFrame, changes: DataFrame, branch: str, remotes: list[str] | None = None, now: Column | None = None) -> DataFrame:
    return repository_concept(commits, branch, remotes, now).unionByName(commit_concepts(commits, changes)).unionByName(contributor_concepts(commits, now))


def log_record() -> Column:
    """A commit as LOG_FORMAT writes it, without the record's end."""
    return F.concat_ws(FIELD, "hash", F.array_join("parents", " "), "author_name", "author_email", _stamp("at"), "message")


def parse_log(records: DataFrame, order: str) -> DataFrame:
    """Commits of records(value, <order>); records without a hash are left out."""
    f = F.split(F.regexp_replace("value", "^[\\r\\n]+", ""), FIELD, 6)
    got = records.select(f.alias("f"), F.col(order).alias("ord")).where(F.get("f", F.lit(0)) != "")
    at = F.try_to_timestamp(F.get("f", F.lit(4)), F.lit("yyyy-MM-dd'T'HH:mm:ssXXX"))
    return got.select(F.get("f", F.lit(0)).alias("hash"), F.filter(F.split(F.get("f", F.lit(1)), " "), lambda x: x != "").alias("parents"), F.get("f", F.lit(2)).alias("author_name"), F.get("f", F.lit(3)).alias("author_email"), at.alias("at"), trim_space(F.get("f", F.lit(5))).alias("message"), "ord")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Commits of a log file written with LOG_FORMAT, in the order of the file, by Spark's text source."""
    return parse_log(spark.read.option("lineSep", RECORD).text(path).withColumn("at_line", F.monotonically_increasing_id()), "at_line")
