"""Version-control tables: status, counts of changed lines, freshness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.keys import change_status


def parse_porcelain(text: DataFrame, column: str) -> DataFrame:
    """path, old_path, status, staged, unstaged of status entries: two letters, a space and a path, NUL-separated; a rename's old path follows its entry.

    Each row is a listing of its own, read from its start within the row. Files in
    conflict and untracked ones are neither staged nor unstaged. Null and empty
    listings have no entries.
    """
    out = "array<struct<e:string,old:string>>"
    zero = F.struct(F.array().cast(out).alias("out"), F.lit(None).cast("string").alias("open"))

    def step(a, e):
        moved = F.substring(e, 1, 1).isin("R", "C") | F.substring(e, 2, 1).isin("R", "C")
        one = lambda entry, old: F.array_append(a["out"], F.struct(entry.alias("e"), old.alias("old")))
        none = F.lit(None).cast("string")
        return (
            F.when(a["open"].isNotNull(), F.struct(one(a["open"], e).alias("out"), none.alias("open")))
            .when(F.length(e) < 4, a).when(moved, F.struct(a["out"].alias("out"), e.alias("open"))).otherwise(F.struct(one(e, none).alias("out"), none.alias("open")))
        )

    entries = F.aggregate(F.split(F.coalesce(column, F.lit("")), "\0"), zero, step, lambda a: a["out"])
    rows = text.select(F.explode(entries).alias("x")).select("x.e", "x.old")
    x, y, status = F.substring("e", 1, 1), F.substring("e", 2, 1), F.col("status")
    plain = ~status.isin("conflicted", "untracked")
    rows = rows.withColumn("status", change_status(x, y))
    return rows.select(F.expr("substring(e, 4)").alias("path"), F.col("old").alias("old_path"), "status", (plain & (x != " ")).alias("staged"), (plain & (y != " ")).alias("unstaged"))


def diff_summary(changes: DataFrame) -> DataFrame:
    """One row of counts by status, with line totals; untracked files count as added too."""
    n = lambda c: F.count_if(c)
    s = F.col("status")
    names = ["conflicted", "modified", "deleted", "renamed", "copied", "untracked"]
    return changes.agg(
        F.count("*").alias("files"), n(F.col("staged")).alias("staged"), n(F.col("unstaged")).alias("unstaged"), *(n(s == x).alias(x) for x in names),
        n(s.isin("added", "untracked")).alias("added"), F.coalesce(F.sum("added"), F.lit(0)).alias("lines_added"), F.coalesce(F.sum("deleted"), F.lit(0)).alias("lines_deleted"),
    )


def parse_numstat(lines: DataFrame, column: str) -> DataFrame:
    """path, added, deleted of lines ``added<TAB>deleted<TAB>path``; "-" (a binary file) is null."""
    parts = F.split(column, "\t", 3)
    return lines.select(parts[2].alias("path"), F.expr(f"try_cast(split({column}, '\\t', 3)[0] as bigint)").alias("added"), F.expr(f"try_cast(split({column}, '\\t', 3)[1] as bigint)").alias("deleted"))


def merge_counts(counts: DataFrame) -> DataFrame:
    """Sums by path; null only where all are null."""
    return counts.groupBy("path").agg(F.sum("added").alias("added"), F.sum("deleted").alias("deleted"))


def freshness(rows: DataFrame) -> DataFrame:
    """rows with reasons and the worst status: unsafe, stale, dirty, fresh. Without a snapshot (known is false) an index is stale."""
    tests = {
        "no_snapshot": ~F.col("known"), "branch_changed": F.col("known") & (F.col("branch_now") != F.col("branch_indexed")),
        "commit_changed": F.col("known") & (F.col("commit_now") != F.col("commit_indexed")), "dirty": F.col("dirty"),
    }
    worst = F.when(tests["branch_changed"], "unsafe").when(tests["no_snapshot"] | tests["commit_changed"], "stale").when(tests["dirty"], "dirty").otherwise("fresh")
    return rows.withColumns({"reasons": F.array_compact(F.array(*(F.when(t, k) for k, t in tests.items()))), "status": worst})


def auto_index(rows: DataFrame, most: int = 50, allowed: tuple = ("modified", "added")) -> DataFrame:
    """rows with blocked (reasons in order), manual and permitted: whether an index may be renewed without asking.

    Columns: enabled, is_repo, indexed_repo, branch_now, branch_indexed, commit_now,
    commit_indexed, detached, conflicts, n_changed, warned, listed, truncated, statuses
    (array), dirty. Branches and commits that are both null are the same.
    """
    c = F.col
    unsafe = F.array_sort(F.array_distinct(F.filter(F.coalesce("statuses", F.array().cast("array<string>")), lambda s: ~s.isin(*allowed))))
    alone = {"auto_index_disabled": ~c("enabled"), "git_status_warning": c("warned"), "changed_files_not_listed": ~c("listed") & c("dirty")}
    hand = {
        "no_git_repo": ~c("is_repo"), "indexed_snapshot_not_git": ~c("indexed_repo"), "branch_changed": ~c("branch_now").eqNullSafe(c("branch_indexed")), "commit_changed": ~c("commit_now").eqNullSafe(c("commit_indexed")),
        "detached_head": c("detached"), "conflict_detected": c("conflicts") > 0, "excessive_changed_files": c("n_changed") > most, "truncated_changed_files": c("truncated"),
    }
    order = ["auto_index_disabled", *[k for k in hand if k != "truncated_changed_files"], "git_status_warning", "changed_files_not_listed", "truncated_changed_files"]
    tests = alone | hand
    named = F.concat(F.array_compact(F.array(*(F.when(tests[k], k) for k in order))), F.transform(unsafe, lambda s: F.concat(F.lit("unsafe_change_status:"), s)))
    manual = F.size(unsafe) > 0
    for test in hand.values():
        manual = manual | F.coalesce(test, F.lit(False))
    out = rows.withColumns({"blocked": named, "manual": manual})
    return out.withColumn("permitted", (F.size("blocked") == 0) & c("dirty"))


def compare(base: DataFrame, head: DataFrame) -> DataFrame:
    """path and status (added, deleted, modified) of what differs between two snapshots (path, hash; a path once in each)."""
    a, b = base.select("path", F.col("hash").alias("a"), F.lit(True).alias("in_a")), head.select("path", F.col("hash").alias("b"), F.lit(True).alias("in_b"))
    status = F.when(F.col("in_a").isNull(), "added").when(F.col("in_b").isNull(), "deleted").when(~F.col("a").eqNullSafe(F.col("b")), "modified")
    return a.join(b, "path", "full").select("path", status.alias("status")).filter("status is not null")


def base_ref(given: str | None, branches: DataFrame) -> str | None:
    """The given reference, else main, else master, else none."""
    if given is not None:
        return given
    found = {r.name for r in branches.filter(F.col("name").isin("main", "master")).select("name").distinct().collect()}
    return next((b for b in ("main", "master") if b in found), None)


def branches(rows: DataFrame, column: str) -> DataFrame:
    """name, full_ref, current, detached of branch listings: a line each, the current one marked by an asterisk."""
    lines = rows.select(F.explode(F.split(F.coalesce(F.col(column), F.lit("")), "\n")).alias("line")).filter(F.col("line").rlike(r"\S"))
    name = F.trim(F.regexp_replace(F.trim("line"), r"^(\* )+", ""))
    return lines.select(name.alias("name"), F.concat(F.lit("refs/heads/"), name).alias("full_ref"), F.col("line").startswith("*").alias("current"), (name.contains("HEAD detached") | (name == "HEAD")).alias("detached"))


def latest_snapshot(snapshots: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last snapshot of each key, by a total order; combined before the shuffle."""
    rest = [c for c in snapshots.columns if c not in keys]
    return snapshots.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")


def diff_evidence(changed: DataFrame, views: dict[str, DataFrame], most: int) -> DataFrame:
    """source, id, name, path, line: rows of each view in changed files (path, old_path or null), the first ``most`` of a view by (path, line, name, id)."""
    paths = changed.select(F.explode(F.array_compact(F.array("path", "old_path"))).alias("path")).distinct()
    out = None
    for source, view in views.items():
        rows = view.select(F.lit(source).alias("source"), F.col("id"), "name", "path", "line").join(paths, "path", "left_semi").orderBy("path", "line", "name", "id").limit(most)
        out = rows if out is None else out.unionByName(rows)
    return out
