"""Compaction of command output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IMPORTANT = r"(?i)\b(error|failed|failure|panic|warning|exception)\b"


def important_lines(lines: Column, most: int = 40, fallback: int = 40) -> Column:
    hits = F.slice(F.filter(lines, lambda x: x.rlike(IMPORTANT)), 1, most)
    return F.when(F.size(hits) == 0, F.slice(lines, 1, fallback)).otherwise(hits)


def log_summary(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Lines, blank lines, important lines and an estimate of what compaction saves (a quarter of the bytes)."""
    t = F.coalesce(F.col(text), F.lit(""))
    out = rows.select(key, t.alias("t"), F.split(t, "\n").alias("lines"))
    short = F.array_join(important_lines(F.col("lines")), "\n")
    saved = F.floor((F.octet_length("t") - F.octet_length(short)) / 4).cast("bigint")
    blank = F.size(F.filter("lines", lambda x: F.trim(x) == "")).cast("bigint")
    return out.select(key, F.size("lines").cast("bigint").alias("n_lines"), blank.alias("n_blank"), F.md5(short).alias("summary"), saved.alias("saved_tokens"))


def budget_prefix(rows: DataFrame, key: str, text: str, budget: int) -> DataFrame:
    """The lines before the first that would pass the budget of bytes (less 80 for a note): counts and the kept text's digest."""
    zero = F.struct(F.lit(0).cast("bigint").alias("used"), F.lit(False).alias("full"), F.array().cast("array<string>").alias("kept"))

    def step(a, x):
        used = a["used"] + F.octet_length(x) + 1
        stop = a["full"] | (used > budget - 80)
        return F.when(stop, F.struct(a["used"].alias("used"), F.lit(True).alias("full"), a["kept"].alias("kept"))).otherwise(
            F.struct(used.alias("used"), F.lit(False).alias("full"), F.array_append(a["kept"], x).alias("kept"))
        )

    out = rows.select(key, F.aggregate(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), zero, step).alias("r"))
    return out.select(key, F.size("r.kept").cast("bigint").alias("n_kept"), F.col("r.full").alias("truncated"), F.col("r.used").alias("used"), F.md5(F.array_join("r.kept", "\n")).alias("kept"))


#: Parts of file-like lines, and the most files, snippets and findings that a summary shows.
FILE_LIKE = r"[/\\\\]|\.rs|\.ts|\.js|\.md|^modified:|^new file:|^deleted:"
MOST_FILES, MOST_SNIPPETS, MOST_FINDINGS = 20, 40, 20


def output_lines(stderr: Column, stdout: Column) -> Column:
    """Lines that are not blank, errors first, without blanks at their ends."""
    both = F.concat(*(F.split(F.coalesce(x, F.lit("")), r"\r?\n") for x in (stderr, stdout)))
    return F.filter(F.transform(both, lambda x: F.regexp_replace(x, r"\s+$", "")), lambda x: x != "")


def _count(lines: Column, test) -> Column:
    return F.size(F.filter(lines, test)).cast("bigint")


def _shown(lines: Column, test, most: int) -> Column:
    return F.array_join(F.slice(F.filter(lines, test), 1, most), "\n")


def status_sections(lines: Column) -> Column:
    """branch and the numbers of staged, unstaged, untracked and conflicting file lines of a status listing; a heading opens a section."""
    names = ["staged", "unstaged", "untracked", "conflicts"]
    zero = F.struct(F.lit("").alias("section"), *(F.lit(0).cast("bigint").alias(n) for n in names))

    def step(a, x):
        t = F.trim(x)
        opened = (
            F.when(t.contains("Changes to be committed"), "staged").when(t.contains("Changes not staged"), "unstaged").when(t.contains("Untracked files"), "untracked")
            .when(t.contains("Unmerged paths") | t.contains("both modified"), "conflicts")
        )
        hit = lambda n: F.when(opened.isNull() & t.rlike(FILE_LIKE) & (a["section"] == n), 1).otherwise(0)
        return F.struct(F.coalesce(opened, a["section"]).alias("section"), *((a[n] + hit(n)).cast("bigint").alias(n) for n in names))

    branch = F.coalesce(F.get(F.filter(lines, lambda x: x.startswith("On branch ") | x.startswith("## ")), F.lit(0)), F.lit("branch: unknown"))
    return F.struct(branch.alias("branch"), F.aggregate(lines, zero, step).alias("counts"))


def diff_counts(lines: Column) -> Column:
    """files (headings of any sort, each once), hunks, added, deleted and binary lines of a diff, and its first changed lines."""
    head = lambda x: x.startswith("diff --git ") | x.startswith("+++ ") | x.startswith("--- ")
    plus, minus = (lambda x: x.startswith("+") & ~x.startswith("+++")), (lambda x: x.startswith("-") & ~x.startswith("---"))
    files = F.array_distinct(F.transform(F.filter(lines, head), lambda x: F.regexp_replace(x, "^diff --git ", "")))
    return F.struct(
        F.size(files).cast("bigint").alias("files"), _count(lines, lambda x: x.startswith("@@")).alias("hunks"), _count(lines, plus).alias("added"), _count(lines, minus).alias("deleted"),
        _count(lines, lambda x: x.startswith("Binary files")).alias("binary"), _shown(lines, lambda x: plus(x) | minus(x), MOST_SNIPPETS).alias("snippets"),
    )


def build_counts(lines: Column) -> Column:
    """errors, warnings (that are no errors), failed tests and summary lines of a build or test run, each at most MOST_SNIPPETS."""
    has = lambda p: (lambda x: F.lower(x).rlike(p))
    error = "error|failed|exception|panic"
    capped = lambda test: F.least(_count(lines, test), F.lit(MOST_SNIPPETS)).cast("bigint")
    return F.struct(
        capped(has(error)).alias("errors"), capped(lambda x: has("warning")(x) & ~has(error)(x)).alias("warnings"), capped(lambda x: has("test")(x) & has("failed|failures")(x)).alias("failures"),
        capped(has("test result:|build failed|build succeeded|compilation complete|found ")).alias("summaries"),
    )


def docker_counts(lines: Column) -> Column:
    """services (at most MOST_FILES) and issues (at most MOST_SNIPPETS) of a container tool's output."""
    has = lambda p: (lambda x: F.lower(x).rlike(p))
    services = F.least(_count(lines, has(r"container|service|0\.0\.0\.0:|127\.0\.0\.1:")), F.lit(MOST_FILES))
    return F.struct(services.cast("bigint").alias("services"), F.least(_count(lines, has("unhealthy|exited|error|failed")), F.lit(MOST_SNIPPETS)).cast("bigint").alias("issues"))


def search_counts(lines: Column) -> Column:
    """matches and distinct files of a search: what stands before a line's first colon."""
    before = F.filter(F.transform(F.filter(lines, lambda x: x.contains(":")), lambda x: F.substring_index(x, ":", 1)), lambda f: F.trim(f) != "")
    return F.struct(F.size(lines).cast("bigint").alias("matches"), F.size(F.array_distinct(before)).cast("bigint").alias("files"))


def preview_counts(lines: Column) -> Column:
    return F.struct(F.size(lines).cast("bigint").alias("lines"), _count(lines, lambda x: x.rlike(r"[/\\\\]$")).alias("folders"))


def key_findings(lines: Column, exit_code: Column) -> Column:
    """The first findings: an exit code that is not 0, then lines that name errors, failures, warnings or conflicts."""
    code = F.when(F.coalesce(exit_code, F.lit(0)) != 0, F.array(F.concat(F.lit("non-zero exit code: "), exit_code.cast("string")))).otherwise(F.array().cast("array<string>"))
    return F.slice(F.concat(code, F.filter(lines, lambda x: F.lower(x).rlike("error|failed|warning|conflict"))), 1, MOST_FINDINGS)
