"""Line-first document cleaning with built-in column functions only.

Each \\n-separated line that holds a word is judged by three families of rules:

* punctuation: a short line (under ``min_open_words`` words) without a closing
  mark, or a line where over ``max_symbol_words`` of the words carry one of
  ``# * $ % & | < >``;
* navigation: a line cut by menu separators into segments of few words;
* boilerplate: a short line with a stock phrase (cookie notices, log-in
  prompts, rights statements).

Failing lines go. A document is rejected if it then lost over ``max_lost`` of
its line characters, or if it failed the base counts (too few words, or mostly
repeated three-word windows). All work happens within a row, so nothing is
shuffled and no key can be hot.

Edge cases: a null or empty text has no words and is rejected (base_failed);
its cleaned text is the empty string. Repeated rows are judged alike. Extra
columns are carried through; clashing names of the result columns are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import SPACE_CLASS, SPACES, let

SYMBOLS = "#*$%&|<>"
CLOSING = r"""[.!?:;…。！？]["'”’»)\]]*[\x20\x09-\x0D]*$"""
BOILERPLATE = (
    r"(?i)\b(?:cookies?|javascript|lorem ipsum|all rights reserved|privacy policy|terms of (?:use|service)"
    r"|sign (?:in|up)|log ?in|subscribe|newsletter|click here|read more|copyright|©)"
)
MENU = r"[|»›•·]"


def words_of(text: Column) -> Column:
    """Runs of characters other than ASCII white space."""
    return F.filter(F.split(text, SPACE_CLASS), lambda w: w != "")


def repeat_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more (first included).

    Windows are sorted with their positions; equal neighbours are repeats. The
    covered words are summed over the sorted positions: min(3, gap to the next).
    """

    def covered(p: Column) -> Column:
        last = F.size(p) - 1
        step = lambda a, k: a + F.when(k == last, F.lit(3)).otherwise(F.least(F.lit(3), p[k + 1] - p[k]))
        return F.when(F.size(p) == 0, F.lit(0)).otherwise(F.aggregate(F.sequence(F.lit(0), last), F.lit(0), step))

    def repeated(s: Column) -> Column:
        last = F.size(s) - 1
        same = lambda k: ((k > 0) & (s[F.greatest(k - 1, F.lit(0))]["g"] == s[k]["g"])) | ((k < last) & (s[F.least(k + 1, last)]["g"] == s[k]["g"]))
        at = F.sort_array(F.transform(F.filter(F.sequence(F.lit(0), last), same), lambda k: s[k]["i"]))
        return let(at, covered)

    def windows(w: Column) -> Column:
        grams = F.transform(
            F.sequence(F.lit(0), F.size(w) - 3),
            lambda i: F.struct(F.concat_ws(" ", w[i], w[i + 1], w[i + 2]).alias("g"), i.alias("i")),
        )
        return F.when(F.size(w) < 4, F.lit(0)).otherwise(let(F.sort_array(grams), repeated))

    return let(words, windows).cast("long")


def line_fails(line: Column, min_open_words: int, max_symbol_words: float) -> Column:
    def judged(w: Column) -> Column:
        n = F.size(w)
        symbols = F.size(F.filter(w, lambda x: F.translate(x, SYMBOLS, "") != x))
        open_line = (n < min_open_words) & ~line.rlike(CLOSING)
        marks = F.size(F.split(line, MENU)) - 1
        menu = (marks >= 2) & (n <= 8 * (marks + 1))
        stock = (n <= 20) & line.rlike(BOILERPLATE)
        return open_line | (symbols > max_symbol_words * n) | menu | stock

    return let(words_of(line), judged)


def clean_documents(
    docs: DataFrame,
    text: str = "text",
    max_lost: float = 0.5,
    min_open_words: int = 5,
    max_symbol_words: float = 0.3,
    min_words: int = 50,
    max_repeat_percent: int = 50,
) -> DataFrame:
    """docs with the counts, base_failed, kept, lost_share and clean_text."""
    t = F.coalesce(F.col(text), F.lit(""))
    holds_word = lambda line: F.translate(line, SPACES, "") != ""
    judged = F.transform(F.split(t, "\n"), lambda x: F.struct(x.alias("line"), (holds_word(x) & line_fails(x, min_open_words, max_symbol_words)).alias("bad")))
    lines = F.filter(F.split(t, "\n"), holds_word)
    out = docs.withColumns(
        {
            "_judged": judged,
            "n_words": F.size(words_of(t)).cast("long"),
            "word_chars": F.length(F.translate(t, SPACES, "")).cast("long"),
            "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
            "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
            "n_repeat_words": repeat_words(words_of(t)),
        }
    )
    size = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + F.length(x["line"]))
    lost = let(F.col("_judged"), lambda x: size(F.filter(x, lambda y: y["bad"])) / F.greatest(size(x), F.lit(1)))
    out = out.withColumns(
        {
            "lost_share": lost,
            "clean_text": F.array_join(F.transform(F.filter("_judged", lambda x: ~x["bad"]), lambda x: x["line"]), "\n"),
            "base_failed": (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words")),
        }
    )
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("lost_share") <= max_lost)).drop("_judged")


def quality_stage(docs: DataFrame) -> DataFrame:
    """Keep the documents that pass, with their failing lines removed; the input's columns, whatever their names."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "text")
    kept = clean_documents(rows).filter("kept")
    row = F.col("row").withField("text", F.col("clean_text"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.length("clean_text").cast(docs.schema["n_chars"].dataType))
    return kept.select(row.alias("row")).select("row.*")
