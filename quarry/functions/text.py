"""Text expressions: tokens, estimates, snippets, chunks. All built-in column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD_CUT = r"[^\p{L}\p{N}]+"
MAX_CHUNK = 2000
HOLDS = r"[^\x20\x09-\x0D]"


def tokenize(text: Column) -> Column:
    """Identifier tokens: letter and digit runs, cut before a capital after a small letter, lower-cased. Null gives none."""
    spaced = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?<=\p{Ll})(?=\p{Lu})", " ")
    return F.filter(F.split(F.lower(spaced), WORD_CUT), lambda t: t != "")


def estimate_tokens(text: Column, least: int = 1) -> Column:
    """A quarter of the bytes, rounded up, at least ``least``."""
    return F.greatest(F.lit(least), F.ceil(F.octet_length(F.coalesce(text, F.lit(""))) / 4)).cast("bigint")


def compact_snippet(text: Column, most: int = 600) -> Column:
    """Trimmed lines without blank ones, cut after ``most`` characters."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.substring(F.array_join(lines, "\n"), 1, most)


def preview(text: Column, words: int = 48, most: int = 240) -> Column:
    """The first words, cut after ``most`` characters."""
    parts = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.substring(F.array_join(F.slice(parts, 1, words), " "), 1, most)


def line_range(text: Column, first: Column, last: Column) -> Column:
    """Lines first to last, counted from 1."""
    return F.array_join(F.slice(F.split(text, "\n"), first, last - first + 1), "\n")


def query_terms(query: str) -> list[str]:
    """Terms of a full-text query: cut at everything but letters, digits and underscores."""
    word = "".join(c if c.isalnum() or c == "_" else " " for c in query)
    return word.split()


def chunk_lines(text: Column, most: int = MAX_CHUNK) -> Column:
    """Chunks of whole lines of at most ``most`` bytes: array of (start_line, end_line, chunk).

    Blank lines before a chunk are dropped, ends are trimmed, and a longer line is cut by characters.
    """
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    piece = "struct<line:int,s:string>"
    cut = lambda x: F.transform(
        F.sequence(F.lit(0), F.floor((F.greatest(F.length(x), F.lit(1)) - 1) / most).cast("int")),
        lambda k: F.substring(x, k * most + 1, F.lit(most)),
    )
    numbered = F.flatten(F.transform(lines, lambda x, i: F.transform(cut(x), lambda s: F.struct((i + 1).cast("int").alias("line"), s.alias("s")).cast(piece))))
    out_type = "array<struct<start_line:int,end_line:int,chunk:string>>"
    zero = F.struct(F.array().cast(out_type).alias("out"), F.lit(0).alias("first"), F.lit(0).alias("last"), F.lit("").alias("buf"))

    def closed(a):
        one = F.struct(a["first"].alias("start_line"), a["last"].alias("end_line"), F.regexp_replace(a["buf"], r"[\x20\x09-\x0D]+$", "").alias("chunk"))
        return F.when(~a["buf"].rlike(HOLDS), a["out"]).otherwise(F.array_append(a["out"], one))

    def step(a, x):
        blank = ~a["buf"].rlike(HOLDS)
        fits = F.octet_length(a["buf"]) + F.octet_length(x["s"]) + 1 <= most
        begin = F.struct(closed(a).alias("out"), x["line"].alias("first"), x["line"].alias("last"), x["s"].alias("buf"))
        grow = F.struct(a["out"].alias("out"), a["first"].alias("first"), x["line"].alias("last"), F.concat(a["buf"], F.lit("\n"), x["s"]).alias("buf"))
        return F.when(blank | ~fits, begin).otherwise(grow)

    return F.aggregate(numbered, zero, step, closed)


#: Parts of names whose values are kept secret.
SENSITIVE = (
    "password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "private_key", "access_key", "client_secret", "connection_string", "conn_string", "connectionstring",
    "credential", "auth", "bearer", "jwt", "certificate", "cert", "signing_key", "encryption_key",
)
SECRET = rf"(?i)\b([A-Za-z0-9_]*(?:{'|'.join(SENSITIVE)}|api-key)[A-Za-z0-9_]*)(\s*[=:]\s*)(\"[^\"\n]*\"|'[^'\n]*'|[^\s\"']+)"


def redact_secrets(text: Column) -> Column:
    """Values assigned to sensitive names replaced by [REDACTED]."""
    return F.regexp_replace(text, SECRET, "$1$2[REDACTED]")


def count_matches(text: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))).cast("bigint")


def metadata_map(packed: Column) -> Column:
    """The map of a ``key=value;key=value`` string."""
    return F.str_to_map(F.coalesce(packed, F.lit("")), F.lit(";"), F.lit("="))
