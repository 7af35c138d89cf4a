"""Typed views over packed metadata and page mark-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import metadata_map


def limited_view(rows: DataFrame, packed: str, fields: list[str], defaults: dict, order: list[str], most: int, wanted: dict) -> DataFrame:
    """rows with the fields of the packed string; the first ``most`` in order, and only then those that have the wanted values."""
    m = metadata_map(F.col(packed))
    out = rows.select("*", *(F.coalesce(F.element_at(m, f), F.lit(defaults.get(f))).alias(f) for f in fields)).drop(packed)
    out = out.orderBy(*order).limit(most)
    for field, value in wanted.items():
        out = out.filter(F.col(field) == value)
    return out


#: Fields of each view with what stands for a missing one; the first field marks a row of the view.
VIEWS = {
    "route": {"framework": "unknown", "method": None, "path": None, "kind": "api", "handler": None, "class": None, "function": None, "source": "unknown"},
    "component": {"framework": "react", "export": None, "kind": "unknown", "props": None, "hooks": None, "usages": None, "source": "unknown"},
    "data_access": {"technology": "unknown", "kind": "Unknown", "operation": None, "entity": None, "repository": None, "query": None, "context": None, "source": "unknown"},
    "realtime": {"technology": "unknown", "kind": "Unknown", "direction": "unknown", "event": None, "channel": None, "hub": None, "endpoint": None, "source": "unknown"},
    "messaging": {"technology": "unknown", "kind": "Unknown", "direction": "unknown", "topic": None, "queue": None, "pattern": None, "exchange": None, "routing_key": None, "source": "unknown"},
    "infrastructure": {"technology": "unknown", "kind": "Unknown", "name": None, "image": None, "namespace": None, "resource_type": None, "provider": None, "source": "unknown"},
    "wpf": {"technology": "wpf", "kind": "Unknown", "binding_paths": None, "command_bindings": None, "view_model": None, "data_context": None, "source": "WpfMetadata"},
}
LISTS = ("hooks", "usages", "binding_paths", "command_bindings")
ANY_CASE = {("route", "method"), ("messaging", "kind"), ("wpf", "kind")}


def domain_view(symbols: DataFrame, view: str, most: int, wanted: dict | None = None) -> DataFrame:
    """id, symbol, file_path, line and the fields of a view, of symbols with packed ``view.field=value;...`` metadata.

    The first ``most`` by (path, line, name, id) are taken, and only then those that
    have the wanted values; a wanted value of a list is one of its members. A route
    without method and path takes both from its name. Null metadata is of no view.
    """
    m, fields = metadata_map(F.col("metadata")), VIEWS[view]
    rows = domain_view_rows(symbols, view)
    spare = dict(fields)
    if view == "route":
        cut = F.instr("name", " ") > 0
        spare |= {"method": F.when(cut, F.substring_index("name", " ", 1)).otherwise("UNKNOWN"), "path": F.when(cut, F.expr("substring(name, instr(name, ' ') + 1)")).otherwise(F.col("name"))}
    value = lambda f: F.coalesce(F.try_element_at(m, F.lit(f"{view}.{f}")), spare[f] if isinstance(spare[f], Column) else F.lit(spare[f]).cast("string"))
    sure = F.coalesce(F.expr("try_cast(c as bigint)"), F.lit(0))
    first = rows.orderBy("path", "start_line", "name", "id").limit(most)
    out = first.withColumn("c", F.try_element_at(m, F.lit(f"{view}.confidence"))).select(
        "id", "project", F.col("name").alias("symbol"), F.col("path").alias("file_path"), F.col("start_line").alias("line"), *(value(f).alias(f) for f in fields), sure.alias("confidence")
    )
    for field, want in (wanted or {}).items():
        if field in LISTS:
            out = out.filter(F.array_contains(F.split(field, ","), want))
        else:
            out = out.filter(F.lower(field) == want.lower() if (view, field) in ANY_CASE else F.col(field) == want)
    return out


def federated_view(symbols: DataFrame, view: str, each: int, most: int) -> DataFrame:
    """The first ``each`` rows of every project's view, then the first ``most`` of all by (project, file, line, symbol, id)."""
    every = domain_view_rows(symbols, view)
    rank = F.row_number().over(Window.partitionBy("project").orderBy("path", "start_line", "name", "id"))
    kept = every.withColumn("_n", rank).filter(F.col("_n") <= each).orderBy("project", "path", "start_line", "name", "id").limit(most).drop("_n")
    return domain_view(kept, view, most)


def domain_view_rows(symbols: DataFrame, view: str) -> DataFrame:
    """The symbols of a view, as they are."""
    marker = f"{view}.{next(iter(VIEWS[view]))}="
    return symbols.filter(F.col("kind") == "Route" if view == "route" else F.coalesce(F.col("metadata"), F.lit("")).contains(marker))


def file_contents(files: DataFrame, most: int) -> DataFrame:
    """path and content of the first files by path."""
    return files.select("path", "content").orderBy("path").limit(most)


def page_facts(pages: DataFrame) -> DataFrame:
    """Title, language and counts of links, forms and scripts of each page."""
    html = F.coalesce("html", F.lit(""))
    count = lambda p: F.size(F.regexp_extract_all(html, F.lit(p), F.lit(0))).cast("bigint")
    return pages.select(
        "page_id", F.regexp_extract(html, r"(?s)<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract(html, r'<html lang="([a-z]*)"', 1).alias("lang"),
        count(r"<a href=").alias("n_links"), count(r"<form\b").alias("n_forms"), count(r"<script\b").alias("n_scripts"),
    )


def page_links(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r'<a href="([^"]*)"'), F.lit(1))).alias("href"))
