"""Columns for path text, and parsing of what a user types (one scalar, so plain Python)."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normal_path(c: Column) -> Column:
    """Forward slashes, one leading "./" off, lower case; white space stays."""
    return F.lower(F.regexp_replace(F.translate(c, "\\", "/"), r"^\./", ""))


def normal_query(text: str) -> str:
    """As normal_path, with all white space gone."""
    return "".join(re.sub(r"^\./", "", text.replace("\\", "/")).lower().split())


def normal_query_column(c: Column) -> Column:
    """normal_query of a column; white space as Unicode has it."""
    return F.regexp_replace(normal_path(c), r"(?U)\s+", "")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent(path: Column) -> Column:
    """What stands before the last slash, else ''."""
    return F.regexp_extract(path, r"(?s)^(.*)/", 1)


def depth(path: Column) -> Column:
    return F.size(F.split(path, "/"))


def grams(c: Column, n: int) -> Column:
    """Distinct substrings of length n."""
    return F.when(F.length(c) < n, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c) - (n - 1))), lambda i: F.substring(c, i, F.lit(n)))))


def name_prefixes(name: Column, most: int = 3) -> Column:
    """Distinct beginnings of 1 to `most` characters."""
    return F.filter(F.array_distinct(F.array(*(F.left(name, F.lit(k)) for k in range(1, most + 1)))), lambda p: p != "")


def segment_prefixes(path: Column, most: int = 3) -> Column:
    """Distinct beginnings of 1 to `most` characters of each segment."""
    return F.filter(F.array_distinct(F.flatten(F.transform(F.split(path, "/"), lambda s: F.array(*(F.left(s, F.lit(k)) for k in range(1, most + 1)))))), lambda p: p != "")


def ancestors(path: Column) -> Column:
    """Every directory above a path, the topmost first."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) < 2, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(parts) - 1)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")))


def with_normal(paths: DataFrame) -> DataFrame:
    """(seq, workspace, kind, relative_path) with the normalized columns and depth."""
    out = paths.withColumn("norm_path", normal_path(F.col("relative_path")))
    return out.withColumns({"norm_name": base_name(F.col("norm_path")), "norm_parent": parent(F.col("norm_path")), "norm_workspace": normal_path(F.col("workspace")), "depth": depth(F.col("relative_path"))})


@dataclass(frozen=True)
class Typed:
    """What was typed: a directory to look in and a query, or a query over whole paths."""

    scope: str
    query: str
    everywhere: bool = False


def parse_typed(value: str) -> Typed:
    slashed = value.replace("\\", "/")
    clean = re.sub(r"/{2,}", "/", re.sub(r"^/+", "", re.sub(r"^\./+", "", slashed)))
    if slashed.startswith("//"):
        return Typed("", clean, True)
    scope, slash, query = clean.rpartition("/")
    return Typed(scope, query) if slash else Typed("", clean)


def parent_typed(value: str) -> str:
    """What to type for the directory above the one typed."""
    above = parse_typed(value).scope.rpartition("/")[0]
    return above + "/" if above else ""


def candidate_query(typed: Typed) -> str:
    """What candidates are fetched by: over whole paths the last segment that isn't empty."""
    query = normal_query(typed.query)
    if not typed.everywhere:
        return query
    return next((s for s in reversed(query.split("/")) if s), "")


def relative_to(uri: Column, root: Column) -> Column:
    """The path of a uri below a root of the same scheme and authority, without outer slashes; null if it isn't below."""
    top = F.concat(F.regexp_replace(root, "/$", ""), F.lit("/"))
    rest = F.substring(uri, F.length(top) + 1, F.length(uri))
    return F.when(F.startswith(uri, top), F.regexp_replace(F.translate(rest, "\\", "/"), "/$", ""))


def shown(path: Column, workspace: Column, display: str = "parent", several_roots: bool = False) -> Column:
    """What stands beside a name in a list: display "parent" (./ at the top), "full" or "hidden"; before it the workspace, where there are several. Null for nothing."""
    where = {"parent": F.when(F.instr(path, "/") > 0, parent(path)).otherwise("./"), "full": path, "hidden": F.lit(None).cast("string")}[display]
    return F.concat_ws(" \u00b7 ", workspace, where) if several_roots else where


def suffix_list(items: list[str]) -> list[str]:
    """File suffixes: trimmed, lower case, with a leading dot, each once."""
    cleaned = (i.strip().lower() for i in items)
    return list(dict.fromkeys(i if i.startswith(".") else "." + i for i in cleaned if i))
