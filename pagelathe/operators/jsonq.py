"""Queries into JSON documents: paths, keyword search, tree walks, descriptions."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelathe.operators import jsonpath


def normal_path(path: str) -> str:
    """A path as JSONPath: '$.a.b[0]', 'a.b[0]' and 'a/b/0' alike."""
    p = path.removeprefix("$").lstrip("./")
    if "/" in p:
        p = "".join(f"[{x}]" if x.isdigit() else f".{x}" for x in p.split("/") if x)
    elif p and p[0] != "[":
        p = f".{p}"
    if not re.fullmatch(r"(\.[^.\[\]']+|\[(\d+|\*)\])*", p):
        raise ValueError(f"no path: {path}")
    return f"${p}"


def path(column: str, at: str) -> Column:
    """The value at a path, as text; null where it is missing."""
    return F.get_json_object(column, normal_path(at))


def matches(df: DataFrame, column: str, at: str, most: int = 30) -> DataFrame:
    """Matches of a path, at most `most` of them, with how many there are in all."""
    found = F.from_json(path(column, at), "array<string>") if "*" in at else F.when(path(column, at).isNotNull(), F.array(path(column, at)))
    return df.withColumn("_all", F.coalesce(found, F.array().cast("array<string>"))).withColumn("n_matches", F.size("_all")).withColumn("shown", F.slice("_all", 1, most)).drop("_all")


def key_types(df: DataFrame, column: str) -> DataFrame:
    """(key, type) for each top-level key of each object."""
    spark_map = F.from_json(column, "map<string,string>")
    rows = df.select(F.explode(spark_map).alias("key", "value"))
    v = F.col("value")
    kind = F.when(v.isNull(), "NULL").when(v.rlike(r"^-?\d+$"), "BIGINT").when(v.rlike(r"^-?\d+\.\d+([eE][+-]?\d+)?$"), "DOUBLE").when(v.isin("true", "false"), "BOOLEAN").when(v.startswith("{"), "OBJECT").when(v.startswith("["), "ARRAY").otherwise("VARCHAR")
    return rows.select("key", kind.alias("type"))


def describe(v: object) -> str:
    """An object's or list's size, a text's length, else the type."""
    if isinstance(v, dict):
        return f"object ({len(v)} keys) - keys: {', '.join(list(v)[:5])}"
    if isinstance(v, list):
        return f"array ({len(v)} items)"
    if isinstance(v, str):
        return f"string ({len(v)} chars)"
    return "null" if v is None else "boolean" if isinstance(v, bool) else "number"


def infer(v: object) -> str:
    """A value's type; a list's by its first item."""
    if isinstance(v, list):
        return f"{infer(v[0])}[]" if v else "any[]"
    return "string | null" if v is None else "boolean" if isinstance(v, bool) else "number" if isinstance(v, (int, float)) else "string" if isinstance(v, str) else "object"


def truncate(v: object, text: int = 500, items: int = 10) -> object:
    """Long texts and lists cut, with a note of what is cut."""
    if isinstance(v, str):
        return v if len(v) <= text else f"{v[:text]}…({len(v)} chars)"
    if isinstance(v, list):
        return [truncate(x, text, items) for x in v[:items]] + ([f"…({len(v)} items)"] if len(v) > items else [])
    return {k: truncate(x, text, items) for k, x in v.items()} if isinstance(v, dict) else v


def find_field(fields: list[str], patterns: list[str]) -> str | None:
    """The first field that equals a pattern, by pattern order within field order, else the first that contains one."""
    for test in (lambda f, p: f.lower() == p, lambda f, p: p in f.lower()):
        for f in fields:
            if any(test(f, p.lower()) for p in patterns):
                return f
    return None


def union_keys(df: DataFrame, key: str, column: str, sample: int = 5) -> DataFrame:
    """E5: (key, field): the fields of the first `sample` objects of each JSON list; other items have none."""
    items = F.slice(F.coalesce(F.from_json(column, "array<string>"), F.array().cast("array<string>")), 1, sample)
    return df.select(key, F.explode(F.flatten(F.transform(items, lambda x: F.coalesce(F.json_object_keys(x), F.array().cast("array<string>"))))).alias("field")).distinct()


def _loaded(docs: pd.Series):
    """Each readable document's place and value."""
    for i, doc in enumerate(docs):
        try:
            if doc is not None:
                yield i, json.loads(doc)
        except (ValueError, RecursionError):
            continue


def dispatch(df: DataFrame, key: str, column: str, query: str) -> DataFrame:
    """(key, place, path, value, n_matches): a query that starts with $ or . is a JSONPath, of which 20 matches are shown; any other is a word to search for."""
    return jsonpath.select(df, key, column, query, 20) if query.startswith(("$", ".")) else jsonpath.found(df, key, column, query)


def brief(v: object, text: int = 50) -> str:
    """A value as a list's or object's size, a text's beginning, else its type."""
    if isinstance(v, list):
        return f"list[{len(v)} items]"
    if isinstance(v, dict):
        return f"dict[{len(v)} keys]"
    if isinstance(v, str):
        return f'"{v[:text]}{"..." if len(v) > text else ""}"'
    return type(v).__name__


def described(df: DataFrame, key: str, column: str, most: int = 15, text: int = 50) -> DataFrame:
    """(key, lines): the first `most` keys of each JSON object, one to a line; no line for other documents."""

    def run(batches):
        for x in batches:
            out = [None] * len(x)
            for i, v in _loaded(x["doc"]):
                if isinstance(v, dict):
                    out[i] = "\n".join(f"- **{k}**: {brief(y, text)}" for k, y in list(v.items())[:most])
            yield pd.DataFrame({"k": x["k"], "lines": out})

    return df.select(F.col(key).cast("string").alias("k"), F.col(column).alias("doc")).mapInPandas(run, "k string, lines string").withColumnRenamed("k", key)
