"""Addresses in HTML and CSS made absolute, text and addresses taken apart and joined again; all inside the JVM."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagelathe.functions.text import SKIP_LINK, resolve_url

# Attributes that hold an address, what may hold several, and addresses in CSS.
ONE, MANY, CSS = r"(?:src|href|poster)=[\"'][^\"']+[\"']", r"srcset=[\"'][^\"']+[\"']", r"url\([\"']?[^\"')\s]+[\"']?\)"
HEAD = r"(?i)^((?:src|href|poster)=[\"']|url\([\"']?)"
TAIL = r"([\"']?\)|[\"'])$"


def _folded(path: Column) -> Column:
    """An absolute path without '.' and '..' segments and empty ones within; '..' at the root stays there, and at the end both leave a folder."""
    parts = F.split(path, "/")
    last = F.element_at(parts, -1)
    inner = F.filter(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0))), lambda s: s != "")
    every = F.concat(inner, F.array(last), F.when(last.isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>")))
    kept = F.aggregate(every, F.array().cast("array<string>"), lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(s == ".", acc).otherwise(F.array_append(acc, s)))
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def absolute(url: Column, base: Column) -> Column:
    """An address made absolute against a page's, the page's path counting as a folder: kept where it has a scheme or is an anchor or template; '//' gets https, '/' the origin; relative ones lose their dots. Kept too where the base isn't absolute."""
    origin = F.regexp_extract(base, r"^(https?://[^/?#]+)", 1)
    folder = F.concat(F.lit("/"), F.regexp_extract(base, r"^https?://[^/?#]+/*([^?#]*?)/*(?:[?#].*)?$", 1))
    path, tail = F.regexp_extract(url, r"^([^?#]*)", 1), F.regexp_extract(url, r"^[^?#]*(.*)$", 1)
    joined = F.when(path == "", F.concat(F.regexp_replace(folder, "/*$", ""), F.lit("/"))).otherwise(_folded(F.concat(F.regexp_replace(folder, "/*$", ""), F.lit("/"), path)))
    keep = url.rlike(SKIP_LINK) | url.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:") | (origin == "")
    return F.when(keep, url).when(url.startswith("/"), resolve_url(url, base)).otherwise(F.concat(origin, joined, tail))


def _srcset(value: Column, base: Column) -> Column:
    """The candidates of a srcset with their addresses absolute, empty ones dropped."""
    one = lambda c: F.concat_ws(" ", absolute(F.regexp_extract(c, r"^(\S+)", 1), base), F.nullif(F.regexp_replace(F.regexp_extract(c, r"^\S+\s+([\s\S]*)$", 1), r"\s+", " "), F.lit("")))
    return F.array_join(F.transform(F.filter(F.transform(F.split(value, ","), lambda c: F.trim(c)), lambda c: c != ""), one), ", ")


def _rejoined(text: Column, pattern: str, fixed) -> Column:
    """A text whose matches of a pattern are replaced by `fixed` of them."""
    rest = F.split(text, pattern, -1)
    new = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), fixed)
    return F.array_join(F.zip_with(rest, new, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def absolute_html(html: Column, base: Column) -> Column:
    """A page whose src, href, poster, srcset and url() addresses are absolute; all else stays as it stands. Null pages stay null, and null or empty bases change nothing."""

    def fixed(m: Column) -> Column:
        head = F.regexp_extract(m, HEAD, 1)
        tail = F.regexp_extract(m, TAIL, 1)
        url = F.substring(m, F.length(head) + 1, F.length(m) - F.length(head) - F.length(tail))
        many = F.concat(F.substring(m, 1, 8), _srcset(F.substring(m, F.lit(9), F.length(m) - 9), base), F.substring(m, -1, 1))
        return F.when(m.rlike("(?i)^srcset="), many).otherwise(F.concat(head, absolute(url, base), tail))

    return F.when(F.coalesce(base, F.lit("")) == "", html).otherwise(_rejoined(html, f"(?i){MANY}|{ONE}|{CSS}", fixed))


def absolute_css(css: Column, base: Column) -> Column:
    """A style sheet whose url() addresses are absolute."""

    def fixed(m: Column) -> Column:
        head, tail = F.regexp_extract(m, HEAD, 1), F.regexp_extract(m, TAIL, 1)
        return F.concat(head, absolute(F.substring(m, F.length(head) + 1, F.length(m) - F.length(head) - F.length(tail)), base), tail)

    return F.when(F.coalesce(base, F.lit("")) == "", css).otherwise(_rejoined(css, f"(?i){CSS}", fixed))


# How an address names a theme.
THEME_MARKS = ("-{}.", "_{}.", "/{}/", "-{}-", "_{}_", "{}-mode", "{}mode", "{}_mode")


def theme(url: Column) -> Column:
    """the theme that an address names, in either case: dark, light, or common where it names both or neither; null for null."""
    named = lambda word: reduce(or_, (F.contains(F.lower(url), F.lit(m.format(word))) for m in THEME_MARKS))
    dark, light = named("dark"), named("light")
    return F.when(url.isNull(), None).when(dark == light, "common").when(dark, "dark").otherwise("light")
