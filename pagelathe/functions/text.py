"""Column functions over URLs, names, numbers, hashes and log lines; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SKIP_LINK = r"^(data:|javascript:|mailto:|tel:|#|\{|\$)"


def resolve_url(url: Column, base: Column) -> Column:
    """A URL made absolute against a page's: kept where it is empty, absolute or of a scheme of its own; '//' gets https; '/' the origin; anything else the base as a folder."""
    origin = F.regexp_extract(base, r"^(https?://[^/?#]+)", 1)
    path = F.regexp_extract(base, r"^https?://[^/?#]+([^?#]*)", 1)
    folder = F.concat(origin, F.regexp_replace(path, "/+$", ""), F.lit("/"))
    return (
        F.when(url.rlike(SKIP_LINK) | url.rlike("^https?://") | (url == ""), url)
        .when(url.startswith("//"), F.concat(F.lit("https:"), url))
        .when(url.startswith("/"), F.concat(origin, url))
        .otherwise(F.concat(folder, F.regexp_replace(url, r"^\./", "")))
    )


def host(url: Column) -> Column:
    """The host of an absolute URL, else null."""
    return F.nullif(F.regexp_extract(url, r"^https?://([^/?#:]+)", 1), F.lit(""))


def is_external(url: Column, domain: Column) -> Column:
    """Whether a link leaves the page's domain: it starts with http and doesn't contain it."""
    return url.startswith("http") & ~url.contains(domain)


def quote(url: Column) -> Column:
    """Percent-encoding of all but unreserved characters."""
    out = F.url_encode(url)
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def proxied(url: Column, proxy: str) -> Column:
    """A URL through a proxy; empty, data, local and proxied ones stay."""
    full = F.when(url.startswith("//"), F.concat(F.lit("https:"), url)).otherwise(url)
    return F.when((url == "") | url.startswith("data:") | url.contains("localhost") | url.contains(proxy), url).otherwise(F.concat(F.lit(proxy), quote(full)))


def file_name(url: Column) -> Column:
    """The last part of a URL's path."""
    return F.regexp_extract(F.regexp_replace(url, r"[?#].*$", ""), r"([^/]*)$", 1)


def pascal(name: Column) -> Column:
    """Words split at dashes, underscores and spaces, capitalised and joined."""
    return F.replace(F.initcap(F.regexp_replace(name, r"[-_\s]+", " ")), F.lit(" "), F.lit(""))


def display_name(name: Column) -> Column:
    """A class or id as words: dashes and underscores to spaces, camel case split, capitalised."""
    return F.initcap(F.trim(F.regexp_replace(F.regexp_replace(name, "[-_]+", " "), "([a-z])([A-Z])", "$1 $2")))


def slug(name: Column) -> Column:
    """A file name: illegal characters and blanks to dashes, runs joined, ends stripped, 30 characters."""
    return F.left(F.regexp_replace(F.regexp_replace(F.regexp_replace(name, r'[<>:"/\\|?*\s]+', "-"), "-+", "-"), "^-+|-+$", ""), F.lit(30))


def byte_label(n: Column) -> Column:
    """A size with a unit, one decimal at most."""
    k = F.when(n < 1024, 0).when(n < 1024**2, 1).when(n < 1024**3, 2).otherwise(3)
    unit = F.element_at(F.array(*map(F.lit, ("B", "KB", "MB", "GB"))), k + 1)
    return F.when(n == 0, "0 B").otherwise(F.concat(F.regexp_replace(F.format_string("%.1f", F.round(n / F.pow(F.lit(1024.0), k), 1)), r"\.0$", ""), F.lit(" "), unit))


def token_label(n: Column) -> Column:
    """~n, in thousands where it is that large."""
    return F.when(n >= 1000, F.concat(F.lit("~"), F.round(n / 1000, 0).cast("long").cast("string"), F.lit("K"))).otherwise(F.concat(F.lit("~"), n.cast("string")))


def string_hash(text: Column) -> Column:
    """A 32-bit string hash, h * 31 + code for each of the first characters of the basic plane, absolute, in hex, 12 digits at most."""
    step = lambda h, c: F.pmod(h * 31 + F.ascii(c), F.lit(1 << 32).cast("long"))
    h = F.aggregate(F.split(text, ""), F.lit(0).cast("long"), step)
    signed = F.when(h >= 1 << 31, h - (1 << 32)).otherwise(h)
    return F.left(F.lower(F.hex(F.abs(signed))), F.lit(12))


def short_hash(text: Column) -> Column:
    """The first 16 hex digits of SHA-256."""
    return F.left(F.sha2(text.cast("binary"), 256), F.lit(16))


# File suffixes that locations name.
SOURCE = r"\.(?:jsx?|tsx?|vue|svelte|css|scss)"


def location(text: Column) -> Column:
    """struct<file, line, column> of a message: path:line[:column], else 'line n' and 'col n' with a bare path."""
    at = rf"([^\s:]+{SOURCE}):(\d+)(?::(\d+))?"
    part = lambda i: F.nullif(F.regexp_extract(text, at, i), F.lit(""))
    plain = lambda p: F.nullif(F.regexp_extract(text, p, 1), F.lit(""))
    has = text.rlike(at)
    return F.struct(
        F.when(has, part(1)).otherwise(plain(rf"(/[^\s:]+{SOURCE})")).alias("file"),
        F.when(has, part(2)).otherwise(plain(r"[Ll]ine[:\s]+(\d+)")).cast("long").alias("line"),
        F.when(has, part(3)).otherwise(plain(r"[Cc]ol(?:umn)?[:\s]+(\d+)")).cast("long").alias("column"),
    )


def strip_ansi(text: Column) -> Column:
    """Terminal text without colour codes and carriage returns."""
    return F.replace(F.regexp_replace(text, r"\x1b\[[0-9;]*[a-zA-Z]", ""), F.lit("\r"), F.lit(""))


def clean_title(title: Column) -> Column:
    """A title without what follows its first bar, dash or hyphen; 50 characters."""
    return F.left(F.trim(F.regexp_replace(title, r"\s*[|–—-].*$", "")), F.lit(50))


def squeeze(text: Column) -> Column:
    """Runs of blanks as one space, trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


# Resource kinds by content type and suffix, in order.
KINDS = (("image", r"image/|\.(png|jpe?g|gif|webp|svg|ico)$"), ("font", r"font|\.(woff2?|ttf|otf|eot)$"), ("script", r"javascript|\.m?js$"), ("stylesheet", r"css|\.css$"), ("document", r"html"), ("json", r"json"))


def content_kind(content_type: Column) -> Column:
    """The kind of a resource by its content type or name."""
    out = F.when(F.lit(False), "")
    for kind, pattern in KINDS:
        out = out.when(F.lower(content_type).rlike(pattern), kind)
    return out.otherwise("other")


def glob_regex(glob: str) -> str:
    """A glob as a regular expression for the whole path: * and ? also match slashes."""
    import fnmatch

    return fnmatch.translate(glob).replace(r"\Z", r"\z").replace("(?s:", "(?s:")


def millis(ts: Column) -> Column:
    """A time in milliseconds since 1970; halves are rounded away from zero."""
    us = F.unix_micros(ts.cast("timestamp"))
    half = us + F.when(us < 0, -500).otherwise(500)
    return F.call_function("div", half, F.lit(1000))
