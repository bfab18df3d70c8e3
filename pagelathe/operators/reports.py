"""Reports over terminal and console lines: diagnoses, suggestions, related files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Words that make a line an error or a warning, and those of lines worth showing with an error.
ERROR_WORDS = "error|failed|exception|cannot|fatal"
WARNING_WORDS = "warn|deprecated"
CONTEXT_WORDS = ("error", "failed", "cannot", "unexpected", "missing", "undefined", "null", "line", "at ")
# Suggestions by the text of an error, in order.
SUGGESTIONS = (("cannot find module", "Install the package or mend the import path"), ("unexpected token", "Check brackets and quotes near the line"), ("is not defined", "Import or declare the name before its use"), ("failed to resolve import", "Create the file or remove the import"))


def level(line: Column) -> Column:
    """A line's level by its words."""
    return F.when(F.lower(line).rlike(ERROR_WORDS), "error").when(F.lower(line).rlike(WARNING_WORDS), "warning").otherwise("info")


def suggestion(message: Column) -> Column:
    """The first suggestion whose words a message has."""
    out = F.when(F.lit(False), "")
    for words, say in SUGGESTIONS:
        out = out.when(F.lower(message).contains(words), say)
    return out


def context_lines(message: Column, lines: int = 50, most: int = 10) -> Column:
    """Lines of a message's head that have a telling word."""
    has = lambda x: F.lower(x).rlike("|".join(CONTEXT_WORDS))
    return F.slice(F.filter(F.slice(F.split(message, "\n"), 1, lines), has), 1, most)


def tail(log: DataFrame, key: str, seq: str, n: int) -> DataFrame:
    """The last n lines of each log, in order."""
    w = Window.partitionBy(key).orderBy(F.desc(seq))
    return log.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def diagnosis(log: DataFrame, key: str, seq: str, line: str, last: int = 50, show: int = 3) -> DataFrame:
    """Errors and warnings among a log's last lines, the first few errors cut at 200 characters, and how many more there are."""
    rows = tail(log, key, seq, last).withColumn("level", level(F.col(line)))
    g = rows.groupBy(key).agg(F.count_if(F.col("level") == "error").alias("errors"), F.count_if(F.col("level") == "warning").alias("warnings"), F.sort_array(F.collect_list(F.when(F.col("level") == "error", F.struct(seq, F.left(line, F.lit(200)).alias("t"))))).alias("l"))
    shown = F.array_join(F.transform(F.slice("l", 1, show), lambda x: x["t"]), "\n")
    more = F.when(F.col("errors") > show, F.concat(F.lit("\n+"), (F.col("errors") - show).cast("string"), F.lit(" more"))).otherwise("")
    return g.select(key, "errors", "warnings", F.concat(shown, more).alias("report"))


def build_error(text: Column) -> Column:
    """struct<plugin, file, line, column, frame, stack> of a build error."""
    part = lambda p, i=1: F.nullif(F.regexp_extract(text, p, i), F.lit(""))
    at = r"([^\s:()]+\.[a-z]+):(\d+):(\d+)"
    lines = F.split(text, "\n")
    return F.struct(part(r"\[plugin:([^\]]+)\]").alias("plugin"), part(at).alias("file"), part(at, 2).cast("int").alias("line"), part(at, 3).cast("int").alias("column"), F.filter(lines, lambda x: x.rlike(r"^\s*\d*\s*\|")).alias("frame"), F.filter(lines, lambda x: F.ltrim(x).startswith("at ")).alias("stack"))


def related(errors: DataFrame, files: DataFrame, most: int = 5) -> DataFrame:
    """Files whose name an error's message has, the first ones by path. Names are taken out of the message, so this is an equality join."""
    named = errors.select("error_id", F.explode(F.array_distinct(F.regexp_extract_all("message", F.lit(r"([\w.-]+\.[a-z]{1,6})"), F.lit(1)))).alias("name"))
    hits = named.join(files.select("path", F.regexp_extract("path", "([^/]+)$", 1).alias("name")), "name")
    w = Window.partitionBy("error_id").orderBy("path")
    return hits.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).select("error_id", "path")


# Endings of image files; hosts whose addresses are images without such an ending, those of them that srcset takes too; first labels of hosts that serve files; properties that hold images.
IMAGE_ENDINGS = "jpg|jpeg|png|gif|webp|svg|ico|avif|heic|heif|bmp|tiff?"
IMAGE_HOSTS = (
    r"images\.unsplash\.com", r"res\.cloudinary\.com", r"[a-z0-9-]+\.imgix\.net", r"i\.imgur\.com", r"images\.pexels\.com", r"cdn\.shopify\.com", r"[a-z0-9-]+\.cloudfront\.net", r"storage\.googleapis\.com",
    r"firebasestorage\.googleapis\.com", r"[a-z0-9-]+\.supabase\.co", r"vercel\.app", r"raw\.githubusercontent\.com", r"avatars\.githubusercontent\.com", r"user-images\.githubusercontent\.com", r"cdn\.sanity\.io",
    r"media\.graphassets\.com", r"cdn\.dribbble\.com", r"cdn\.pixabay\.com", r"picsum\.photos", r"loremflickr\.com", r"placekitten\.com", r"placehold\.co", r"via\.placeholder\.com",
)
SIZED_HOSTS = IMAGE_HOSTS[-5:]
FILE_LABELS = "cdn|images?|img|media|assets?|static"
IMAGE_FIELDS = "image|src|url|poster|thumbnail|avatar|logo|icon|cover|banner|background|photo|picture"


def image_patterns() -> dict[str, str]:
    """How code names images, each with the address as its group: what stands before, the address, what stands after."""
    opened, closed = r"""(?:src=["']|srcset=["']|url\(["']?)""", r"""(?:["')]|[\s,])"""
    address = lambda barred, ending=rf"\.(?:{IMAGE_ENDINGS})": rf"(https?://[^{barred}]+{ending})"
    on = lambda hosts, barred: rf"(https?://(?:{'|'.join(hosts)})[^{barred}]+)"
    kinds = {
        "attribute": opened + address(r""""'\s),""") + closed,
        "expression": r"""src=\{[`"']""" + address(r"""`"'\s),""") + r"""[`"']\}""",
        "image host": opened + on(IMAGE_HOSTS, r""""'\s),""") + closed,
        "lazy": r"""data-src=["']""" + address(r""""'\s""") + r"""["']""",
        "poster": r"""poster=["']""" + address(r""""'\s""") + r"""["']""",
        "property": rf"""(?:{IMAGE_FIELDS})["']?\s*:\s*["']""" + address(r""""'\s""") + r"""["']""",
        "list": r"""["']""" + address(r""""'\s""") + r"""["']\s*[,\]]""",
        "file host": r"""(?:src=["']|srcset=["']|url\(["']?|["'])""" + rf"""(https?://(?:{FILE_LABELS})\.[a-z0-9-]+\.[a-z]{{2,}}[^"'\s),]*)""" + closed,
        "srcset": address(r""""'\s,""") + r"\s+[0-9.]+[wx]",
        "srcset host": on(SIZED_HOSTS, r""""'\s,""") + r"\s+[0-9.]+[wx]",
    }
    return {k: f"(?i){p}" for k, p in kinds.items()}


def image_urls(files: DataFrame) -> DataFrame:
    """(path, url, is_new) of the image addresses in code, by all of image_patterns(); new where no earlier path has it."""
    found = F.array_distinct(F.flatten(F.array(*(F.regexp_extract_all("content", F.lit(k), F.lit(1)) for k in image_patterns().values()))))
    rows = files.select("path", F.explode(found).alias("url"))
    first = rows.groupBy("url").agg(F.min("path").alias("first"))
    return rows.join(first, "url").select("path", "url", (F.col("path") == F.col("first")).alias("is_new"))


def restored(text: Column, mapping: dict[str, str]) -> Column:
    """Local paths replaced by their addresses, the longest first."""
    for k in sorted(mapping, key=len, reverse=True):
        text = F.replace(text, F.lit(k), F.lit(mapping[k]))
    return text


def blank_pages(pages: DataFrame) -> DataFrame:
    """Pages (children, text_chars, html_chars, has_root) that show nothing."""
    root = (F.col("children") == 0) & (F.col("text_chars") <= 10) & (F.col("html_chars") <= 50)
    none = (F.col("children") <= 1) & (F.col("text_chars") <= 20)
    return pages.where(F.when(F.col("has_root"), root).otherwise(none))


def theme_support(counts: DataFrame) -> DataFrame:
    """What a page's themes are by its counters (colors, elements, variables, images) and flags (media_query, dark_class)."""
    any_ = (F.col("colors") > 0) | (F.col("elements") > 0) | (F.col("variables") > 0) | (F.col("images") > 0)
    return counts.withColumn("support", F.when(any_ | F.col("media_query"), "BOTH").when(F.col("dark_class"), "DARK_ONLY").otherwise("LIGHT_ONLY"))


def changed(base: Column, hover: Column) -> Column:
    """Styles of a state that differ from the base."""
    return F.map_filter(hover, lambda k, v: ~v.eqNullSafe(F.try_element_at(base, k)))
