"""Files as rows: search, context, trees, edits, diffs, budgets."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Exact diffs up to so many lines a side; longer files are matched by looking ahead so many lines.
EXACT, AHEAD = 1000, 10


def lines(files: DataFrame) -> DataFrame:
    """(path, line_no from 1, line)."""
    return files.select("path", F.posexplode(F.split("content", "\n")).alias("n", "line")).select("path", (F.col("n") + 1).alias("line_no"), "line")


def grep(files: DataFrame, pattern: str, per_file: int = 5, most_chars: int = 500_000, cut: int = 200) -> DataFrame:
    """Lines that a pattern fits in either case, the first ones of each file, cut; n_matches counts all of a file's. Files over most_chars are skipped."""
    hits = lines(files.where(F.char_length("content") <= most_chars)).where(F.col("line").rlike(f"(?i){pattern}"))
    w = Window.partitionBy("path").orderBy("line_no")
    ranked = hits.withColumns({"k": F.row_number().over(w), "n_matches": F.count("*").over(Window.partitionBy("path"))})
    return ranked.where(F.col("k") <= per_file).select("path", "line_no", F.left("line", F.lit(cut)).alias("line"), "n_matches")


def context(files: DataFrame, pattern: str, before: int = 1, after: int = 1) -> DataFrame:
    """Matching lines and those around them; runs are numbered, so a separator goes between them."""
    w = Window.partitionBy("path").orderBy("line_no")
    rows = lines(files).withColumn("hit", F.col("line").rlike(f"(?i){pattern}").cast("int"))
    rows = rows.withColumn("near", F.max("hit").over(w.rowsBetween(-after, before))).where("near = 1")
    new = F.when(F.col("line_no") - F.lag("line_no").over(w) == 1, 0).otherwise(1)
    return rows.withColumn("_new", new).withColumn("block", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).select("path", "line_no", (F.col("hit") == 1).alias("hit"), "block")


def tree(files: DataFrame) -> DataFrame:
    """Every folder and file: (node, parent, depth, is_file, files below)."""
    parts = F.split(F.regexp_replace("path", "^/", ""), "/")
    up = files.select("path", F.posexplode(F.transform(parts, lambda p, i: F.array_join(F.slice(parts, F.lit(1), i + 1), "/"))).alias("i", "node"), F.size(parts).alias("n"))
    g = up.groupBy("node", (F.col("i") + 1).alias("depth")).agg(F.max(F.col("i") + 1 == F.col("n")).alias("is_file"), F.count("*").alias("files"))
    return g.withColumn("parent", F.regexp_extract("node", "^(.*)/[^/]*$", 1))


def allowed(path: Column, prefix: str, suffixes: tuple[str, ...], forbidden: tuple[str, ...]) -> Column:
    """Below a prefix, of one of the suffixes, not forbidden, and not sensitive."""
    ok = path.startswith(prefix) & F.lower(path).rlike("(" + "|".join(s.replace(".", r"\.") for s in suffixes) + ")$")
    for f in forbidden:
        ok = ok & ~path.endswith(f)
    return ok & ~F.lower(path).rlike(r"\.env|\.git|id_rsa|credentials|secret|password")


def read_lines(content: Column, start: int, end: int, most: int = 100) -> Column:
    """Lines start..end from 1; a negative end counts from the last; `most` at most."""
    all_ = F.split(content, "\n")
    stop = F.lit(end) if end >= 0 else F.size(all_) + end + 1
    return F.array_join(F.slice(all_, F.lit(max(1, start)), F.greatest(F.least(stop - max(1, start) + 1, F.lit(most)), F.lit(0))), "\n")


def numbered(content: Column) -> Column:
    """Lines with their numbers."""
    return F.array_join(F.transform(F.split(content, "\n"), lambda x, i: F.format_string("%4d %s", i + 1, x)), "\n")


def replaced(content: Column, old: str, new: str, every: bool = False) -> Column:
    """The content with `old` replaced; null unless it comes exactly once, or `every` and at all."""
    n = F.size(F.split(content, "\\Q" + old + "\\E")) - 1
    return F.when((n == 1) | (F.lit(every) & (n > 0)), F.replace(content, F.lit(old), F.lit(new)))


def _lengths(old: list[str], new: list[str]) -> np.ndarray:
    """Lengths of the longest common subsequences of all beginnings, a row at a time: along a row they are the running maximum of what the row above allows."""
    code = {x: k for k, x in enumerate(dict.fromkeys(old + new))}
    right = np.array([code[x] for x in new], np.int32)
    out = np.zeros((len(old) + 1, len(new) + 1), np.int32)
    for i, x in enumerate(old):
        out[i + 1, 1:] = np.maximum.accumulate(np.maximum(out[i, 1:], out[i, :-1] + (right == code[x])))
    return out


def diff(old: list[str], new: list[str]) -> list[tuple[str, str, int | None, int | None]]:
    """(type, line, old number, new number). Up to EXACT lines a side by longest common subsequence, walked from the end, added before removed on ties; above that by the next equal line within AHEAD."""
    if max(len(old), len(new)) > EXACT:
        return _ahead(old, new)
    best, out, i, j = _lengths(old, new), [], len(old), len(new)
    while i or j:
        if i and j and old[i - 1] == new[j - 1]:
            kind, di, dj = "same", 1, 1
        elif not i or (j and best[i, j - 1] >= best[i - 1, j]):
            kind, di, dj = "added", 0, 1
        else:
            kind, di, dj = "removed", 1, 0
        out.append((kind, old[i - 1] if di else new[j - 1], i if di else None, j if dj else None))
        i, j = i - di, j - dj
    return out[::-1]


def _ahead(old: list[str], new: list[str]) -> list[tuple[str, str, int | None, int | None]]:
    """Both sides side by side: where they differ, the side whose line comes sooner on the other one, the old side on ties, waits for it; lines that neither side has within AHEAD are changed one for one."""

    def steps(lines: list[str], at: int, wanted: str) -> int:
        return next((k for k, x in enumerate(lines[at : at + AHEAD]) if x == wanted), AHEAD)

    added = lambda j: ("added", new[j], None, j + 1)
    removed = lambda i: ("removed", old[i], i + 1, None)
    out, i, j = [], 0, 0
    while i < len(old) and j < len(new):
        down, across = steps(new, j, old[i]), steps(old, i, new[j])
        if not down:
            out.append(("same", old[i], i + 1, j + 1))
            i, j = i + 1, j + 1
        elif down == across == AHEAD:
            out += [removed(i), added(j)]
            i, j = i + 1, j + 1
        elif down <= across:
            out += map(added, range(j, j + down))
            j += down
        else:
            out += map(removed, range(i, i + across))
            i += across
    return [*out, *map(removed, range(i, len(old))), *map(added, range(j, len(new)))]


class Diffs:
    """A table function: the line diff of two texts, null as empty. It has one pair of texts at a time and yields its rows."""

    def eval(self, old: str, new: str) -> Iterator[tuple]:
        for k, row in enumerate(diff((old or "").split("\n"), (new or "").split("\n"))):
            yield k, *row


line_diffs = F.udtf(Diffs, returnType="n int, type string, line string, old_no long, new_no long")


def diffs(pairs: DataFrame) -> DataFrame:
    """(path, old, new) as rows (path, n, type, line, old_no, new_no). Each pair is diffed by itself, so a worker's memory follows its texts, not their number."""
    return pairs.select("path", "old", "new").lateralJoin(line_diffs(F.col("old").outer(), F.col("new").outer())).drop("old", "new")


def diff_stats(rows: DataFrame) -> DataFrame:
    """Added, removed, and whether a line that isn't blank changed."""
    changed = F.col("type") != "same"
    g = rows.groupBy("path").agg(F.count_if(F.col("type") == "added").alias("added"), F.count_if(F.col("type") == "removed").alias("removed"), F.max(changed & (F.trim("line") != "")).alias("meaningful"))
    return g.withColumn("summary", F.concat(F.lit("+"), F.col("added").cast("string"), F.lit(" -"), F.col("removed").cast("string")))


def pack(files: DataFrame, per_file: int = 8192, total: int = 32768, most: int = 20) -> DataFrame:
    """(group, path, priority, tokens) that stay: files over `per_file` tokens are halved by lines; then the lowest priorities go until the total and number fit. The order is total, so the rest is a running sum from the highest priority down."""
    t = F.when(F.col("tokens") > per_file, F.floor(F.col("tokens") / 2)).otherwise(F.col("tokens"))
    w = Window.partitionBy("group").orderBy(F.desc("priority"), "path")
    rows = files.withColumn("tokens", t).withColumns({"sum": F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, 0)), "n": F.row_number().over(w)})
    return rows.withColumn("ok", F.min(((F.col("sum") <= total) & (F.col("n") <= most)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("ok = 1").drop("ok", "sum")


def unresolved_imports(files: DataFrame) -> DataFrame:
    """Relative imports for which no file is there, whatever suffix or index is added."""
    rel = F.regexp_extract_all("content", F.lit(r"""(?:from|import)\s+['"](\.{1,2}/[^'"]+)['"]"""), F.lit(1))
    one = files.select("path", F.explode(rel).alias("import"))
    folder = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    base = F.when(F.col("import").startswith("../"), F.concat(F.regexp_extract(folder, "^(.*)/[^/]*$", 1), F.lit("/"), F.substring("import", 4, 10000))).otherwise(F.concat(folder, F.lit("/"), F.substring("import", 3, 10000)))
    # fixed values: what may follow an import's path
    ends = F.array(*map(F.lit, ("", ".js", ".jsx", ".ts", ".tsx", "/index.js", "/index.jsx", "/index.ts", "/index.tsx")))
    tried = one.select("path", "import", F.explode(F.transform(ends, lambda e: F.concat(base, e))).alias("target"))
    there = tried.join(files.select(F.col("path").alias("target")), "target", "left_semi").select("path", "import").distinct()
    return one.distinct().join(there, ["path", "import"], "left_anti")


def undeclared_packages(files: DataFrame, declared: DataFrame, builtin: tuple[str, ...] = ("fs", "path", "http", "react")) -> DataFrame:
    """Packages that are imported and neither built in nor declared; scoped names keep two parts."""
    names = F.flatten(F.array(F.regexp_extract_all("content", F.lit(r"""from\s+['"]([^'".][^'"]*)['"]"""), F.lit(1)), F.regexp_extract_all("content", F.lit(r"""require\(\s*['"]([^'".][^'"]*)['"]"""), F.lit(1))))
    used = files.select(F.explode(names).alias("name")).select(F.when(F.col("name").startswith("@"), F.regexp_extract("name", "^(@[^/]+/[^/]+)", 1)).otherwise(F.substring_index("name", "/", 1)).alias("name")).distinct()
    return used.where(~F.col("name").isin(*builtin)).join(declared.select("name"), "name", "left_anti")


# Characters that make a search pattern one for paths.
GLOB = "*?[]"


def search_mode(pattern: str) -> str:
    """Whether a pattern without a mode is looked for among paths (files) or in what they hold (content)."""
    return "files" if set(pattern) & set(GLOB) else "content"


def found(files: DataFrame, pattern: str, mode: str | None = None) -> DataFrame:
    """Files (path) that a pattern finds, by path as a glob, or by content as a regular expression in any case, as its mode or its characters say."""
    if (mode or search_mode(pattern)) == "files":
        from pagelathe.functions.text import glob_regex

        return files.where(F.col("path").rlike(glob_regex(pattern))).select("path")
    return files.where(F.col("content").rlike(f"(?i){pattern}")).select("path")


def replaced_lines(content: Column, start: int, end: int, new: str) -> Column:
    """The content with lines start..end, from 1 and both included, replaced; ends beyond the file are taken as its ends."""
    all_ = F.split(content, "\n")
    first, n = max(1, start), F.size(all_)
    begin = F.least(F.lit(first), n + 1)
    stop = F.least(F.lit(max(end, first - 1)), n)
    tail = F.slice(all_, stop + 1, F.greatest(n - stop, F.lit(0)))
    return F.array_join(F.concat(F.slice(all_, F.lit(1), begin - 1), F.split(F.lit(new), "\n"), tail), "\n")


def _words(target: str) -> list[str]:
    return [w for w in re.split(r"\W+", target.lower().strip()) if len(w) > 3]


def similar_lines(files: DataFrame, target: str, most: int = 10) -> DataFrame:
    """(path, line_no, line, score, place): of each file the `most` lines with the largest share of the target's words over three letters; of equal ones the first."""
    words = _words(target)
    low = F.lower("line")
    hits = sum((low.contains(w).cast("int") for w in words), F.lit(0))
    rows = lines(files).withColumn("score", hits / F.lit(float(max(1, len(words))))).where("score > 0")
    w = Window.partitionBy("path").orderBy(F.desc("score"), "line_no")
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def unspaced(text: Column) -> Column:
    """Runs of blanks and tabs as one space, none at ends of lines nor around the whole."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"\s+(?=\n)", ""), r"^\s+|\s+$", "")


def located(files: DataFrame, target: str, most: int = 10) -> DataFrame:
    """(path, tier, line_no, score) of a text in each file: where it stands exactly; else, blanks aside, the line that its first line is in; else its similar lines. Files with none have no row."""
    head = target.split("\n")[0].strip()
    exact = F.col("content").contains(target)
    loose = unspaced(F.col("content")).contains(F.lit(" ".join(target.split()) if "\n" not in target else re.sub(r"[ \t]+", " ", target).strip()))
    tiers = files.withColumn("tier", F.when(exact, "exact").when(loose, "spacing").otherwise("similar"))
    before = F.substring_index("content", target, 1)
    place = F.char_length(before) - F.char_length(F.replace(before, F.lit("\n"), F.lit(""))) + 1
    whole = tiers.where("tier = 'exact'").select("path", "tier", place.alias("line_no"), F.lit(1.0).alias("score"))
    spaced = tiers.where("tier = 'spacing'")
    near = lines(spaced).where(unspaced(F.col("line")).contains(re.sub(r"[ \t]+", " ", head)))
    near = near.groupBy("path").agg(F.min("line_no").alias("line_no")).select("path", F.lit("spacing").alias("tier"), "line_no", F.lit(1.0).alias("score"))
    rest = similar_lines(tiers.where("tier = 'similar'"), target, most).select("path", F.lit("similar").alias("tier"), "line_no", "score")
    return whole.unionByName(near).unionByName(rest)


def recommended(files: DataFrame, hints: list[str], most: int = 5) -> DataFrame:
    """C14: for each hint the first `most` files, by path, whose content holds it in either case."""
    low = F.lower("content")
    held = files.select("path", F.explode(F.array_compact(F.array(*(F.when(low.contains(h.lower()), F.lit(h)) for h in hints)))).alias("hint"))
    return held.withColumn("place", F.row_number().over(Window.partitionBy("hint").orderBy("path"))).where(F.col("place") <= most)
