"""JSONPath over variants: names, indexes, slices, unions, wildcards, filters and recursive descent."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Levels of nesting that a document can have: deeper ones can't be read as variants.
LEVELS = 1000
#: Characters of documents whose matches a task ranks, so that its memory doesn't grow with the input.
SHARE = 8_000_000
_CHILD = "array<struct<pos:int,key:string,value:variant>>"
_STRING = r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*\""""
_NUMBER = r"-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?"
_TOKEN = re.compile(rf"\s*(?:(?P<path>@(?:\.[^\s.\[\]()=!<>&|,]+|\[(?:\d+|{_STRING})\])*)|(?P<text>{_STRING})|(?P<number>{_NUMBER})|(?P<word>true|false|null)\b|(?P<sign>\|\||&&|==|!=|<=|>=|<|>|!|\(|\)))")

#: A step maps a variant to its chosen children; None stands for recursive descent.
Step = Callable[[Column], Column] | None


def read(column: str | Column) -> Column:
    """A JSON text as a variant; null for texts that can't be read."""
    return F.try_parse_json(F.col(column) if isinstance(column, str) else column)


def is_text(v: Column) -> Column:
    """Whether a variant is a string."""
    return F.schema_of_variant(v) == "STRING"


def shown(v: Column) -> Column:
    """A variant as text: strings as they are, others as JSON, objects' keys in order."""
    return F.when(is_text(v), F.try_variant_get(v, "$", "string")).otherwise(F.to_json(v))


def _items(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def children(v: Column) -> Column:
    """The children (pos, key, value) of an object or array; other values have none."""
    fields = F.transform(F.map_entries(F.try_variant_get(v, "$", "map<string,variant>")), lambda x, i: F.struct(i.cast("int").alias("pos"), x["key"].alias("key"), x["value"].alias("value")))
    items = F.transform(_items(v), lambda x, i: F.struct(i.cast("int").alias("pos"), F.lit(None).cast("string").alias("key"), x.alias("value")))
    return F.coalesce(fields, items, F.array().cast(_CHILD))


def _named(name: str) -> Step:
    return lambda v: F.filter(children(v), lambda x: x["key"] == name)


def _placed(places: Callable[[Column], Column]) -> Step:
    """The items of an array at the places that its length gives."""

    def step(v: Column) -> Column:
        n = F.size(_items(v))
        at = F.coalesce(F.when(n.isNotNull(), places(n)), F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.struct(i.cast("int").alias("pos"), F.lit(None).cast("string").alias("key"), F.get(_items(v), i).alias("value")))

    return step


def _index(i: int) -> Step:
    at = (lambda n: F.lit(i)) if i >= 0 else (lambda n: n + i)
    return _placed(lambda n: F.when((at(n) >= 0) & (at(n) < n), F.array(at(n))))


def _slice(start: int | None, end: int | None, by: int) -> Step:
    def places(n: Column) -> Column:
        bound = lambda x, low, high: F.least(F.greatest(F.lit(x) if x >= 0 else n + x, F.lit(low)), high)
        if by > 0:
            low, high = bound(start or 0, 0, n), n if end is None else bound(end, 0, n)
            return F.when(low < high, F.sequence(low, high - 1, F.lit(by)))
        if by < 0:
            high, low = n - 1 if start is None else bound(start, -1, n - 1), F.lit(-1) if end is None else bound(end, -1, n - 1)
            return F.when(low < high, F.sequence(high, low + 1, F.lit(by)))
        return F.lit(None).cast("array<int>")

    return _placed(places)


class _Filter:
    """The test of a filter, read by descent over its tokens, as a function of the child's variant."""

    def __init__(self, text: str) -> None:
        self.tokens, at = [], 0
        while text[at:].strip():
            m = _TOKEN.match(text, at)
            if not m:
                raise ValueError(f"no filter: {text}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.tokens.append(("end", ""))
        self.test = self._any()
        if self.tokens[0][0] != "end":
            raise ValueError(f"no filter: {text}")

    def _take(self, *signs: str) -> str | None:
        return self.tokens.pop(0)[1] if self.tokens[0] in [("sign", s) for s in signs] else None

    def _any(self):
        parts = [self._all()]
        while self._take("||"):
            parts.append(self._all())
        return lambda v: reduce(lambda a, b: a | b, (p(v) for p in parts))

    def _all(self):
        parts = [self._one()]
        while self._take("&&"):
            parts.append(self._one())
        return lambda v: reduce(lambda a, b: a & b, (p(v) for p in parts))

    def _one(self):
        if self._take("!"):
            inner = self._one()
            return lambda v: ~inner(v)
        if self._take("("):
            inner = self._any()
            if not self._take(")"):
                raise ValueError("a filter's bracket isn't closed")
            return inner
        left = self._value()
        sign = self._take("==", "!=", "<=", ">=", "<", ">")
        if not sign:
            if isinstance(left, str):
                return lambda v: F.try_variant_get(v, left, "variant").isNotNull()
            raise ValueError("a filter's constant stands alone")
        right = self._value()
        return lambda v: self._compared(v, left, sign, right)

    def _value(self):
        """A path below the child as text, or a constant in a list."""
        kind, text = self.tokens.pop(0)
        if kind == "path":
            return "$" + text[1:]
        if kind == "text":
            return [re.sub(r"\\(.)", r"\1", text[1:-1])]
        if kind == "number":
            return [float(text)]
        if kind == "word":
            return [{"true": True, "false": False, "null": None}[text]]
        raise ValueError(f"a filter lacks a value at {text!r}")

    @staticmethod
    def _compared(v: Column, left, sign: str, right) -> Column:
        """Values of different kinds are unequal and in no order; a missing one equals nothing but another missing one."""

        def views(x) -> tuple[Column, Column, Column, Column, Column]:
            if isinstance(x, list):
                c = x[0]
                number, text, truth = (F.lit(c if isinstance(c, k) and not (k is float and isinstance(c, bool)) else None).cast(t) for k, t in ((float, "double"), (str, "string"), (bool, "boolean")))
                return number, text, truth, F.lit(c is None), F.lit(False)
            own = F.try_variant_get(v, x, "variant")
            kind = F.schema_of_variant(own)
            as_ = lambda pattern, t: F.when(kind.rlike(pattern), F.try_variant_get(v, x, t))
            return as_("^(BIGINT|DOUBLE|FLOAT|DECIMAL)", "double"), as_("^STRING$", "string"), as_("^BOOLEAN$", "boolean"), F.coalesce(kind == "VOID", F.lit(False)), own.isNull()

        a, b = views(left), views(right)
        op = {"==": lambda x, y: x == y, "!=": lambda x, y: x == y, "<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y}[sign]
        out = F.coalesce(*(op(x, y) for x, y in zip(a[:3] if sign in ("==", "!=") else a[:2], b, strict=False)), F.lit(False))
        if sign in ("==", "!=", "<=", ">="):
            out = out | (a[3] & b[3]) | (a[4] & b[4])
        return ~out if sign == "!=" else out


def _bracket(text: str) -> Step:
    """The step of what stands between brackets."""
    if text.lstrip().startswith("?"):
        test = _Filter(text.lstrip()[1:]).test
        return lambda v: F.filter(children(v), lambda x: test(x["value"]))
    steps = []
    for part in re.findall(rf"\s*({_STRING}|[^,]+)\s*(?:,|$)", text):
        part = part.strip()
        if re.fullmatch(_STRING, part):
            steps.append(_named(re.sub(r"\\(.)", r"\1", part[1:-1])))
        elif part == "*":
            steps.append(children)
        elif re.fullmatch(r"-?\d+", part):
            steps.append(_index(int(part)))
        elif m := re.fullmatch(r"(-?\d+)?\s*:\s*(-?\d+)?\s*(?::\s*(-?\d+)?)?", part):
            steps.append(_slice(int(m[1]) if m[1] else None, int(m[2]) if m[2] else None, int(m[3]) if m[3] else 1))
        else:
            raise ValueError(f"no selector: {part}")
    if not steps:
        raise ValueError("empty brackets")
    return steps[0] if len(steps) == 1 else lambda v: F.concat(*(s(v) for s in steps))


def _close(text: str, at: int) -> int:
    """Where the bracket that opens at `at` closes; brackets within strings don't count."""
    depth = 0
    for m in re.compile(rf"{_STRING}|[\[\]]").finditer(text, at):
        depth += {"[": 1, "]": -1}.get(m[0], 0)
        if not depth:
            return m.start()
    raise ValueError(f"no path: {text}")


def compiled(path: str) -> list[Step]:
    """The steps of a path: '$.a.b[0]', 'a.b[0]' and 'a/b/0' alike, with all that JSONPath has in brackets and after '..'."""
    p = path.strip()
    p = p.removeprefix("$") if p.startswith("$") else p if p[:1] in ("[", ".") else f".{p}" if p else p
    if "/" in p and "[" not in p:
        p = "".join(f"[{x}]" if x.isdigit() else f".{x}" for x in p.lstrip(".").split("/") if x)
    steps: list[Step] = []
    at = 0
    while at < len(p):
        deep = p.startswith("..", at)
        if deep:
            steps.append(None)
            at += 2
        elif p[at] == ".":
            at += 1
        elif p[at] != "[":
            raise ValueError(f"no path: {path}")
        if p[at : at + 1] == "[":
            end = _close(p, at)
            steps.append(_bracket(p[at + 1 : end]))
            at = end + 1
        elif m := re.compile(r"[^.\[\]'\"\s]+").match(p, at):
            steps.append(children if m[0] == "*" else _named(m[0]))
            at = m.end()
        else:
            raise ValueError(f"no path: {path}")
    return steps


def _named_path(path: Column, key: Column, pos: Column) -> Column:
    return F.concat(path, F.when(key.isNull(), F.concat(F.lit("["), pos.cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("."), key)))


def descend(rows: DataFrame) -> DataFrame:
    """Rows (k, path, depth, at, v) with all that lies below their variants, level by level; `at` has the positions on the way."""
    return rows.sparkSession.sql(
        f"""WITH RECURSIVE w(k, path, depth, at, v) MAX RECURSION LEVEL {LEVELS + 2} AS (
            SELECT k, path, depth, at, v FROM {{rows}}
            UNION ALL
            SELECT w.k, concat(w.path, CASE WHEN x.key IS NULL THEN concat('[', x.pos, ']') ELSE concat('.', x.key) END), w.depth + 1, array_append(w.at, x.pos), x.value
            FROM w, LATERAL variant_explode_outer(w.v) AS x WHERE x.pos IS NOT NULL)
        SELECT * FROM w LIMIT ALL""",
        rows=rows,
    )


def roots(df: DataFrame, key: str, column: str) -> DataFrame:
    """Each document as the row (k, path, depth, at, v) of its root; null documents have none, unreadable ones a null v."""
    rows = df.where(F.col(column).isNotNull())
    return rows.select(F.col(key).cast("string").alias("k"), F.lit("$").alias("path"), F.lit(0).alias("depth"), F.array().cast("array<int>").alias("at"), read(column).alias("v"))


def dealt(rows: DataFrame, df: DataFrame, column: str) -> DataFrame:
    """Rows (k, ...) of the documents of df, dealt by k to as many tasks as the documents' characters ask for, which are summed first: matches compress so well that their bytes don't tell how many there are."""
    chars = df.agg(F.sum(F.char_length(column))).first()[0] or 0
    return rows.repartition(int(chars // SHARE) + 1, "k")


def ranked(rows: DataFrame, key: str, most: int, cap: int | None = None) -> DataFrame:
    """(key, place, path, value, n_matches) of rows (k, path, at, v): the first `most` of each k by `at`, and how many there are, `cap` at most."""
    own = Window.partitionBy("k")
    n = F.count("*").over(own)
    out = rows.withColumns({"place": F.row_number().over(own.orderBy("at", "path")).cast("long"), "n_matches": n if cap is None else F.least(n, F.lit(cap).cast("long"))}).where(F.col("place") <= most)
    return out.select(F.col("k").alias(key), "place", "path", shown(F.col("v")).alias("value"), "n_matches")


def select(df: DataFrame, key: str, column: str, path: str, most: int = 30) -> DataFrame:
    """(key, place, path, value, n_matches): where a JSONPath leads in each document: the `most` first matches, their own paths, and how many there are.

    Matches come in the order of the path's selectors, below '..' parents before children. Objects' fields are in the
    order of their names. Rows of equal keys count as one document; null and unreadable documents, such as those nested
    deeper than LEVELS, have no matches. Without '..' nothing is shuffled before the matches are ranked; with it, each
    level is a pass over the rows that the last one found.
    """
    rows = roots(df, key, column).where("v IS NOT NULL")
    for step in compiled(path):
        if step is None:
            rows = descend(rows).withColumn("at", F.array_append("at", F.lit(-1)))
        else:
            rows = rows.select("*", F.posexplode(step(F.col("v"))).alias("i", "c"))
            rows = rows.select("k", _named_path(F.col("path"), F.col("c.key"), F.col("c.pos")).alias("path"), (F.col("depth") + 1).alias("depth"), F.array_append("at", F.col("i")).alias("at"), F.col("c.value").alias("v"))
    return ranked(dealt(rows, df, column), key, most)


def walk(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, path, depth, value) of all nodes of each document, values as JSON. Null documents have none; unreadable ones, such as those nested deeper than LEVELS, have their root alone, without value."""
    return descend(roots(df, key, column)).select(F.col("k").alias(key), "path", "depth", F.to_json("v").alias("value"))


def found(df: DataFrame, key: str, column: str, word: str, shown: int = 15, items: int = 100, most: int = 50) -> DataFrame:
    """P5: (key, place, path, value, n_matches): keys that contain a word, whose values are not gone into, and texts that do, the case of letters aside.

    Of each list the first `items` are looked at; the first `most` matches of a document count, `shown` are returned.
    Null and unreadable documents have none; rows of equal keys count as one document.
    """
    text = lambda v: f"(schema_of_variant({v}) = 'STRING' AND contains(lower(CAST({v} AS STRING)), w.word))"
    start = roots(df, key, column).where("v IS NOT NULL").withColumn("word", F.lower(F.lit(word)))
    rows = df.sparkSession.sql(
        f"""WITH RECURSIVE w(k, path, at, v, word, hit) MAX RECURSION LEVEL {LEVELS + 2} AS (
            SELECT k, path, at, v, word, {text("w.v")} FROM {{start}} w
            UNION ALL
            SELECT w.k, concat(w.path, CASE WHEN x.key IS NULL THEN concat('[', x.pos, ']') ELSE concat('.', x.key) END), array_append(w.at, x.pos), x.value, w.word,
              coalesce(contains(lower(x.key), w.word), false) OR {text("x.value")}
            FROM w, LATERAL variant_explode_outer(w.v) AS x WHERE NOT w.hit AND x.pos IS NOT NULL AND (x.key IS NOT NULL OR x.pos < {items}))
        SELECT k, path, at, v FROM w WHERE hit LIMIT ALL""",
        start=start,
    )
    return ranked(dealt(rows, df, column), key, shown, most)
