"""Style sheets as rows: rules with the conditions around them."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A comment, a string, an address without quotes, an escape, a bracket or sign, or a stretch of anything else; what isn't closed ends with its line (strings) or with the sheet.
_TOKEN = re.compile(r"""(?P<comment>/\*(?:.*?\*/|.*))|(?P<text>"(?:[^"\\\n]|\\.)*(?:"|(?=\n)|$)|'(?:[^'\\\n]|\\.)*(?:'|(?=\n)|$)|url\(\s*[^"'\s)][^)]*(?:\)|$)|\\.)|(?P<sign>[{};()\[\]])|(?P<rest>(?:[^"'/\\{};()\[\]u]|u(?!rl\()|/(?!\*))+|.)""", re.DOTALL | re.IGNORECASE)
# At-rules whose blocks hold rules under a condition.
CONDITIONS = ("@media", "@supports", "@container", "@layer", "@scope", "@document", "@starting-style")
SCHEMA = "rule_no int, name string, selector string, conditions array<string>, declarations array<struct<key:string,value:string>>"
STYLE = r"(?i)<style[^>]*>([\s\S]*?)</style>"


class _Block:
    """An open block: what stands before its brace, and what has been declared in it."""

    def __init__(self, prelude: str, number: int) -> None:
        self.prelude, self.number = prelude, number
        self.name = prelude.split(None, 1)[0].split("(", 1)[0].lower() if prelude.startswith("@") else ""
        self.declared: list[tuple[str, str]] = []


def rules(css: str | None) -> list[tuple]:
    """The blocks and statements of a style sheet in order, as SCHEMA: at-rules by their name, others with the name ''.

    Braces, semicolons and comment marks in strings, addresses and brackets are text. A rule within others, whether
    at-rules or rules, comes with the conditions around it, outermost first; the selectors of rules around it stand
    before its own, '&' taken as they are. Blocks that nothing closes end with the sheet, as do comments; braces that
    close nothing drop out. Declarations without a colon drop out too.
    """
    out: list[tuple] = []
    stack: list[_Block] = []
    buffer: list[str] = []
    depth = number = 0

    def text() -> str:
        said = re.sub(r"\s+(?=(?:[^\"']|\"[^\"]*\"|'[^']*')*$)", " ", "".join(buffer)).strip() if buffer and "\n" in "".join(buffer) else "".join(buffer).strip()
        buffer.clear()
        return said

    def row(n: int, name: str, selector: str, declared: list) -> None:
        around = stack
        conditions = [b.prelude for b in around if b.name in CONDITIONS or b.name.endswith("keyframes")]
        outer = [b.prelude for b in around if not b.name]
        out.append((n, name, " ".join([*outer, selector]) if not name else selector, conditions, declared))

    def declare(said: str) -> None:
        key, colon, value = said.partition(":")
        if stack and colon and key.strip():
            stack[-1].declared.append((key.strip(), value.strip()))

    def end() -> None:
        block = stack.pop()
        row(block.number, block.name, block.prelude, block.declared)

    for m in _TOKEN.finditer(css or ""):
        kind, t = m.lastgroup, m[0]
        if kind == "comment":
            buffer.append(" ")
        elif kind != "sign":
            buffer.append(t)
        elif t in "([":
            depth += 1
            buffer.append(t)
        elif t in ")]":
            depth = max(0, depth - 1)
            buffer.append(t)
        elif depth and t == ";":
            buffer.append(t)
        elif t == "{":
            depth = 0
            stack.append(_Block(text(), number))
            number += 1
        elif t == ";":
            said = text()
            if said.startswith("@"):
                row(number, said.split(None, 1)[0].lower(), said, [])
                number += 1
            else:
                declare(said)
        else:
            depth = 0
            said = text()
            if stack:
                declare(said)
                end()
    said = text()
    if stack:
        declare(said)
        while stack:
            end()
    return sorted(out, key=lambda r: r[0])


class Rules:
    """A table function: the rules of one style sheet."""

    def eval(self, css: str) -> Iterator[tuple]:
        yield from rules(css)


page_rules = F.udtf(Rules, returnType=SCHEMA)


def css_rules(pages: DataFrame) -> DataFrame:
    """(page_id, rule_no, kind, selector, conditions, declarations) of the style elements of pages (page_id, html), in order: rules, keyframes and their steps, conditions, variables, pseudo-elements, transitions and other at-rules.

    Pages without styles, null ones among them, have none. Only the sheets leave the JVM.
    """
    css = pages.select("page_id", F.array_join(F.regexp_extract_all(F.col("html").cast("string"), F.lit(STYLE), F.lit(1)), "\n").alias("css")).where(F.col("css") != "")
    found = css.lateralJoin(page_rules(F.col("css").outer()))
    name, s = F.col("name"), F.col("selector")
    within = F.exists("conditions", lambda c: c.rlike("^@(-\\w+-)?keyframes"))
    kind = (
        F.when(name.endswith("keyframes"), "keyframes")
        .when(name == "@media", "media")
        .when(name != "", F.substring(name, F.lit(2), F.length(name)))
        .when(within, "step")
        .when(s.rlike("^:root"), "variables")
        .when(s.contains("::") | s.rlike(r":(before|after)\b"), "pseudo")
        .when(F.exists("declarations", lambda x: x["key"].contains("transition")), "transition")
        .otherwise("rule")
    )
    return found.select("page_id", "rule_no", kind.alias("kind"), "selector", "conditions", "declarations")
