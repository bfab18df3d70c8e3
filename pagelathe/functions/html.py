"""Column functions over HTML and CSS text; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _all(c: Column, steps: list[tuple[str, str]]) -> Column:
    for pattern, to in steps:
        c = F.regexp_replace(c, F.lit(pattern), F.lit(to))
    return c


# Patterns and placeholders, in order.
TOKEN_STEPS = [
    (r"(?i)data:image/[^;]+;base64,[A-Za-z0-9+/=]+", "[IMG:base64]"),
    (r"(?i)data:[^,]+,[A-Za-z0-9+/=]{100,}", "[DATA:url]"),
    (r"(?i)<svg[^>]*>[\s\S]*?</svg>", "<svg>[SVG]</svg>"),
    (r'(?i)style="[^"]{200,}"', 'style="[LONG_STYLES]"'),
    (r'(?i)srcset="[^"]{500,}"', 'srcset="[SRCSET]"'),
]
HEAD_STEPS = [
    (r"(?i)<!DOCTYPE[^>]*>", ""),
    (r"<!--[\s\S]*?-->", ""),
    (r"(?i)<script[^>]*>[\s\S]*?</script>", ""),
    (r"(?i)<script[^>]*/>", ""),
    (r"(?i)<style[^>]*>[\s\S]*?</style>", ""),
    (r"(?i)<meta[^>]*/?>", ""),
    (r"(?i)<title[^>]*>[\s\S]*?</title>", ""),
    (r"(?i)<link[^>]*/?>", ""),
    (r"(?i)<noscript[^>]*>[\s\S]*?</noscript>", ""),
]
BODY = r"(?i)<body[^>]*>([\s\S]*)</body>"
WRAPPER_STEPS = [
    (r"(?i)</?html[^>]*>", ""),
    (r"(?i)<head[^>]*>[\s\S]*?</head>", ""),
    (r"(?i)</?head[^>]*>", ""),
    (r"(?i)</?body[^>]*>", ""),
    (r"\n\s*\n\s*\n", "\n\n"),
]


def token_html(html: Column) -> Column:
    """HTML without what should not count as tokens: embedded data, drawings, long attributes. Null gives the empty text."""
    return _all(F.coalesce(html, F.lit("")), TOKEN_STEPS)


def section_html(html: Column) -> Column:
    """HTML of a section alone: without document type, comments, scripts, styles, head parts and wrappers; blank lines joined; trimmed."""
    c = _all(F.coalesce(html, F.lit("")), HEAD_STEPS)
    body = F.regexp_extract(c, BODY, 1)
    c = F.when(c.rlike(BODY), body).otherwise(c)
    return F.regexp_replace(_all(c, WRAPPER_STEPS), r"^\s+|\s+$", "")


def example_html(html: Column) -> Column:
    """An example item: drawings become a comment, titles and labels over 100 characters are cut, data attributes of 500 or more go."""
    return _all(html, [(r"(?i)<svg[^>]*>[\s\S]*?</svg>", "<!-- svg -->"), (r'(title|aria-label)="([^"]{100})[^"]+"', '$1="$2..."'), (r'\sdata-[A-Za-z0-9_-]+="[^"]{500,}"', "")])


def est_tokens(text: Column) -> Column:
    """A quarter of the characters, rounded down."""
    return F.floor(F.char_length(text) / 4).cast("long")


def line_of(text: Column, position: Column) -> Column:
    """Line (from 1) of a character offset; 0 where the offset isn't positive."""
    head = F.substring(text, F.lit(1), position)
    return F.when(position <= 0, 0).otherwise(F.char_length(head) - F.char_length(F.replace(head, F.lit("\n"), F.lit(""))) + 1)


# Section names and the class words that give them, in order.
SECTION_WORDS = [
    ("hero", ("hero", "banner", "jumbotron")),
    ("features", ("feature",)),
    ("pricing", ("pricing",)),
    ("testimonials", ("testimonial", "review")),
    ("faq", ("faq",)),
    ("contact", ("contact",)),
    ("cta", ("cta", "call-to-action")),
    ("about", ("about",)),
    ("team", ("team",)),
    ("blog", ("blog", "news")),
    ("gallery", ("gallery", "portfolio")),
]
LAYOUT_WORDS = [("hero", ("hero", "banner")), *SECTION_WORDS[1:7]]


def _has(c: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


def section_name(tag: Column, classes: Column, index: Column) -> Column:
    """A section's name by its tag or classes, else by its number."""
    tag, classes = F.lower(tag), F.lower(classes)
    out = F.when((tag == "header") | classes.contains("header"), "header").when((tag == "footer") | classes.contains("footer"), "footer").when((tag == "nav") | classes.contains("nav"), "navigation")
    for name, words in SECTION_WORDS:
        out = out.when(_has(classes, words), name)
    return out.otherwise(F.concat(F.lit("section_"), index.cast("string")))


def layout_type(tag: Column, classes: Column, index: Column, total: Column) -> Column:
    """A layout row's type by its tag or classes, else by its place: first header, last footer."""
    tag, classes = F.lower(tag), F.lower(classes)
    out = F.when((tag == "header") | _has(classes, ("header", "nav")), "header").when((tag == "footer") | classes.contains("footer"), "footer").when((tag == "nav") | classes.contains("navigation"), "navigation")
    for name, words in LAYOUT_WORDS:
        out = out.when(_has(classes, words), name)
    return out.when(index == 0, "header").when(index == total - 1, "footer").otherwise(F.concat(F.lit("section_"), index.cast("string")))


# Build tools and the patterns that are evidence of them, 60 points each.
BUILD_TOOLS = {"Webpack": ("webpack", "webpackJsonp", "__webpack"), "Vite": ("@vite/", "vite/"), "Parcel": ("parcelRequire",), "Rollup": ("rollup",)}


def evidence(text: Column, patterns: tuple[str, ...], weight: int = 60) -> Column:
    """Points of the patterns that a text has, 100 at most."""
    return F.least(sum((F.when(text.rlike(f"(?i){p}"), weight).otherwise(0) for p in patterns), F.lit(0)), F.lit(100))


def declarations(css: Column) -> Column:
    """A map of the declarations of a style attribute; parts without a colon drop out, the last of a property counts."""
    parts = F.filter(F.split(css, ";"), lambda p: p.contains(":"))
    pairs = F.transform(parts, lambda p: F.struct(F.trim(F.substring_index(p, ":", 1)).alias("k"), F.trim(F.substring(p, F.locate(":", p) + 1, F.char_length(p))).alias("v")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs) - i - 1, F.lit(0))), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(last)


def snake(name: Column) -> Column:
    """camelCase as lower-case words joined by underscores."""
    return F.replace(F.lower(F.regexp_replace(name, "([a-z])([A-Z])", "$1-$2")), F.lit("-"), F.lit("_"))


def color_hex(color: Column) -> Column:
    """#RRGGBB of an rgb() or rgba() colour; any other text as it is."""
    pattern = r"rgba?\(\s*(\d+)\s*,\s*(\d+)\s*,\s*(\d+)"
    part = lambda i: F.lpad(F.hex(F.regexp_extract(color, pattern, i).cast("int")), 2, "0")
    return F.when(color.rlike(pattern), F.concat(F.lit("#"), part(1), part(2), part(3))).otherwise(color)


def first_font(family: Column) -> Column:
    """The first of a font list, without quotes."""
    return F.trim(F.regexp_replace(F.substring_index(family, ",", 1), "['\"]", ""))


def is_transparent(color: Column) -> Column:
    """Whether a colour shows nothing."""
    return color.contains("rgba(0, 0, 0, 0)") | (color == "transparent")


def selector(tag: Column, id_: Column, classes: Column) -> Column:
    """#id, else the tag with its first class that starts with neither digit nor dash, else the tag."""
    fit = F.filter(classes, lambda c: ~c.rlike(r"^[\d-]") & (c != ""))
    return F.when(F.coalesce(id_, F.lit("")) != "", F.concat(F.lit("#"), id_)).when(F.size(fit) > 0, F.concat_ws(".", tag, F.get(fit, F.lit(0)))).otherwise(tag)


def full_selector(tag: Column, id_: Column, classes: Column) -> Column:
    """#id, else the tag in lower case with all its classes."""
    return F.when(F.coalesce(id_, F.lit("")) != "", F.concat(F.lit("#"), id_)).otherwise(F.concat_ws(".", F.lower(tag), F.filter(F.coalesce(classes, F.array().cast("array<string>")), lambda c: c != "")))


def short_selector(tag: Column, id_: Column, class_attribute: Column) -> Column:
    """#id, else the tag in lower case with what stands before the first space of the class attribute, which may be nothing; the tag alone without classes."""
    first = F.substring_index(class_attribute, " ", 1)
    return F.when(F.coalesce(id_, F.lit("")) != "", F.concat(F.lit("#"), id_)).when(F.coalesce(class_attribute, F.lit("")) != "", F.concat(F.lower(tag), F.lit("."), first)).otherwise(F.lower(tag))


def tagged_selector(tag: Column, id_: Column, classes: Column) -> Column:
    """The tag with its id, else with its first class."""
    return F.when(F.coalesce(id_, F.lit("")) != "", F.concat(tag, F.lit("#"), id_)).when(F.size(classes) > 0, F.concat(tag, F.lit("."), F.get(classes, F.lit(0)))).otherwise(tag)


# Style values that say nothing.
PLAIN_STYLES = ("", "none", "normal", "auto", "0px")


def sparse_styles(styles: Column) -> Column:
    """a map of styles without those that say nothing; names as lower-case words joined by underscores, float as float_."""
    named = F.transform_keys(F.map_filter(styles, lambda k, v: ~F.coalesce(v, F.lit("")).isin(*PLAIN_STYLES)), lambda k, v: snake(k))
    return F.transform_keys(named, lambda k, v: F.when(k == "float", "float_").otherwise(k))


# Tags and class words of elements that matter by themselves.
SEMANTIC_TAGS = ("header", "nav", "main", "section", "article", "aside", "footer")
TELLING_CLASSES = ("hero", "banner", "card", "container", "wrapper", "section")


def is_significant(tag: Column, id_: Column, classes: Column, width: Column, height: Column) -> Column:
    """whether an element of at least 50 by 30 has a semantic tag, a telling class or an id."""
    telling = F.exists(F.coalesce(classes, F.array().cast("array<string>")), lambda c: F.lower(c).rlike("|".join(TELLING_CLASSES)))
    return (width >= 50) & (height >= 30) & (F.lower(tag).isin(*SEMANTIC_TAGS) | telling | (F.coalesce(id_, F.lit("")) != ""))


def background_url(style: Column) -> Column:
    """The address in a background's url(), else null."""
    return F.nullif(F.regexp_extract(style, r"""url\(["']?([^"')]+)["']?\)""", 1), F.lit(""))


def fallback_selectors(selector: Column) -> Column:
    """X11: for #id itself; else the tag, and the tag with its first class, without what follows : or [, where that doesn't start with a digit."""
    tag, rest = F.split_part(selector, F.lit("."), F.lit(1)), F.split_part(selector, F.lit("."), F.lit(2))
    first = F.regexp_extract(rest, r"^([^:\[]*)", 1)
    some = F.array(F.nullif(tag, F.lit("")), F.when(first.rlike("^[^0-9]"), F.concat(tag, F.lit("."), first)))
    return F.when(selector.startswith("#"), F.array(selector)).otherwise(F.array_compact(some))


# Component types by tag, by words of the classes, by words of the id and by display, each in order.
TYPE_BY_TAG = {"header": "header", "nav": "navigation", "main": "section", "footer": "footer", "section": "section", "article": "section", "form": "form", "button": "button", "img": "image", "picture": "image", "svg": "image", "ul": "list", "ol": "list", "h1": "text", "h2": "text", "h3": "text", "h4": "text", "h5": "text", "h6": "text", "p": "text"}
TYPE_BY_CLASS = (("hero", "hero|banner"), ("card", "card"), ("navigation", "nav|menu"), ("header", "header"), ("footer", "footer"), ("button", "btn|button"), ("form", "form"))
TYPE_BY_ID = (("header", "header"), ("navigation", "nav"), ("footer", "footer"), ("hero", "hero"))
TYPE_BY_DISPLAY = (("grid", "^(inline-)?grid$"), ("flex", "^(inline-)?flex$"))
# Types of chunks by tag or by words of the classes, in order.
CHUNK_TYPES = (("button", ("button",), "btn|button"), ("form", ("form",), None), ("input", ("input", "textarea", "select"), None), ("card", (), "card"), ("modal", (), "modal|dialog"), ("dropdown", (), "dropdown|menu"), ("navigation", (), "nav"), ("tabs", (), "tab"), ("link", ("a",), None), ("image", ("img",), None))
# Classes that only lay out.
UTILITY = "^(w-|h-|p-|m-|flex|grid|text-|bg-|border-)"


def component_type(tag: Column, id_: Column, classes: Column, display: Column, children: Column) -> Column:
    """A component's type by its tag, else by its classes, its id, its display; a div with children is a container."""
    tag, words, id_ = F.lower(tag), F.lower(F.array_join(classes, " ")), F.lower(F.coalesce(id_, F.lit("")))
    out = F.when((tag == "a") & display.contains("inline"), "button")
    for t, kind in TYPE_BY_TAG.items():
        out = out.when(tag == t, kind)
    for value, rules in ((words, TYPE_BY_CLASS), (id_, TYPE_BY_ID), (display, TYPE_BY_DISPLAY)):
        for kind, pattern in rules:
            out = out.when(value.rlike(pattern), kind)
    return out.when((tag == "div") & (children > 0), "container").otherwise("other")


def chunk_type(tag: Column, classes: Column) -> Column:
    """The type of a component's chunk."""
    tag, words, out = F.lower(tag), F.lower(F.array_join(classes, " ")), F.when(F.lit(False), "")
    for kind, tags, pattern in CHUNK_TYPES:
        out = out.when(tag.isin(*tags) | (words.rlike(pattern) if pattern else F.lit(False)), kind)
    return out.otherwise("container")


def component_name(id_: Column, classes: Column, otherwise: Column) -> Column:
    """The id, else the first class that doesn't only lay out, as capitalised words; else another name as it is."""
    telling = F.get(F.filter(classes, lambda c: ~c.rlike(UTILITY)), F.lit(0))
    raw = F.coalesce(F.nullif(id_, F.lit("")), telling)
    return F.coalesce(F.initcap(F.lower(F.regexp_replace(F.regexp_replace(raw, "[-_]", " "), "([a-z])([A-Z])", "$1 $2"))), otherwise)


def layout_box(types: Column) -> Column:
    """A page's rows as boxes of 60, one below the other; the first ten of an array of types, null as none."""
    rule, title = F.lit("+" + "-" * 60 + "+"), F.lit("|" + " " * 20 + "PAGE LAYOUT" + " " * 29 + "|")
    row = lambda t: F.concat(F.lit("|"), F.rpad(F.concat(F.repeat(F.lit(" "), F.floor((58 - F.char_length(t)) / 2).cast("int")), F.upper(t)), 58, " "), F.lit("|"))
    shown = F.slice(F.coalesce(types, F.array().cast("array<string>")), 1, 10)
    return F.array_join(F.concat(F.array(rule, title, rule), F.flatten(F.transform(shown, lambda t: F.array(row(t), rule)))), "\n")


# Lengths from which media are cleaned and attributes dropped, players, and what stands in for a video.
MEDIA_LEAST, MEDIA_MOST = 50_000, 3
PLAYER = r"(?i)<video\b|<iframe\b[^>]*(?:youtube|vimeo|player)"
POSTER, YOUTUBE = r"""(?i)<video[^>]*\bposter=["']([^"']+)["']""", r"youtube\.com/(?:embed/|v/|watch\?v=)([a-zA-Z0-9_-]+)"
PLAY = '<div style="position:absolute;top:50%;left:50%;transform:translate(-50%,-50%);font-size:48px;color:#fff;">▶</div>'
STAND_IN = '\n  <!-- {comment} -->\n  <div class="{kind}-placeholder" style="position:relative;width:100%;max-width:640px;aspect-ratio:16/9;background:#000;">\n    <img src="{src}" alt="{alt}" style="width:100%;height:100%;object-fit:cover;" />\n    ' + PLAY + "\n  </div>"


def _stand_in(n: Column, src: Column, **words: str) -> Column:
    head, tail = STAND_IN.split("{src}")
    for k, v in words.items():
        head, tail = head.replace(f"{{{k}}}", v), tail.replace(f"{{{k}}}", v)
    return F.concat(F.replace(F.lit(head), F.lit("{n}"), n.cast("string")), src, F.lit(tail))


def clean_media(html: Column) -> Column:
    """Long HTML without scripts and very long data attributes; with players only the outer tag and stand-ins for the first videos are left. Shorter HTML, or null, as it is."""
    scripts = lambda c: F.regexp_replace(c, r"(?i)<script\b[^>]*>[\s\S]*?</script>", "")
    data = lambda c, least: F.regexp_replace(c, rf"""data-[a-z-]+=["'][^"']{{{least},}}["']""", "")
    first = lambda pattern: F.slice(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)), 1, MEDIA_MOST)
    outer = F.regexp_extract(html, r"(?i)^(\s*<(?:div|section|article)[^>]*>)", 1)
    posters = F.transform(first(POSTER), lambda u, i: _stand_in(i + 1, u, comment="Video placeholder {n}", kind="video", alt="Video poster"))
    tubes = F.transform(first(YOUTUBE), lambda v: _stand_in(F.lit(0), F.concat(F.lit("https://img.youtube.com/vi/"), v, F.lit("/maxresdefault.jpg")), comment="YouTube video placeholder", kind="youtube", alt="YouTube video thumbnail"))
    ends = F.when(outer != "", F.array(data(outer, 1000))), F.when(outer != "", F.array(F.concat(F.lit("</"), F.regexp_extract(outer, r"<(\w+)", 1), F.lit(">"))))
    none = F.array().cast("array<string>")
    parts = F.concat(F.coalesce(ends[0], none), posters, tubes, F.coalesce(ends[1], none))
    short = F.when(F.size(parts) > 0, F.array_join(parts, "\n")).otherwise(scripts(html))
    return F.when(F.char_length(html) < MEDIA_LEAST, html).when(html.rlike(PLAYER), short).otherwise(data(scripts(html), 10_000))


# Evidence of technologies: patterns of script addresses, global names, parts of data attributes, parts of classes; and the points for each of them by type.
TECHNOLOGIES = (
    ("React", "framework", (r"react\.production\.min\.js", r"react-dom\.production\.min\.js", "_reactRootContainer", "__REACT_DEVTOOLS"), ("React", "ReactDOM"), ("data-reactroot", "data-reactid"), ()),
    ("Vue", "framework", (r"vue\.js", r"vue\.min\.js", r"vue\.runtime"), ("Vue",), ("data-v-", "v-cloak"), ()),
    ("Angular", "framework", (r"angular\.js", r"angular\.min\.js", "ng-version"), ("angular", "ng"), ("ng-app", "ng-controller", "ng-version"), ()),
    ("Svelte", "framework", ("svelte", r"\.svelte-"), (), ("svelte-",), ()),
    ("Next.js", "framework", ("_next/static", "__NEXT_DATA__"), ("__NEXT_DATA__",), ("data-next-",), ()),
    ("Nuxt", "framework", ("_nuxt/", "__NUXT__"), ("__NUXT__",), (), ()),
    ("Gatsby", "framework", ("gatsby-", "___gatsby"), ("___gatsby",), (), ()),
    ("Bootstrap", "ui", (r"bootstrap\.css", r"bootstrap\.min\.css"), (), (), ("container", "row", "col-", "btn-")),
    ("Tailwind CSS", "ui", ("tailwind",), (), (), ("flex", "grid", "px-", "py-", "mt-", "mb-", "text-", "bg-")),
    ("Material-UI", "ui", ("@material-ui", "@mui"), (), (), ("MuiButton", "MuiBox", "MuiTypography")),
    ("Ant Design", "ui", ("antd",), (), (), ("ant-btn", "ant-card", "ant-form")),
    ("Element UI", "ui", ("element-ui",), (), (), ("el-button", "el-form", "el-input")),
    ("Chakra UI", "ui", ("@chakra-ui",), (), (), ("chakra-",)),
    ("jQuery", "utility", (r"jquery\.js", r"jquery\.min\.js"), ("jQuery", "$"), (), ()),
    ("Lodash", "utility", (r"lodash\.js", r"lodash\.min\.js"), ("_",), (), ()),
    ("Moment.js", "utility", (r"moment\.js", r"moment\.min\.js"), ("moment",), (), ()),
    ("Day.js", "utility", ("dayjs",), ("dayjs",), (), ()),
    ("Axios", "utility", (r"axios\.js", r"axios\.min\.js"), ("axios",), (), ()),
)
POINTS = {"framework": (30, 25, 20, 0), "ui": (40, 0, 0, 15), "utility": (40, 35, 0, 0)}
SURE = 50


def _one_contains(values: Column, part: str) -> Column:
    return F.exists(values, lambda x: x.contains(part))


def technologies(urls: Column, names: Column, attributes: Column, classes: Column) -> Column:
    """(name, type, confidence) of what a page's script addresses (as one text), global names, data attributes and classes (as arrays) are evidence of: points of each rule that fits, 50 or more, 100 at most. Nulls are no evidence."""
    words = F.array_join(classes, " ")
    out = []
    for name, kind, patterns, global_names, parts, looks in TECHNOLOGIES:
        a, b, c, d = POINTS[kind]
        rules = [(urls.rlike(f"(?i){p}"), a) for p in patterns] + [(F.array_contains(names, g), b) for g in global_names]
        rules += [(_one_contains(attributes, p), c) for p in parts] + [(words.contains(w), d) for w in looks]
        points = sum((F.when(hit, n).otherwise(0) for hit, n in rules), F.lit(0))
        out.append(F.struct(F.lit(name).alias("name"), F.lit("framework" if kind == "framework" else "library").alias("type"), F.least(points, F.lit(100)).alias("confidence")))
    return F.filter(F.array(*out), lambda t: t["confidence"] >= SURE)
