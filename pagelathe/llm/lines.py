"""Line dedup: a segment-partition edit join over the distinct lines, with DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WIDTH = 32
#: Edits within which two lines are near, and the characters of the shorter one that each edit needs.
EDITS, PER = 2, 12
#: Rows of a segment that are compared in one group; segments of more rows are dealt out as pairs of blocks.
BLOCK = 1024
#: Characters whose counts guard the join.
GUARDS = ("e", "a", "n", "t", "i", "o", "r", "s", "h", "d", "l", "m", "c", "y")


def _tie() -> Column:
    """What tells rows of one doc_id apart: a hash of the text."""
    return F.xxhash64(F.col("text").cast("string"))


def split_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, tie, line_no, line, line_id) of the lines that aren't blank. Lines end at line feeds; null texts have none."""
    lines = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _tie().alias("tie"), F.posexplode(F.split(F.col("text").cast("string"), "\n")).alias("line_no", "line"))
    # the test for null, which joins would put in anyway, makes all uses of the lines one plan, so that their exchange is one
    return lines.where(F.col("line").rlike(r"[^\x09-\x0D\x20]")).withColumn("line_id", F.unhex(F.md5(F.col("line").cast("binary")))).where("line_id IS NOT NULL")


def first_lines(lines: DataFrame) -> DataFrame:
    """The first row of each distinct line, by doc_id (null last), then tie, then line_no. The ranking starts before the shuffle, so a common line sends one row from each task."""
    w = Window.partitionBy("line_id").orderBy(F.col("doc_id").asc_nulls_last(), "tie", "line_no")
    return lines.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def allowed(n: Column, edits: int = EDITS, per: int = PER) -> Column:
    """Edits within which a line is near to a shorter one of n characters."""
    return F.least(F.lit(edits), F.floor(n / per).cast("int"))


def key_plan(edits: int) -> list[tuple[int, int, int]]:
    """(segment, less, shift): the substrings of a line to look up among the segments of lines `less` characters shorter.

    For each such length and segment only the starts that both the edits before it and those after it allow are needed;
    one of the segments that a near line shares must lie at one of them. (segment, 0, 0) are the line's own segments.
    """
    return [(i, less, d) for less in range(edits + 1) for i in range(edits + 1) for d in range(max(-i, less - (edits - i)), min(i, less + (edits - i)) + 1)]


def keys(first: DataFrame, edits: int = EDITS, per: int = PER) -> DataFrame:
    """(key, lid, own) of distinct lines: a key stands for the length, number and text of a segment, own marks a line's own ones.

    Lines are cut into one segment more than the edits that their length allows, and probe for lines of each shorter
    length by the plan for its edits. The plan's entries are exploded before the keys are made, so one short expression
    serves them all.
    """
    entry = lambda t, i, less, d: F.struct(F.lit(t).alias("t"), F.lit(i).alias("i"), F.lit(less).alias("less"), F.lit(d).alias("d"))
    plan = F.array(*(entry(t, *e) for t in range(1, edits + 1) for e in key_plan(t)))
    rows = first.select("line", F.xxhash64("line").alias("lid"), F.char_length("line").alias("n")).where(F.col("n") >= per).select("*", F.explode(plan).alias("p"))
    rows = rows.where(allowed(F.col("n") - F.col("p.less"), edits, per) == F.col("p.t"))
    rows = rows.select("line", "lid", "n", "p.t", "p.i", "p.d", F.expr("n - p.less").alias("m"), F.expr("(n - p.less) div (p.t + 1)").cast("int").alias("short"))
    # the last m - short * (t + 1) segments have one character more
    rows = rows.withColumn("wide", F.expr("t + 1 - (m - short * (t + 1))"))
    rows = rows.select("line", "lid", "n", "t", "i", "m", "d", F.expr("i * short + greatest(i - wide, 0) + 1 + d").alias("at"), F.expr("short + int(i >= wide)").alias("size"))
    rows = rows.where("at >= 1 AND at + size - 1 <= n")
    return rows.select(F.xxhash64("t", "m", "i", F.expr("substring(line, at, size)")).alias("key"), "lid", F.expr("d = 0 AND m = n").alias("own"))


def guard(line: Column) -> Column:
    """In a long the counts of GUARDS, each modulo 16, and above them the length modulo 128."""
    size = F.octet_length(line)
    out = F.shiftleft(F.char_length(line).bitwiseAND(F.lit(127)).cast("long"), 56)
    for k, c in enumerate(GUARDS):  # replace() looks for bytes; translate() would look up each character
        out = out.bitwiseOR(F.shiftleft((size - F.octet_length(F.replace(line, F.lit(c), F.lit("")))).bitwiseAND(F.lit(15)).cast("long"), 4 * k))
    return out


def _apart(a: Column, b: Column) -> Column:
    """The sum of the differences of counts and lengths, each the shorter way around its modulus, so at most the true one. An edit adds 2 at most: a substitution changes two counts, an insertion or deletion one count and the length."""

    def apart(shift: int, mask: int) -> Column:
        x, y = (F.shiftrightunsigned(c, shift).bitwiseAND(F.lit(mask)) for c in (a, b))
        return F.least((x - y).bitwiseAND(F.lit(mask)), (y - x).bitwiseAND(F.lit(mask)))

    return sum((apart(4 * k, 15) for k in range(len(GUARDS))), apart(56, 127))


def _let(value: Column, f) -> Column:
    """f of a value that is worked out once."""
    return F.transform(F.array(value), f)[0]


def banded_distance(a: Column, b: Column, edits: int) -> Column:
    """Edit distance of the strings a and b where it is at most `edits`, else a larger number; a is at least as long as b and as `edits`.

    One word holds the vertical differences of the band of 2 * edits + 1 diagonals; each character of b moves the band
    by one row and updates all of them with a few bit operations.
    """
    full = (1 << WIDTH) - 1
    mask, top = F.lit(full).cast("long"), WIDTH - 1
    first = F.lit(full ^ ((1 << (WIDTH - edits - 1)) - 1)).cast("long")
    start = F.struct(first.alias("vp"), F.lit(0).cast("long").alias("vn"), F.lit(edits).cast("long").alias("d"), F.lit(0).alias("j"))
    bits = lambda x, k: F.call_function("shiftrightunsigned", x, k)

    def step(env: Column, s: Column, c: Column) -> Column:
        p, j, vp, vn = env["p"], s["j"], s["vp"], s["vn"]
        eq = F.lit(0).cast("long")
        for o in range(-edits, edits + 1):
            eq = eq.bitwiseOR(F.when(F.get(p, j + o) == c, F.lit(1 << (top - edits + o)).cast("long")).otherwise(F.lit(0).cast("long")))
        moved = _let(eq, lambda e: _let((e.bitwiseAND(vp) + vp).bitwiseXOR(vp).bitwiseOR(e).bitwiseOR(vn).bitwiseAND(mask), lambda d0: after(env, s, d0)))
        # along the diagonal the score never falls, along the last row by `edits` at most: beyond twice that it stays too large
        return F.when(s["d"] > 2 * edits, s).otherwise(moved)

    def after(env: Column, s: Column, d0: Column) -> Column:
        j, vp, vn, over = s["j"], s["vp"], s["vn"], s["j"] - (env["n"] - edits)
        hp = vn.bitwiseOR(d0.bitwiseOR(vp).bitwiseXOR(mask))
        hn = d0.bitwiseAND(vp)
        x = bits(d0, F.lit(1))
        # the score follows the lowest diagonal until it meets the end of the longer string, then that string's last row
        row = F.greatest(F.lit(top - 1) - over, F.lit(0))
        along = bits(hp, row).bitwiseAND(F.lit(1)) - bits(hn, row).bitwiseAND(F.lit(1))
        d = s["d"] + F.when(over < 0, F.lit(1) - bits(d0, F.lit(top)).bitwiseAND(F.lit(1))).otherwise(along)
        return F.struct(hn.bitwiseOR(x.bitwiseOR(hp).bitwiseXOR(mask)).alias("vp"), x.bitwiseAND(hp).alias("vn"), d.alias("d"), (j + 1).alias("j"))

    # the longer string's characters are bound once: within the fold's lambda they would be split again at each step
    def fold(long_: Column, short: Column) -> Column:
        env = F.struct(F.split(long_, "").alias("p"), F.char_length(long_).alias("n"))
        return _let(env, lambda e: F.aggregate(F.split(short, ""), start, lambda s, c: step(e, s, c), lambda s: s["d"]))

    found = _let(_core(F.struct(a.alias("a"), b.alias("b")), edits), lambda c: fold(c["a"], c["b"]))
    return F.when(F.char_length(a) - F.char_length(b) <= edits, found).otherwise(F.lit(edits + 1).cast("long"))


def _core(pair: Column, spare: int) -> Column:
    """A struct of two strings a and b without what they share at the start, but for `spare` characters, and at the end: by halving steps, so a few comparisons of parts settle each side. The distance stays the same."""
    steps = F.array(*(F.lit(1 << k) for k in range(15, -1, -1)))

    def shared(x: Column, part) -> Column:
        most = F.least(F.char_length(x["a"]), F.char_length(x["b"]))
        return F.aggregate(steps, F.lit(0), lambda n, k: F.when((n + k <= most) & (part(x["a"], n + k) == part(x["b"], n + k)), n + k).otherwise(n))

    def without_start(x: Column) -> Column:
        return _let(F.greatest(shared(x, F.left) - spare, F.lit(0)), lambda n: F.struct(*(F.substring(x[c], n + 1, F.char_length(x[c])).alias(c) for c in "ab")))

    def without_end(x: Column) -> Column:
        rest = _let(F.struct(*(F.substring(x[c], F.lit(spare + 1), F.char_length(x[c])).alias(c) for c in "ab")), lambda r: shared(r, F.right))
        return _let(rest, lambda n: F.struct(*(F.left(x[c], F.char_length(x[c]) - n).alias(c) for c in "ab")))

    return _let(pair, lambda x: _let(without_start(x), without_end))


def _place() -> Column:
    """A line's place, which orders lines: doc_id (null last), tie, line_no."""
    return F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc"), "tie", F.col("line_no").alias("line"))


def _pairs(met: DataFrame, edits: int, block: int) -> DataFrame:
    """(a, b): the ids, each pair once, of rows (key, line_id, own, rows, guard) that share a key, one of them its own, and whose counts differ by no more than the edits explain.

    Keys that more than `block` rows bear are dealt out as pairs of blocks, so no group that is compared holds more
    than two blocks.
    """
    met = met.withColumn("parts", F.ceil(F.col("rows") / block)).withColumn("part", F.pmod(F.xxhash64("line_id"), F.col("parts")))
    others = F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)
    # a line's own segments are an index entry, and are looked up too, for lines of the same length
    looks = F.transform(others, lambda o: F.struct(F.lit(False).alias("entry"), o.alias("p"), F.col("part").alias("q")))
    entries = F.transform(others, lambda o: F.struct(F.lit(True).alias("entry"), F.col("part").alias("p"), o.alias("q")))
    sides = met.select("key", "line_id", "guard", F.explode(F.when(F.col("own"), F.concat(looks, entries)).otherwise(looks)).alias("s"))
    sides = sides.select("key", "s.p", "s.q", "s.entry", F.struct("line_id", "guard").alias("x")).repartition("key", "p", "q")
    groups = sides.groupBy("key", "p", "q").agg(F.collect_set(F.when(F.col("entry"), F.col("x"))).alias("l"), F.collect_set(F.when(~F.col("entry"), F.col("x"))).alias("r"))
    pairs = groups.select(F.explode("l").alias("one"), "r")
    near = F.filter("r", lambda y: (y["line_id"] != F.col("one")["line_id"]) & (_apart(F.col("one")["guard"], y["guard"]) <= 2 * edits))
    pairs = pairs.select(F.col("one")["line_id"].alias("x"), F.explode(F.transform(near, lambda y: y["line_id"])).alias("y"))
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def near_links(first: DataFrame, edits: int = EDITS, per: int = PER, block: int = BLOCK) -> DataFrame:
    """(line_id, place): for each two distinct lines that are near, a row with the id of each and the place of the other.

    Few segments are borne by two lines: the others go before anything is joined, and only the texts of lines with a
    shared segment are taken up again. Hashes of segments and lines only bring lines together; counts of letters drop
    most pairs, and the bit-parallel distance of the texts settles which are near.
    """
    w = Window.partitionBy("key")
    met = keys(first, edits, per).withColumns({"rows": F.count("*").over(w), "owned": F.max("own").over(w)}).where("rows > 1 AND owned")
    met = met.groupBy("lid").agg(F.collect_set(F.struct("key", "own", "rows")).alias("met"))
    met = first.select(F.xxhash64("line").alias("lid"), "line_id").join(met, "lid").select("line_id", "met")
    met = first.select("line_id", "line").join(met, "line_id").select("line_id", guard(F.col("line")).alias("guard"), F.explode("met").alias("m"))
    pairs = _pairs(met.select("line_id", "guard", "m.*"), edits, block)
    ends = pairs.select(F.explode(F.array("a", "b")).alias("line_id"), "a", "b").join(first.select("line_id", F.struct("line_id", "line", _place().alias("place")).alias("x")), "line_id")
    both = ends.groupBy("a", "b").agg(F.max(F.when(F.col("line_id") == F.col("a"), F.col("x"))).alias("one"), F.max(F.when(F.col("line_id") == F.col("b"), F.col("x"))).alias("two"))
    swap = F.char_length("one.line") < F.char_length("two.line")
    both = both.select(F.when(swap, F.col("two")).otherwise(F.col("one")).alias("long"), F.when(swap, F.col("one")).otherwise(F.col("two")).alias("short"))
    both = both.where(banded_distance(F.col("long.line"), F.col("short.line"), edits) <= allowed(F.char_length("short.line"), edits, per))
    side = lambda x, y: F.struct(F.col(x)["line_id"].alias("line_id"), F.col(y)["place"].alias("place"))
    return both.select(F.explode(F.array(side("long", "short"), side("short", "long"))).alias("s")).select("s.*")


def _common(lines: DataFrame, most: int = 1000, one_in: int = 64, spread: int = 32) -> DataFrame:
    """(line_id, salts): up to `most` lines that are frequent in a part of the documents; their rows are spread over tasks. Which lines are here changes no result."""
    part = lines.where(F.pmod(F.xxhash64("doc_id", "tie"), F.lit(one_in)) == 0).groupBy("line_id").count().where("count >= 16")
    return part.orderBy(F.desc("count"), "line_id").limit(most).select("line_id", F.sequence(F.lit(0), F.lit(spread - 1)).alias("salts"))


def _placed(lines: DataFrame, edits: int, per: int, block: int) -> DataFrame:
    """lines without their text, with own and best (the places where its line, and where that or a near one, first comes), n_links, n_chars and salt."""
    first = first_lines(lines)
    near = near_links(first, edits, per, block).groupBy("line_id").agg(F.count("*").alias("n_links"), F.min("place").alias("near"))
    common = F.broadcast(_common(lines))
    # the length of the line is taken and looked at here, so that this use of the first lines reads the exchange of the others
    of = first.select("line_id", _place().alias("own"), F.char_length("line").cast("long").alias("n_chars")).where("n_chars > 0").join(near, "line_id", "left")
    best = F.when(F.col("near") < F.col("own"), F.col("near")).otherwise(F.col("own"))
    of = of.select("line_id", "own", "n_chars", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), best.alias("best"))
    of = of.join(common, "line_id", "left").select("*", F.explode(F.coalesce("salts", F.array(F.lit(0)))).alias("salt")).drop("salts")
    rows = lines.select("doc_id", "tie", "line_no", "line_id").join(common, "line_id", "left")
    salt = F.when(F.col("salts").isNull(), 0).otherwise(F.pmod(F.xxhash64("doc_id", "tie", "line_no"), F.size("salts")).cast("int"))
    return rows.select("doc_id", "tie", "line_no", "line_id", salt.alias("salt")).join(of, ["line_id", "salt"])


def classes(docs: DataFrame, edits: int = EDITS, per: int = PER, block: int = BLOCK) -> DataFrame:
    """One row per line that isn't blank: doc_id, line_no, n_chars, first_doc, first_line, n_links, kept.

    Equal lines are one line, which comes first at first_doc, first_line, or, if a near line comes first earlier, at the
    earliest such line's place. Two lines are near within `edits` edits, and one for each `per` characters of the
    shorter one at most, so lines of under `per` characters have no near ones. n_links: other distinct lines near this
    one. kept: this row is where its line first comes, and no near line first comes before. Null and empty texts have
    no such lines; a null doc_id comes last; rows that share a doc_id go by a hash of their texts; of rows that repeat
    doc_id and text one has what is kept; an empty table gives an empty result; long lines are taken whole; other
    columns play no part.
    """
    out = _placed(split_lines(docs), edits, per, block)
    again = Window.partitionBy("line_id", "salt", "doc_id", "tie", "line_no").orderBy("line_id")
    kept = _place().eqNullSafe(F.col("best")) & (F.row_number().over(again) == 1)
    return out.select("doc_id", "line_no", "n_chars", F.col("best")["doc"].alias("first_doc"), F.col("best")["line"].alias("first_line"), "n_links", kept.alias("kept"))


def dedup(docs: DataFrame, edits: int = EDITS, per: int = PER, block: int = BLOCK) -> DataFrame:
    """`docs` without the lines that equal or are near to one that comes before, as classes() has it, blank ones aside; n_chars follows the text.

    A document that loses lines and has no other than blank ones left goes; all others stay, those with null or empty
    text too. Rows are told apart by doc_id and text, so rows that share a doc_id, or have none, lose their own repeats
    alone; rows that repeat both tie, and keep the same lines. An empty table gives an empty one; other columns stay as
    they are.
    """
    gone = _placed(split_lines(docs), edits, per, block).where(~_place().eqNullSafe(F.col("best"))).groupBy("doc_id", "tie").agg(F.collect_set("line_no").alias("gone"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("doc"), _tie().alias("tie"))
    rows = rows.join(gone.withColumnsRenamed({"doc_id": "_doc", "tie": "_tie"}), F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("tie") == F.col("_tie")), "left")
    left = F.array_join(F.filter(F.split(F.col("row")["text"].cast("string"), "\n"), lambda line, k: ~F.array_contains("gone", k)), "\n")
    rows = rows.select("row", F.when(F.col("gone").isNotNull(), left).alias("left")).where(F.col("left").isNull() | F.col("left").rlike(r"[^\x09-\x0D\x20]"))
    new = {"text": F.col("left"), "n_chars": F.char_length("left").cast("long")}
    return rows.select(*(F.when(F.col("left").isNull(), F.col("row")[c]).otherwise(new[c]).alias(c) if c in new else F.col("row")[c].alias(c) for c in docs.columns))
