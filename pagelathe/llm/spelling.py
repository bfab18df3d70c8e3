"""Spelling variants: words one edit apart by bands of letter-parity masks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelathe.llm.common import cut, discard

#: Least code points and least occurrences of a word, and how many times a word's own occurrences its form has at least.
LENGTH, COUNT, TIMES = 7, 2, 10
BANDS = 3
#: Code points at either end, one of which an edit leaves alone in words of LENGTH.
ENDS = LENGTH // 2
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Fixed value: letters by their usual frequency in texts of Western languages, dealt to the bands in turn.
FREQUENT = "etaoinsrhldcumfpgwybvkxjqz"


def runs(docs: DataFrame) -> DataFrame:
    """(word) for each maximal run of letters that may count: lower-cased A-Z, with one code point deleted where the run's checksum says so.

    Null texts have none; a null doc_id counts as empty text.
    """
    run = F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(f"[A-Za-z\\u00C0-\\u00FF]{{{LENGTH},}}"), F.lit(0)))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), run.alias("run")).select("doc_id", F.translate("run", UPPER, LOWER).alias("run"))
    h = F.crc32(F.concat("doc_id", F.lit(":"), "run").cast("binary"))
    at = F.pmod(F.col("h"), F.length("run")).cast("int")
    word = F.when(F.col("h") % 31 == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))).otherwise(F.col("run"))
    return rows.withColumn("h", h).select(word.alias("word")).where(F.length("word") >= LENGTH)


def band_letters() -> list[str]:
    """The letters of each band: a to z by frequency, the others by code point, dealt in turn."""
    letters = FREQUENT + "".join(map(chr, range(0xC0, 0x100)))
    return [letters[b::BANDS] for b in range(BANDS)]


def parity(word: Column, letters: str) -> Column:
    """Bit k is set if letter k of the band stands in the word an odd number of times."""
    place = lambda x: F.instr(F.lit(letters), x)
    return F.aggregate(F.regexp_extract_all(word, F.lit("."), F.lit(0)), F.lit(0).cast("long"), lambda m, x: F.when(place(x) > 0, m.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), place(x) - 1))).otherwise(m))


def pairs(words: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b) for each pair of the distinct words (word, n) that one inserted, deleted or replaced code point makes equal, once.

    One edit flips at most two of the masks' bits, so one of three bands stays equal, and then near words have that
    band's letters in the same order; and as words have LENGTH code points or more, one of their ends stays as it is.
    So words meet by band, its letters, end and that end's letters. Of those that meet, masks that differ in more than
    two bits and lengths that differ by more than one are ruled out first; a pair counts where it meets first, and if
    the edit distance is one. Large groups are split by adaptive execution; letters beyond the bands' flip no bit and
    lose no pair.
    """
    bands = band_letters()
    every = "".join(bands)
    word = F.col("word")
    masked = words.select("word", "n", F.length("word").alias("size"), F.xxhash64("word").alias("h"), *(parity(word, x).alias(f"m{b}") for b, x in enumerate(bands)), F.left("word", F.lit(ENDS)).alias("head"), F.right("word", F.lit(ENDS)).alias("tail"))
    keys = [(e, b) for e in ("head", "tail") for b in range(BANDS)]
    order = [F.translate(word, "".join(c for c in every if c not in x), "") for x in bands]
    met = F.posexplode(F.array(*(F.xxhash64(F.lit(i), F.col(f"m{b}"), order[b], F.col(e)) for i, (e, b) in enumerate(keys))))
    rows = masked.select("*", met.alias("at", "key"))
    a, b = rows.select(*(F.col(c).alias(f"a_{c}") for c in rows.columns)), rows.select(*(F.col(c).alias(f"b_{c}") for c in rows.columns))
    same = [F.col(f"a_m{k}") == F.col(f"b_m{k}") for k in range(BANDS)]
    heads = F.col("a_head") == F.col("b_head")
    flips = sum((F.bit_count(F.col(f"a_m{k}").bitwiseXOR(F.col(f"b_m{k}"))) for k in range(BANDS)), F.lit(0))
    first = reduce(lambda x, i: x.when(F.col("a_at") == i, reduce(lambda p, q: p & q, [heads if keys[i][0] == "head" else ~heads, *(~same[j] for j in range(keys[i][1]))])), range(1, len(keys)), F.when(F.col("a_at") == 0, heads))
    # from the cheapest test to the dearest
    tests = [F.col("a_key") == F.col("b_key"), F.col("a_at") == F.col("b_at"), F.col("a_h") <= F.col("b_h"), flips <= 2, F.abs(F.col("a_size") - F.col("b_size")) <= 1, first, (F.col("a_h") < F.col("b_h")) | (F.col("a_word") < F.col("b_word")), F.levenshtein("a_word", "b_word", 1) == 1]
    return a.join(b, reduce(lambda x, y: x & y, tests)).select(F.col("a_word").alias("a"), F.col("a_n").alias("n_a"), F.col("b_word").alias("b"), F.col("b_n").alias("n_b"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the links (word, form): the last form that following them reaches. Each round doubles the way; links never lead back, as a form has TIMES the occurrences."""
    now = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        then = cut(now.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        discard(now)
        if then.where("moved").isEmpty():
            return then.select("word", "root")
        now = then


def variants(docs: DataFrame) -> DataFrame:
    """One row (word, form, root, n, n_near, form_n) for each distinct word of the documents (doc_id, text).

    Words are runs of letters as runs() makes them, of LENGTH code points or more, COUNT occurrences or more. n_near:
    the words one edit away. form: of these the one of most occurrences, then the first by code points, if it has at
    least TIMES the word's; else null. root: the last of forms of forms, the word itself if there is none.

    Texts are counted where they lie, so only distinct words are shuffled. Null and empty texts have no words; repeated
    rows count again; very long texts and words are taken whole; empty tables give no rows; other columns are not
    looked at.
    """
    words = cut(runs(docs).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= COUNT))
    links = pairs(words)
    both = links.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("m")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("m")))).alias("x")).select("x.*")
    near = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "near")).alias("best"))
    fits = -F.col("best.m") >= TIMES * F.col("n")
    out = cut(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("best.near")).alias("form"), F.when(fits, -F.col("best.m")).alias("form_n")))
    return out.join(roots(out.where("form IS NOT NULL")), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
