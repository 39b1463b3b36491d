"""Spelling variants: words one edit apart, found by asymmetric q-chunks.

Of two words one edit apart the shorter (or either, when equally long) is cut into two disjoint chunks, its halves. The
other contributes the positional grams of the chunks' lengths at the chunks' places and, when it is one longer, one place
further: the shift that one edit can cause (grams at other places could not join). One edit spoils one chunk at most,
so the other chunk is a gram of the other word there, and the two words meet in its bucket. What is left open is the
window of the word that the chunk does not cover.

A chunk that very many words share would pair them all. Such a bucket is cut again: the open windows of its words are
halved in the same way and the key is all that lies outside, so the next buckets hold words that agree on three quarters,
then on seven eighths, until one code point is open. That bounds a bucket by the alphabet, every pair is still met, and no
partner is dropped. A bucket is joined once it has at most ``PAIRS`` pairs or one open code point.

A pair is verified in its bucket by the edit distance of the open windows, and counted only in the bucket whose window
holds the end of the common beginning. There is one such bucket, so no pair is counted twice and nothing is shuffled to
find repeats.

Defined results: a null or empty text has no words; a null ``doc_id`` counts as the empty text in the typing-error hash;
repeated rows count each; columns other than ``doc_id`` and the text are not read; an empty table gives an empty result.
Words of any length are whole. Ties of frequency go to the smaller word in code-point order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.stage import again, drop, stage

LETTERS = "A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LETTERS = 7
LEAST_COUNT = 2
FORM_RATIO = 10
ERROR_RATE = 31
PAIRS = 512
_WINDOW = ["length", "a", "b"]


def with_typing_errors(doc_id: Column, word: Column, rate: int = ERROR_RATE) -> Column:
    """``word`` without one code point where ``rate`` divides the CRC-32 of ``<doc_id>:<word>``."""
    crc = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), word))
    place = F.pmod(crc, F.length(word)).cast("int")
    return F.when(F.pmod(crc, F.lit(rate)) == 0, F.concat(F.substring(word, F.lit(1), place), F.substring(word, place + 2, F.length(word)))).otherwise(word)


def vocabulary(docs: DataFrame, text: str = "text", least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, errors: int = ERROR_RATE) -> DataFrame:
    """(word, n): the letter runs of all texts, with typing errors planted by the hash, as often as they occur."""
    # Shorter runs can't become long enough, as an error only deletes.
    runs = docs.select(F.col("doc_id").alias("id"), F.explode(F.regexp_extract_all(F.col(text), F.lit(f"[{LETTERS}]{{{least_letters},}}"), F.lit(0))).alias("run"))
    words = runs.select("id", F.translate("run", UPPER, LOWER).alias("run")).select(with_typing_errors(F.col("id"), F.col("run"), errors).alias("word"))
    counted = words.filter(F.length("word") >= least_letters).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.filter(F.col("n") >= least_count)


def _outside() -> Column:
    """What lies outside the open window; in a word one longer than its partner the window is one longer too."""
    return F.concat(F.substring("word", F.lit(1), F.col("a")), F.lit("\n"), F.substring("word", F.col("b") + F.col("shift") + 1, F.length("word")))


def _halved(rows: DataFrame) -> DataFrame:
    """Every row with either half of its window open, and the key of what is not."""
    middle = F.col("a") + F.floor((F.col("b") - F.col("a")) / 2).cast("int")
    halves = F.array(F.struct(F.col("a"), middle.alias("b")), F.struct(middle.alias("a"), F.col("b")))
    cut = rows.select("word", "n", "shift", "length", F.explode(halves).alias("w")).select("word", "n", "shift", "length", "w.a", "w.b")
    return cut.withColumn("key", F.xxhash64(*_WINDOW, _outside()))


def _near(buckets: DataFrame) -> DataFrame:
    """Verified pairs (word, other, n, other_n) of the rows of finished buckets."""
    short = buckets.filter("shift = 0").select("key", *_WINDOW, "word", "n")
    other = buckets.select("key", *_WINDOW, F.col("word").alias("other"), F.col("n").alias("other_n"), "shift")
    met = short.join(other, ["key", *_WINDOW]).filter("shift = 1 OR word < other")
    part = lambda word, a, n: F.substring(word, a + 1, n)
    a, b, size = F.col("a"), F.col("b"), F.col("b") - F.col("a")
    same_outside = (part("word", F.lit(0), a) == part("other", F.lit(0), a)) & (
        part("word", b, F.col("length")) == part("other", b + F.col("shift"), F.col("length")))  # the key is only a hash
    one_edit = F.levenshtein(part("word", a, size), part("other", a, size + F.col("shift")), 1) == 1
    here = (b == F.col("length")) | (part("word", F.lit(0), b) != part("other", F.lit(0), b))
    return met.filter(same_outside & here & one_edit).select("word", "other", "n", "other_n")


def near_pairs(words: DataFrame, pairs: int = PAIRS) -> DataFrame:
    """All unordered pairs of distinct words (word, n) that differ by exactly one edit, each once."""
    whole = F.length("word")
    shifts = F.array(F.struct(F.lit(0).alias("shift"), whole.alias("length")), F.struct(F.lit(1).alias("shift"), (whole - 1).alias("length")))
    rows = words.select("word", "n", F.explode(shifts).alias("s")).select("word", "n", "s.*").filter("length > 0")
    rows = rows.select("*", F.lit(0).alias("a"), F.col("length").alias("b"))
    found = None
    while True:
        cut = stage(_halved(rows))
        sizes = cut.groupBy("key").agg(F.count_if(F.col("shift") == 0).alias("short"), F.count(F.lit(1)).alias("all"), F.max(F.col("b") - F.col("a")).alias("open"))
        sizes = stage(sizes.filter("short > 0 AND `all` > 1").select("key", ((F.col("short") * F.col("all") > pairs) & (F.col("open") > 1)).alias("crowded")))
        usual = _near(cut.join(sizes.filter("NOT crowded"), "key", "left_semi"))
        found = stage(usual) if found is None else stage(found.unionByName(usual))
        if sizes.filter("crowded").isEmpty():
            return found
        rows = stage(again(cut).join(again(sizes).filter("crowded"), "key", "left_semi").filter("b - a > 1").drop("key"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for words with a form (word, form): the last word that forms lead to.

    A form is at least ``FORM_RATIO`` times as frequent as its word, so a chain is as long as the logarithm of the
    largest count, and every round doubles the steps taken.
    """
    now = stage(forms.select("word", F.col("form").alias("root")))
    while True:
        step = again(now).select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = stage(now.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        ended = after.filter("moved").isEmpty()
        drop(now)
        now = after
        if ended:
            return now.select("word", "root")


def variants(
    docs: DataFrame, text: str = "text", least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, ratio: int = FORM_RATIO,
    errors: int = ERROR_RATE, pairs: int = PAIRS,
) -> DataFrame:
    """(word, form, root, n, n_near, form_n), one row per word."""
    words = stage(vocabulary(docs, text, least_letters, least_count, errors))
    near = near_pairs(words, pairs)
    both = F.array(
        F.struct("word", "n", F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("word")).alias("to")),
        F.struct(F.col("other").alias("word"), F.col("other_n").alias("n"), F.struct((-F.col("n")).alias("n"), F.col("word")).alias("to")),
    )
    directed = near.select(F.explode(both).alias("e")).select("e.word", "e.n", "e.to")
    best = directed.groupBy("word").agg(F.first("n").alias("n"), F.count(F.lit(1)).alias("n_near"), F.min("to").alias("to"))
    accepted = -F.col("to.n") >= ratio * F.col("n")
    best = stage(best.select("word", "n_near", F.when(accepted, F.col("to.word")).alias("form"), F.when(accepted, -F.col("to.n")).alias("form_n")))
    rooted = roots(best.filter("form IS NOT NULL"))
    out = words.join(again(best), "word", "left").join(rooted, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")
