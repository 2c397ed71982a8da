"""Line-first quality rules: lines are judged and removed first, then documents that lose too much text.

Everything is a column expression over one row, so a text of any length is judged where it lies and nothing is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from airzone.llm.common import BLANKS, let, only, words

#: Fixed phrases of licence, cookie and navigation boilerplate, in lower case.
BOILERPLATE = (
    "all rights reserved", "licensed under", "released under the", "terms of use", "terms of service", "privacy policy",
    "cookie policy", "use cookies", "enable javascript", "javascript is disabled", "click here", "subscribe to our",
    "sign up for", "share this", "follow us on", "powered by", "lorem ipsum", "skip to content", "back to top", "read more",
)
SYMBOLS = "[#*$%&|<>]"
END_MARKS = tuple(".!?…:;\"'»”)]")


@dataclass(frozen=True)
class Limits:
    """Shares are per cent. A line fails by symbols or exclamation marks per word, by separators per word, by few
    distinct words where words are said three times in a row, or by a boilerplate phrase in a line of few words. A line
    without an end mark fails only if it is short, so unfinished sentences stay. A document may lose ``lost`` per cent of its words' characters."""

    min_words: int = 20
    window: int = 8
    repeated: int = 30
    symbols: int = 40
    separators: int = 20
    shout: int = 50
    distinct: int = 40
    one_word_from: int = 10
    phrase_words: int = 25
    fragment_words: int = 3
    lost: int = 60


def repeat_words(tokens: Column, window: int) -> Column:
    """Words inside windows of ``window`` words that occur twice or more in the text, the first occurrence included.

    Window hashes are built by doubling: of 1, 2, 4 words and so on, which is why ``window`` is a power of two. Most
    texts have no repeated window, which one distinct count tells; only the others sort their windows by hash. A
    window's 64-bit hash stands for its words: two different windows of one text meet once in about 10**11 texts
    of 20,000 words.
    """
    if window & (window - 1) or window < 2:
        raise ValueError("window must be a power of two")

    def widened(hashes: Column, step: int, to: int = window) -> Column:
        if step == to:
            return hashes
        pairs = let(hashes, lambda h: F.zip_with(
            F.slice(h, 1, F.greatest(F.size(h) - step, F.lit(0))), F.slice(h, step + 1, F.greatest(F.size(h) - step, F.lit(0))),
            lambda a, b: F.xxhash64(a, b)))
        return widened(pairs, 2 * step, to)

    def covered(hashes: Column) -> Column:
        placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        # a window repeats if its neighbour in hash order is equal
        repeated = let(placed, lambda s: F.filter(F.zip_with(
            s, F.zip_with(F.concat(F.array(F.lit(None).cast("struct<h:bigint,i:int>")), F.slice(s, 1, F.size(s) - 1)),
                          F.concat(F.slice(s, 2, F.size(s)), F.array(F.lit(None).cast("struct<h:bigint,i:int>"))),
                          lambda before, after: F.struct(before["h"].alias("b"), after["h"].alias("a"))),
            lambda own, beside: F.when(own["h"].eqNullSafe(beside["b"]) | own["h"].eqNullSafe(beside["a"]), own["i"])),
            lambda i: i.isNotNull()))
        return let(F.array_sort(repeated), lambda p: F.aggregate(
            F.zip_with(p, F.slice(p, 2, F.size(p)), lambda a, b: F.coalesce(F.least(b - a, F.lit(window)), F.lit(window))),
            F.lit(0), lambda total, step: total + step))

    def distinct(hashes: Column) -> Column:
        return F.size(hashes) == F.size(F.array_distinct(hashes))

    def counted(hashes: Column, done: int) -> Column:
        """No repeated window, if none of half its words repeats; long ones are built only where short ones do."""
        longer = covered(hashes) if done == window else let(widened(hashes, done), lambda h: F.when(distinct(h), F.lit(0)).otherwise(covered(h)))
        return F.when(distinct(hashes), F.lit(0)).otherwise(longer)

    half = max(window // 2, 1)
    return let(widened(F.transform(tokens, lambda w: F.xxhash64(w)), 1, half), lambda h: counted(h, half)).cast("long")


def line_fails(line: Column, limits: Limits) -> Column:
    """Whether a line with a word breaks a rule. Its words are counted as its inner spaces plus one.

    Cheap tests guard the dear ones: most lines hold none of the marks, are long, and repeat no word at once.
    """
    def judged(trimmed: Column) -> Column:
        n = F.length(trimmed) - F.length(F.replace(trimmed, F.lit(" "), F.lit(""))) + 1
        last = F.substring(trimmed, -1, 1)
        symbols, shouts = F.regexp_count(trimmed, F.lit(r"[#*$%&<>]+")), F.regexp_count(trimmed, F.lit("!!+"))
        navigation = F.regexp_count(trimmed, F.lit(r"[|»›•]|\s[>/](?=\s)"))
        marks = trimmed.rlike(r"[#*$%&<>|»›•!/]") & let(n, lambda n: (
            (100 * symbols > limits.symbols * n) | (100 * shouts > limits.shout * n)
            | ((100 * navigation > limits.separators * n) & (navigation > 1))))
        phrase = (n <= limits.phrase_words) & F.lower(trimmed).rlike("|".join(BOILERPLATE))
        crowded = trimmed.rlike(r"(?<!\S)(\S++)\s++\1\s++\1(?!\S)") & let(words(trimmed), lambda w: (
            (F.size(w) >= limits.one_word_from) & (100 * F.size(F.array_distinct(w)) < limits.distinct * F.size(w))))
        fragment = ~last.isin(*END_MARKS) & (F.length(trimmed) < 20) & (n <= limits.fragment_words)
        return marks | phrase | crowded | fragment

    return let(F.btrim(line, F.lit(BLANKS)), judged)


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limits: Limits = Limits()) -> DataFrame:
    """The columns of ``docs`` named by ``id_col`` and ``text_col`` as doc_id and text, with counts, verdict and cleaned text.

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_lines, n_lines_failed, lost_chars
    and cleaned. Words are separated by \\x20 and \\x09-\\x0D, lines by \\n. A document with few words or many repeated
    windows fails at once; of the others the failing lines are removed, and those that lose more than ``limits.lost`` per
    cent of their word characters are rejected.

    Null text counts as empty: it has no words, fails, and its cleaned text stays null. Lines without a word are neither
    judged nor removed. Ids are only passed on, so nulls and repeats do not matter; an empty table gives no row.
    """
    docs = only(docs, doc_id=id_col, text=text_col)
    text = F.coalesce("text", F.lit(""))
    has_word = lambda line: line.rlike(r"\S")
    counted = docs.select(
        "doc_id", "text",
        let(words(F.col("text")), lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeat_words(w, limits.window).alias("n_repeat_words"))).alias("c"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        let(F.split(text, "\n"), lambda lines: let(F.filter(lines, has_word), lambda full: F.struct(
            F.size(full).alias("n_lines"), (F.size(full) - F.size(F.array_distinct(full))).cast("long").alias("n_dup_lines"),
            F.size(lines).alias("all_lines"), F.filter(lines, lambda x: ~(has_word(x) & line_fails(x, limits))).alias("left")))).alias("l"))
    measured = counted.select(
        "doc_id", "text", "c.n_words", "c.word_chars", "n_symbols", "l.n_dup_lines", "c.n_repeat_words",
        ((F.col("c.n_words") < limits.min_words) | (100 * F.col("c.n_repeat_words") > limits.repeated * F.col("c.n_words"))).alias("base_failed"),
        "l.n_lines", (F.col("l.all_lines") - F.size("l.left")).alias("n_lines_failed"),
        F.when(F.col("l.all_lines") == F.size("l.left"), text).otherwise(F.array_join("l.left", "\n")).alias("rest"))
    rest = F.length(F.array_join(words(F.col("rest")), ""))
    lost = F.when(F.col("n_lines_failed") == 0, F.lit(0)).otherwise(F.col("word_chars") - rest)
    return (measured.withColumn("lost_chars", lost.cast("long"))
            .withColumn("kept", ~F.col("base_failed") & (100 * F.col("lost_chars") <= limits.lost * F.col("word_chars")))
            .withColumn("cleaned", F.when(F.col("text").isNotNull(), F.col("rest"))).drop("rest"))
