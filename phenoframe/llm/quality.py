"""Line-first quality rules.

Every line of a document is held against three rules; lines that fail one
are removed, and a document that loses too much of its text by that (or
fails the base rules on length and repetition) is rejected.

* punctuation: the line has no closing mark at its end, or a tenth of its
  characters are noise (symbols and exclamation marks);
* navigation: a row of short entries between menu separators;
* boilerplate: short lines with a licence, cookie, sign-in or similar
  stock phrase.

Lines without a word are neither judged nor counted; they stay.

Defined results: NULL text counts as empty; a document without words has
zero counts, fails the base rules and is not kept; repeated rows are judged
one by one; other columns are carried through untouched.

Equal 3-word windows are found by their 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phenoframe.llm.text import BLANKS, own, words

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A document is rejected when it loses more than this share of its words' characters.
MAX_LOSS_PERCENT = 50

# Characters counted as symbols, and the patterns of the line rules.
SYMBOLS = "#*$%&|<>"
CLOSING = r"[.!?:;\x{2026}\x{3002}\x{FF01}\x{FF1F}][\"'\x{201D}\x{2019}\x{00BB})\]]*$"
NOISE = "#*$%&<>!"
SEPARATORS = "|\u00bb\u203a\u00b7\u2022"
STOCK_PHRASES = ("all rights reserved", "licensed under", "released under the", "this work is licensed", "cookie policy", "privacy policy",
                 "terms of use", "terms of service", "enable javascript", "sign in to", "log in to", "click here", "lorem ipsum")
STOCK = "(" + "|".join(STOCK_PHRASES) + ")"
#: A stock phrase marks lines of up to this many characters; in a longer one it is part of a sentence.
STOCK_LINE_CHARS = 200


def length_without(text: Column, characters: str) -> Column:
    return F.length(F.translate(text, characters, ""))


def line_fails(line: Column) -> Column:
    """True when a line with words breaks a rule."""
    length = F.length(line)
    unclosed = ~F.substring(F.rtrim(line, F.lit(BLANKS)), -6, 6).rlike(CLOSING)
    marked = line.rlike("[" + NOISE + SEPARATORS + "]")  # few lines are counted character by character
    noisy = marked & ((length - length_without(line, NOISE)) * 10 >= length)
    separators = length - length_without(line, SEPARATORS)
    navigation = marked & (separators >= 2) & (separators * 30 >= length)
    stock = (length <= STOCK_LINE_CHARS) & F.lower(line).rlike(STOCK)
    return unclosed | noisy | navigation | stock


def has_word(line: Column) -> Column:
    return F.length(F.trim(line, F.lit(BLANKS))) > 0


def repeated_positions(windows: Column) -> Column:
    """Positions of (hash, position) pairs, sorted by hash, whose hash a neighbour shares; in ascending order."""
    def shared(x: Column, i: Column) -> Column:
        before, after = (F.coalesce(F.get(windows, i + step)["h"] == x["h"], F.lit(False)) for step in (-1, 1))
        return before | after
    return F.sort_array(F.transform(F.filter(windows, shared), lambda x: x["i"]))


def covered_words(positions: Column) -> Column:
    """Words that 3-word windows at these ascending positions cover: three each, less what the next one covers too."""
    steps = F.transform(positions, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(positions, i + 1) - x, F.lit(3))))
    return F.coalesce(F.aggregate(steps, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long")


FEW = 32


def with_counts(docs: DataFrame) -> DataFrame:
    """``docs`` with the base counts and the verdict of the base rules."""
    text = F.coalesce(F.col("text"), F.lit(""))
    w, h, d, m, s, lines = (own(docs, x) for x in ("words", "windows", "doubles", "ordered", "positions", "lines"))
    out = docs.withColumn(w, words(F.col("text")))
    out = (out.withColumn("n_words", F.size(w).cast("long"))
           .withColumn("word_chars", F.length(F.array_join(w, "")).cast("long"))
           .withColumn("n_symbols", F.when(text.rlike("[" + SYMBOLS + "]"), F.length(text) - length_without(text, SYMBOLS)).otherwise(0).cast("long"))
           .withColumn(lines, F.filter(F.split(text, "\n"), has_word))
           .withColumn("n_dup_lines", (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"))
           .withColumn(h, F.when(F.size(w) >= 3, F.transform(
               F.sequence(F.lit(0), F.size(w) - 3),
               lambda i: F.xxhash64(F.get(F.col(w), i), F.get(F.col(w), i + 1), F.get(F.col(w), i + 2))))))
    out = out.withColumn(d, F.when(F.size(F.array_distinct(h)) < F.size(h), F.sort_array(h)))
    out = out.withColumn(d, F.array_distinct(F.filter(d, lambda x, i: F.coalesce(x == F.get(F.col(d), i + 1), F.lit(False)))))
    # Up to FEW repeated hashes are looked up in the list, with more all windows are sorted; the positions are the same.
    out = out.withColumn(m, F.when(F.size(d) > FEW, F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    few = F.filter(F.transform(h, lambda x, i: F.when(F.array_contains(d, x), i)), lambda i: i.isNotNull())
    out = out.withColumn(s, F.when(F.size(d) <= FEW, few).when(F.size(d) > FEW, repeated_positions(F.col(m))))
    out = out.withColumn("n_repeat_words", covered_words(F.col(s)))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed).drop(w, h, d, m, s, lines)


def clean_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with the base counts, ``cleaned`` (the text without failing lines), the lines and
    characters removed, and ``kept``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    out = with_counts(docs)
    lines, bad = own(out, "lines"), own(out, "bad")
    out = (out.withColumn(lines, F.split(text, "\n"))
           .withColumn(bad, F.transform(lines, lambda x: has_word(x) & line_fails(x))))
    good = F.filter(lines, lambda x, i: ~F.get(F.col(bad), i))
    removed = F.array_join(F.filter(lines, lambda x, i: F.get(F.col(bad), i)), "")
    out = (out.withColumn("n_lines_removed", F.size(F.filter(bad, lambda x: x)).cast("long"))
           .withColumn("chars_removed", length_without(removed, BLANKS).cast("long"))
           .withColumn("cleaned", F.array_join(good, "\n")))
    kept = ~F.col("base_failed") & (100 * F.col("chars_removed") <= MAX_LOSS_PERCENT * F.col("word_chars"))
    return out.withColumn("kept", kept).drop(lines, bad)


def quality_report(docs: DataFrame) -> DataFrame:
    """The counts and verdict of each document, with a digest of its cleaned text."""
    return clean_documents(docs.select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_lines_removed", "chars_removed", F.sha2("cleaned", 256).alias("cleaned_sha256"))


def keep_good(docs: DataFrame) -> DataFrame:
    """Documents that pass, with their cleaned texts, in the columns of ``docs``."""
    names = docs.columns
    plain = docs.select(*[F.col(c) for c in ("doc_id", "text")], F.struct(*names).alias("row"))
    judged = clean_documents(plain)
    new = {"text": F.col("cleaned"), "n_chars": F.length("cleaned").cast("long")}
    row = F.struct(*[new.get(c, F.col("row")[c]).alias(c) for c in names])
    # An array of one row or none: a filter would be moved below the counts and repeat all of their work.
    return judged.select(F.explode(F.filter(F.array(F.struct("kept", row.alias("row"))), lambda x: x["kept"])).alias("found")).select("found.row.*")
