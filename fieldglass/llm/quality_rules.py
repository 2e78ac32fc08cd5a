"""Quality rules: judge every line, drop failing lines, reject documents that lose too much.

Only built-in column functions run here, row by row, without a shuffle: a
document never meets another one, so no key can be hot.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from fieldglass.llm.common import BLANKS, landed, texts, with_text

#: All but the characters that count as symbols (fixed values of the contract).
NOT_SYMBOLS = r"[^#*$%&|<>]+"
#: Phrases of page furniture, matched in lower-cased lines (fixed values).
BOILERPLATE = (
    "all rights reserved", "cookie policy", "privacy policy", "terms of use", "terms of service", "enable javascript",
    "click here", "sign up for", "subscribe to", "share this", "lorem ipsum", "skip to content",
)
#: Marks that end a sentence, with closing quotes and brackets after them.
SENTENCE_END = r"[.!?…:;][\x22'”»)\]]*$"

#: Longest list of repeated windows that is searched value by value.
LOOKED_UP = 32

MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
MAX_LOST_PERCENT = 50


def window_hashes(words: Column) -> Column:
    """A 64-bit hash of every three-word window, in text order."""
    count = F.size(words)
    return F.when(
        count >= 3,
        F.transform(
            F.slice(words, 1, count - 2), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))
        ),
    ).otherwise(F.array().cast("array<bigint>"))


def count_repeated(rows: DataFrame) -> DataFrame:
    """Add n_repeat_words: the words inside windows whose hash occurs again (column ``hashes``).

    Most texts repeat no window or a few, which are looked up in a short list.
    Where that list is longer, one sort of hashes with their positions brings
    equal windows together.  Both ways find the same positions.
    """
    rows = rows.withColumn("ordered", F.sort_array("hashes"))
    rows = rows.withColumn(
        "again", F.array_distinct(F.filter("ordered", lambda h, i: h == F.get(F.col("ordered"), i - 1)))
    ).drop("ordered")
    pairs = F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    rows = rows.withColumn("pairs", F.when(F.size("again") > LOOKED_UP, pairs))
    by_sort = F.filter(
        "pairs",
        lambda x, i: (x["h"] == F.get(F.col("pairs"), i - 1)["h"]) | (x["h"] == F.get(F.col("pairs"), i + 1)["h"]),
    )
    by_list = F.filter(
        F.transform("hashes", lambda h, i: F.when(F.array_contains("again", h), i)), lambda p: p.isNotNull()
    )
    starts = (
        F.when(F.size("again") == 0, F.array().cast("array<int>"))
        .when(F.size("again") > LOOKED_UP, F.sort_array(F.transform(by_sort, lambda x: x["p"])))
        .otherwise(by_list)
    )
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("total"))
    spanned = F.aggregate(
        starts, zero,
        lambda acc, p: F.struct(
            (p + 3).alias("end"), (acc["total"] + (p + 3) - F.greatest(p, acc["end"])).alias("total")
        ),
        lambda acc: acc["total"],
    )
    return rows.withColumn("n_repeat_words", spanned).drop("again", "pairs", "hashes")


def line_facts(line: Column) -> Column:
    """A line with its words, so that later steps read each of them once."""
    return F.struct(line.alias("line"), F.array_remove(F.split(line, BLANKS), "").alias("words"))


def line_counts(fact: Column) -> Column:
    """Counts the line rules look at; symbols are what remains when the rest is taken out."""
    return F.struct(
        fact["line"].alias("line"),
        F.size(fact["words"]).alias("n"),
        F.size(F.array_distinct(fact["words"])).alias("distinct"),
        F.length(F.regexp_replace(fact["line"], NOT_SYMBOLS, "")).alias("symbols"),
    )


def line_fails(x: Column) -> Column:
    """The line rules: symbols, menus, shouting, stutter, furniture, loose fragments.

    Lines without a word pass: they carry nothing.
    """
    letters = F.length(F.regexp_replace(x["line"], "[^A-Za-z]+", ""))
    capitals = F.length(F.regexp_replace(x["line"], "[^A-Z]+", ""))
    return (x["n"] > 0) & (
        (x["symbols"] * 10 >= x["n"] * 3)
        | (x["line"].rlike("[A-Z]{3}") & (letters >= 20) & (capitals * 10 > letters * 7))
        | ((x["n"] >= 10) & (x["distinct"] * 10 < x["n"] * 3))
        | reduce(or_, (F.contains(F.lower(x["line"]), F.lit(phrase)) for phrase in BOILERPLATE))
        | ((x["n"] <= 3) & ~F.rtrim(x["line"]).rlike(SENTENCE_END))
    )


def quality_rules(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_words: int = MIN_WORDS,
    max_repeated_percent: int = MAX_REPEATED_PERCENT, max_lost_percent: int = MAX_LOST_PERCENT,
) -> DataFrame:
    """Counts, verdict and cleaned text of every document, one row each.

    Columns: doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, lost_chars, kept, clean_text.  ``base_failed``:
    fewer than ``min_words`` words, or more than ``max_repeated_percent`` of the
    words in repeated windows.  Otherwise a document is kept unless the lines
    removed hold more than ``max_lost_percent`` of its word characters.

    Null or empty text has no words, fails the base rule and has the clean text
    "".  Repeated rows and ids are judged each for itself; other columns are
    left out, whatever their names; an empty table gives an empty one.
    """
    lines = texts(docs, id_column, text_column).select(
        "doc_id", F.transform(F.split("text", "\n", -1), line_facts).alias("facts")
    )
    # A line break is white space, so the words of the text are those of its lines.
    lines = lines.select(
        "doc_id", F.flatten(F.transform("facts", lambda x: x["words"])).alias("words"),
        F.transform("facts", line_counts).alias("lines"),
    )
    lines = lines.select(
        "doc_id", "lines", F.size("words").cast("long").alias("n_words"), window_hashes(F.col("words")).alias("hashes"),
        F.aggregate("words", F.lit(0).cast("long"), lambda n, w: n + F.length(w)).alias("word_chars"),
        F.transform(F.filter("lines", lambda x: x["n"] > 0), lambda x: x["line"]).alias("full"),
    )
    judged = count_repeated(lines).select(
        "doc_id", "n_words", "word_chars", "n_repeat_words",
        F.aggregate("lines", F.lit(0).cast("long"), lambda n, x: n + x["symbols"]).alias("n_symbols"),
        (F.size("full") - F.size(F.array_distinct("full"))).cast("long").alias("n_dup_lines"),
        F.transform(F.filter("lines", lambda x: ~line_fails(x)), lambda x: x["line"]).alias("good"),
    )
    judged = judged.select(
        "*",
        ((F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeated_percent))
        .alias("base_failed"),
        F.array_join("good", "\n").alias("clean_text"),
    )
    left = F.length(F.regexp_replace("clean_text", r"[\x20\x09-\x0D]+", "")).cast("long")
    judged = judged.withColumn("lost_chars", F.col("word_chars") - left)
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "lost_chars",
        (~F.col("base_failed") & (F.col("lost_chars") * 100 <= F.col("word_chars") * max_lost_percent)).alias("kept"),
        "clean_text",
    )


def clean_documents(docs: DataFrame) -> DataFrame:
    """The documents table after the rules: rejected rows are gone, failing lines cut out."""
    packed = docs.select("text", F.struct("doc_id", "lang", "source").alias("doc"))
    # Written first: a filter would be pushed below the counts and compute them over again.
    judged = landed(quality_rules(packed, id_column="doc").select("doc_id", "kept", "clean_text"), "judged").where("kept")
    return with_text(
        judged.select("doc_id.doc_id", "doc_id.lang", "doc_id.source", "clean_text"), F.col("clean_text")
    )
