"""Benchmark decontamination by a prefix-filtered set join, in DataFrame functions only.

A benchmark item is a set of windows of ``window`` consecutive words (an item of fewer words is one
window). A document holds a window only if it holds every word of it, so one word is a necessary
prefix; words are ordered by their count over the whole corpus, and each window's prefix is its rarest
word. Document words are joined with the prefixes; the match fixes where the window would start. The
length bound drops starts that would leave the text, the positional bound compares the window's
second-rarest word at its place, and what is left is verified word by word.

Documents are never shuffled or grouped: the benchmark side is broadcast after its size is counted
(beyond the bound, the planner's shuffle joins are used), and only hits are gathered per document.

Cases: null and empty texts have no words; items without words have no windows; an item id that is
null marks words as hit but is in no list of items; repeated item rows count once; repeated document
rows each get a row; an empty benchmark leaves every document clean.
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W

from exprmat.llm.common import ascii_lower, pin, small_side

#: Fixed by the contract: what separates words, words per window.
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 13
#: Windows (about 1 kB each) and different benchmark words that may be broadcast.
WINDOW_ROWS = 100_000
WORD_ROWS = 500_000


def words_of(text: Column) -> Column:
    """Words of a text with A-Z lower-cased; an empty array for null."""
    return F.coalesce(F.array_remove(F.split(ascii_lower(text), BETWEEN_WORDS), ""), F.array().cast("array<string>"))


def item_windows(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """``(item, win)`` for each different window of each item."""
    w = items.select(F.col(id_col).alias("item"), words_of(F.col(text_col)).alias("w")).where("size(w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - window + 1))
    return (w.select("item", "w", F.explode(starts).alias("s"))
            .select("item", F.slice("w", F.col("s"), window).alias("win")).distinct())


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Per document row: ``doc_id, n_words, n_hit, n_items, items_sha256``."""
    wins = pin(item_windows(items, item_col, item_text_col, window), "decontam-windows")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("txt"))
    words = texts.select("id", F.xxhash64("txt").alias("h"), words_of(F.col("txt")).alias("w"))

    # count benchmark words over the whole corpus
    vocabulary = pin(wins.select(F.explode("win").alias("word")).distinct(), "decontam-vocabulary")
    seen = (words.select(F.explode("w").alias("word"))
            .join(small_side(vocabulary, vocabulary.count(), WORD_ROWS), "word")
            .groupBy("word").agg(F.count("*").alias("n")))
    counts = pin(seen, "decontam-counts")

    # a window with a word that the corpus lacks occurs nowhere; the others are found by their rarest word
    at = wins.select("win", F.posexplode("win").alias("o", "word")).distinct()
    ranked = (at.join(counts, "word").groupBy("win")
              .agg(F.slice(F.sort_array(F.collect_list(F.struct("n", "word", "o"))), 1, 2).alias("p"), F.count("*").alias("k"))
              .where("k = size(win)")
              .select("win", F.col("p")[0]["word"].alias("word"), F.col("p")[0]["o"].alias("o"),
                      F.try_element_at("p", F.lit(2))["word"].alias("word2"), F.try_element_at("p", F.lit(2))["o"].alias("o2")))
    prefixes = pin(ranked.withColumn("len", F.size("win")), "decontam-prefixes")

    at_doc = words.select("id", "h", "w", F.posexplode("w").alias("p", "word"))
    start = F.col("p") - F.col("o")
    met = (at_doc.join(small_side(prefixes, prefixes.count(), WINDOW_ROWS), "word")
           .where((start >= 0) & (start + F.col("len") <= F.size("w")))
           .where(F.col("word2").isNull() | (F.get("w", start + F.col("o2")) == F.col("word2")))
           .where(F.slice("w", F.greatest(start, F.lit(0)) + 1, F.col("len")) == F.col("win")))
    # one row per window of a document; its first occurrence of equal (start, length) is enough
    hits = pin(met.select("id", "h", start.alias("s"), (start + F.col("len")).alias("e"), "win").distinct(), "decontam-hits")

    # words covered by the union of the hit ranges: each range adds what lies past all before it
    order = W.partitionBy("id", "h").orderBy("s", "e").rowsBetween(W.unboundedPreceding, -1)
    spans = hits.select("id", "h", "s", "e").distinct()
    covered = (spans.withColumn("until", F.coalesce(F.max("e").over(order), F.lit(0)))
               .groupBy("id", "h").agg(F.sum(F.greatest(F.lit(0), F.col("e") - F.greatest("s", "until"))).alias("n_hit")))
    found = (hits.select("id", "h", "win").distinct().join(small_side(wins, wins.count(), WINDOW_ROWS), "win")
             .groupBy("id", "h").agg(F.collect_set("item").alias("items")))
    per_doc = covered.join(found, (covered.id.eqNullSafe(found.id)) & covered.h.eqNullSafe(found.h)).select(
        covered.id.alias("hit_id"), covered.h.alias("hit_h"), "n_hit", "items")
    per_doc = pin(per_doc, "decontam-documents")
    listed = F.sort_array(F.transform(F.coalesce("items", F.array().cast(per_doc.schema["items"].dataType)),
                                      lambda x: x.cast("string")))
    return (words.select("id", "h", F.size("w").cast("long").alias("n_words"))
            .join(small_side(per_doc, per_doc.count(), WINDOW_ROWS),
                  F.col("id").eqNullSafe(F.col("hit_id")) & F.col("h").eqNullSafe(F.col("hit_h")), "left")
            .select(F.col("id").alias("doc_id"), "n_words",
                    F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                    F.size(listed).cast("long").alias("n_items"),
                    F.sha2(F.array_join(listed, ","), 256).alias("items_sha256")))


def contaminated(n_words: Column, n_hit: Column) -> Column:
    """The contract's rule: at least a twentieth of the words is hit."""
    return (n_hit > 0) & (20 * n_hit >= n_words)
