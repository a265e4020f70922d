"""Toxicity scores from class-conditional Kneser-Ney models.

Both models give P(word | class) from the number of labelled documents of the class that hold the
word. Absolute discounting takes up to K counts from each word (K scaled by class size, so both classes
give up alike shares). What is given up backs off to the word's first letters (``STEMS``), where the
class counts are what the words gave up, discounted again; within a beginning, and at the end of the
chain, the counts of both classes are pooled, and this shared distribution spreads what is left. It is
made of the discounted counts themselves, which keeps each model's marginals. So a rare inflected form
takes the evidence of its beginning, a rare word of a rare beginning gets nearly equal probabilities,
and a word that is frequent in one class keeps its evidence. A text is compared by its length-normalised
log-likelihood under both models, and a logistic curve fitted on labelled documents that took no part in
the counts turns this into 0 to 1.

A fifth of the training rows is kept out of the counts while the discount is chosen and the curve is
fitted, on at most ``max_curve_rows`` of them; the curve holds for models of these counts, so the fifth
is not added to them later. Only entries whose count reaches K can tell the classes apart. They stay a table that grows with
the corpus. The ``max_words`` most frequent of each level are sent to the tasks; if there are more,
the words of a text that were not sent meet the table by a join, with the same scores.

Cases: a null or empty text has no words and gets the curve's value at zero evidence; labels of a
document given more than once count as toxic if any row does, null labels and ids are skipped; a null
id is in no training part (its remainder is taken of the empty text); without labels of both classes
every score is 0; repeated rows each get a row; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from exprmat.llm.common import pin, small_side

#: Discounts that are tried; the one whose curve has the least loss on the rows kept for it is used.
DISCOUNTS = (3, 10, 20, 50)
#: Entries of a level that are sent to the tasks; further ones are joined.
MAX_WORDS = 500_000
MAX_CURVE_ROWS = 20_000
BETWEEN_WORDS = r"[^\p{L}\p{N}]+"


#: Letters of the beginnings to which words back off.
STEMS = (5,)


def lower_words(text: Column) -> Column:
    """The lower-cased words of a text; an empty array for null."""
    words = F.array_remove(F.split(F.lower(text), BETWEEN_WORDS), "")
    return F.coalesce(words, F.array().cast("array<string>"))


def remainder(doc_id: Column, n: int) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n))


@dataclass
class Model:
    """Log-ratio of the two class probabilities for the words and beginnings that can tell them apart:
    the whole tables ``levels (key, ratio)``, words first, and the part ``sent`` that goes to the tasks."""

    levels: list[DataFrame]
    sizes: list[int]
    sent: list[dict[str, float]]
    rest: float  # of words without any known beginning
    curve: np.ndarray = field(default_factory=lambda: np.zeros(4))

    def table(self) -> Table:
        return Table(self.sent, self.rest, self.curve, all(len(t) == n for t, n in zip(self.sent, self.sizes, strict=True)))

    def of_word(self, word: str) -> float:
        return self.table().of_word(word)


@dataclass
class Table:
    """What tasks hold of a model; ``whole`` if that is all."""

    ratio: list[dict[str, float]]
    rest: float
    curve: np.ndarray
    whole: bool

    def of_word(self, word: str) -> float | None:
        """The word's log-ratio; None if the tables that were not sent have to be asked."""
        r = self.ratio[0].get(word)
        if r is None and not self.whole:
            return None
        for j, n in enumerate(STEMS, 1):
            if r is None:
                r = self.ratio[j].get(word[:n])
        return self.rest if r is None else r

    def totals(self, words: pa.Array, sizes: np.ndarray) -> tuple[np.ndarray, pa.Array]:
        """By text: the sum of the log-ratios of its words, and the words that were not sent, repeats included."""
        if not len(words):
            return np.zeros(len(sizes)), pa.array([[]] * len(sizes), pa.list_(pa.string()))
        of = np.repeat(np.arange(len(sizes)), sizes)
        kinds = words.dictionary_encode()
        distinct = kinds.dictionary.to_numpy(zero_copy_only=False)
        at = kinds.indices.to_numpy()
        values = [self.of_word(w) for w in distinct]
        each = np.array([0.0 if v is None else v for v in values])[at]
        unknown = np.array([v is None for v in values])[at]
        offsets = np.concatenate([[0], np.cumsum(np.bincount(of[unknown], minlength=len(sizes)))])
        unsent = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), words.filter(pa.array(unknown)).cast(pa.string()))
        return np.bincount(of, each, len(sizes)), unsent


def evidence(total: Column, n: Column) -> list[Column]:
    """Toxic less ordinary log-likelihood per word, that by root of length, and 1 / root of length."""
    some = F.greatest(n, F.lit(1))
    return [(total / some).alias("e0"), (total / F.sqrt(some)).alias("e1"), (1 / F.sqrt(n + 1.0)).alias("e2")]


def curve_score(curve: np.ndarray) -> Column:
    x = sum((F.col(f"e{j}") * float(curve[j]) for j in range(3)), F.lit(float(curve[3])))
    return 1 / (1 + F.exp(-F.greatest(F.least(x, F.lit(500.0)), F.lit(-500.0))))


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Logistic regression by Newton steps on standardised columns (the last column is constant)."""
    mean, std = x.mean(0), x.std(0)
    mean[-1], std[-1] = 0, 1
    std[std < 1e-12] = 1
    z = (x - mean) / std
    b = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        h = (z * (p * (1 - p) + 1e-9)[:, None]).T @ z + ridge * np.eye(len(b))
        step = np.linalg.solve(h, z.T @ (p - y) + ridge * b)
        b -= step
        if np.abs(step).max() < 1e-9:
            break
    out = b / std
    out[-1] -= (b / std * mean)[:-1].sum()
    return out


def _evidence(rows: DataFrame, model: Model, keep: str) -> DataFrame:
    """``keep`` columns and the evidence ``e0, e1, e2`` of each row's words ``w``."""
    table = model.table()
    sent = rows.sparkSession.sparkContext.broadcast(table)
    names = [c.split()[0] for c in keep.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            w = b.column("w")
            sizes = np.diff(w.offsets.to_numpy())
            total, unsent = m.totals(w.flatten(), sizes)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(total), pa.array(sizes, pa.int64()), unsent],
                                             names=[*names, "total", "n", "unsent"])

    out = rows.select(*names, "w").mapInArrow(run, f"{keep}, total double, n long, unsent array<string>")
    total = F.col("total")
    if not table.whole:
        # equal lists of words have equal sums, so repeated rows need no key of their own
        out = pin(out.withColumn("list", F.md5(F.to_json("unsent"))), "toxic-unsent")
        asked = (out.select("list", "unsent").where(F.size("unsent") > 0).dropDuplicates(["list"])
                 .select("list", F.explode("unsent").alias("key")).groupBy("list", "key").count())
        found, ratio = asked, []
        for j, (level, size) in enumerate(zip(model.levels, model.sizes, strict=True)):
            part = level.select(F.col("key").alias(f"key{j}"), F.col("ratio").alias(f"ratio{j}"))
            on = F.col("key") if j == 0 else F.left("key", F.lit(STEMS[j - 1]))
            found = found.join(small_side(part, size), on == F.col(f"key{j}"), "left")
            ratio.append(F.col(f"ratio{j}"))
        more = found.groupBy("list").agg(F.sum(F.col("count") * F.coalesce(*ratio, F.lit(model.rest))).alias("more"))
        out = out.join(more, "list", "left")
        total = total + F.coalesce("more", F.lit(0.0))
    return out.select(*names, *evidence(total, F.col("n")))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id",
        label_col: str = "toxic", folds: int = 5, discounts: tuple[int, ...] = DISCOUNTS, max_words: int = MAX_WORDS,
        max_curve_rows: int = MAX_CURVE_ROWS) -> Model | None:
    """The models, from labelled rows whose id's remainder is not 0; None without both classes."""
    known = (labels.select(F.col(label_id_col).alias("id"), F.col(label_col).alias("y"))
             .where("id is not null and y is not null").where(remainder(F.col("id"), folds) != 0)
             .groupBy("id").agg(F.max(F.when(F.col("y") > 0, 1).otherwise(0)).alias("y"))
             .withColumn("curve", F.pmod(F.xxhash64("id"), F.lit(5)) == 0))
    known = pin(known, "toxic-labels")
    rows = known.count()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("txt")).where("txt is not null")
    counted = F.when(F.col("curve"), 0).otherwise(1)  # kept out while the discount is chosen
    seen = (texts.join(small_side(known, rows), "id")
            .select("y", "curve", F.explode(F.array_distinct(lower_words(F.col("txt")))).alias("key"))
            .groupBy("key").agg(*(F.sum(x).cast("double").alias(c) for c, x in (
                ("c0", (1 - F.col("y")) * counted), ("c1", F.col("y") * counted), ("all0", 1 - F.col("y")), ("all1", F.col("y"))))))
    every = pin(seen, "toxic-counts")
    counts = every.where("c0 + c1 > 0").select("key", "c0", "c1")
    sums = every.agg(*(F.sum(c) for c in ("c0", "c1", "all0", "all1"))).first()
    if not all(sums):
        return None
    totals, whole_totals = np.array(sums[:2], float), np.array(sums[2:], float)
    chosen = known.where("curve").orderBy(F.xxhash64("id", F.lit(1)), "id").limit(max_curve_rows)
    curve_rows = pin(texts.join(small_side(chosen, max_curve_rows), "id").select("y", lower_words(F.col("txt")).alias("w")), "toxic-curve")
    best, curve, least = discounts[0], np.zeros(4), np.inf
    for discount in discounts:
        model = _model(counts, totals, discount, max_words)
        found = _evidence(curve_rows, model, "y int").toArrow()
        y = found["y"].to_numpy()
        if len(y) and 0 < y.sum() < len(y):
            x = np.stack([*(found[c].to_numpy() for c in ("e0", "e1", "e2")), np.ones(len(y))], 1)
            tried = fit_curve(x, y)
            p = np.clip(1 / (1 + np.exp(-np.clip(x @ tried, -500, 500))), 1e-9, 1 - 1e-9)
            loss = float(-np.mean(np.where(y == 1, np.log(p), np.log(1 - p))))
        else:
            tried, loss = np.array([1.0, 0, 0, 0]), 0.0
        if loss < least:
            best, curve, least = discount, tried, loss
    model = _model(counts, totals, best, max_words)
    model.curve = curve
    return model


def _model(counts: DataFrame, totals: np.ndarray, discount: int, max_words: int) -> Model:
    """Both classes' models of ``counts (key, c0, c1)`` of ordinary and toxic documents."""
    cut = [float(x) for x in discount * totals / totals.min()]
    c = [F.col("c0"), F.col("c1")]
    given = [F.least(x, F.lit(k)) for x, k in zip(c, cut, strict=True)]
    reached = (c[0] >= cut[0]) | (c[1] >= cut[1])
    levels = [counts]
    for stem in STEMS:
        up = levels[-1].groupBy(F.left("key", F.lit(stem)).alias("key")).agg(*(F.sum(g).alias(f"c{y}") for y, g in enumerate(given)))
        levels.append(pin(up, "toxic-beginnings"))
    left = [float(x) for x in levels[-1].agg(*(F.sum(g) for g in given)).first()]
    # down the chain: what an entry keeps, and its part of what its beginning passes on
    above, tables, sent, sizes = None, [], [], []
    for j in range(len(levels) - 1, -1, -1):
        rows = levels[j].where(reached)
        if above is None:
            rows = rows.select("key", *c, *(F.lit(x).alias(f"back{y}") for y, x in enumerate(left)), F.lit(sum(left)).alias("whole"))
        else:
            passed = above.select(F.col("key").alias("parent"), *(F.col(f"m{y}").alias(f"back{y}") for y in (0, 1)), (c[0] + c[1]).alias("whole"))
            rows = rows.join(passed, F.left("key", F.lit(STEMS[j])) == F.col("parent"))
        share = (given[0] + given[1]) / F.col("whole")
        rows = rows.select("key", *c, *((F.greatest(c[y] - cut[y], F.lit(0.0)) + F.col(f"back{y}") * share).alias(f"m{y}") for y in (0, 1)))
        ratio = F.log(F.col("m1") / float(totals[1])) - F.log(F.col("m0") / float(totals[0]))
        above = pin(rows.withColumn("ratio", ratio), "toxic-ratios")
        size = above.count()
        most = above if size <= max_words else above.orderBy((c[0] + c[1]).desc(), "key").limit(max_words)
        found = most.select("key", "ratio").toArrow()
        tables.insert(0, above.select("key", "ratio"))
        sizes.insert(0, size)
        sent.insert(0, dict(zip(found["key"].to_pylist(), found["ratio"].to_pylist(), strict=True)))
    rest = float(np.log(left[1] / totals[1]) - np.log(left[0] / totals[0]))
    return Model(tables, sizes, sent, rest)


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", folds: int = 5) -> DataFrame:
    """``doc_id, held_out, score, predicted, ratio`` (ratio: log-likelihood difference per word) for every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), (remainder(F.col(id_col), folds) == 0).alias("held_out"),
                       F.col(text_col).alias("txt"))
    if model is None:
        out = rows.select("doc_id", "held_out", F.lit(0.0).alias("score"), F.lit(0.0).alias("ratio"))
    else:
        kind = rows.schema["doc_id"].dataType.simpleString()
        out = _evidence(rows.withColumn("w", lower_words(F.col("txt"))), model, f"doc_id {kind}, held_out boolean")
        out = out.withColumn("score", curve_score(model.curve)).withColumnRenamed("e0", "ratio")
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "ratio")
