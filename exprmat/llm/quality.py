"""Quality classification by co-training of a text view and a page-metadata view.

The text view sees hashed words and runs of symbols of a text (``HashingTF`` and logistic
regression). The metadata view sees only what a crawl record or a glance tells: language, source,
length, and shares of line breaks, capitals, digits, symbols and separators. Both are fitted on
labelled documents; then, round by round, each view labels those of all unlabelled documents of
which it is most sure, and the other view learns from them. Each view is calibrated on labelled
documents that no fit has seen, and the mean of the two calibrated logits scores every document.

Of the labelled rows a bounded sample is used: at most ``max_labelled`` of each class, by hash of the
id. All unlabelled documents take part in the exchange: their features are written once, every round
both views score all of them, counts by bins of the score give the cut above which the surest share
of each class lies, and every document above the cut is learned from. Together the rows exchanged
weigh as much as that share of the labelled rows, so their number does not outweigh the labels.
Every document is scored, on its whole text.

Cases: a null text counts as empty and null language or source as a value of their own; labels given
more than once count as good if any row does; null labels are skipped, documents with a null id are
unlabelled; documents of equal score are exchanged together; without labels of both
classes every score is 1; repeated rows each get a row; an empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import pyspark.sql.functions as F
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF, Normalizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame

from exprmat.llm.common import pin, session_conf, small_side

MAX_LABELLED = 6_000
ROUNDS = 2
#: Share of the unlabelled documents that a view labels in the first round (then twice that, and so on),
#: and how sure it must be.
EXCHANGE = 0.1
SURE = 0.9
#: Scores are counted in bins of a hundredth of a logit, the outermost open.
BIN = 0.01
OUTERMOST = 5_000
TEXT_BITS = 15
#: Partitions of the labelled sample while fitting.
FIT_PARTS = 6
#: Rows that Spark's Parquet reader decodes at once while fitting: with its own 4,096, texts and vectors
#: fill arrays so large that the JVM's heap grows for them alone.
READ_ROWS = 256
#: Buckets to which sources and languages are hashed.
SITES = 64
PIECE = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]+"
META = ("size", "lines", "capitals", "digits", "symbols", "blanks")


def text_pieces(text: Column) -> Column:
    """Words and runs of symbols, case kept."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PIECE), F.lit(0))


def meta_columns(text: Column) -> dict[str, Column]:
    t = F.coalesce(text, F.lit(""))
    n = F.greatest(F.char_length(t), F.lit(1))

    def share(drop: str) -> Column:
        """Share of the characters that are left when those of ``drop`` go."""
        return F.char_length(F.regexp_replace(t, drop, "")) / n

    return {
        "size": F.log1p(F.char_length(t).cast("double")) / 10,
        "lines": 1 - F.char_length(F.replace(t, F.lit("\n"), F.lit(""))) / n,
        "capitals": share(r"[^\p{Lu}]+"),
        "digits": share(r"[^\p{Nd}]+"),
        "symbols": share(r"[\p{L}\p{N}\s]+"),
        "blanks": 1 - F.char_length(F.replace(t, F.lit(" "), F.lit(""))) / n,
    }


def with_views(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str, *keep: Column) -> DataFrame:
    """``id, pieces, site``, the metadata columns and those to ``keep``."""
    t = F.col(text_col)
    site = F.array(*(F.concat_ws("=", F.lit(k), F.coalesce(F.col(c).cast("string"), F.lit("?")))
                     for k, c in (("lang", lang_col), ("source", source_col))))
    return docs.select(*keep, F.col(id_col).alias("id"), text_pieces(t).alias("pieces"), site.alias("site"),
                       *(c.alias(k) for k, c in meta_columns(t).items()))


def feature_stages() -> list[Transformer]:
    return [
        HashingTF(numFeatures=1 << TEXT_BITS, inputCol="pieces", outputCol="counts"),
        HashingTF(numFeatures=SITES, inputCol="site", outputCol="sites"),
        VectorAssembler(inputCols=[*META, "sites"], outputCol="meta_view"),
    ]


def unit_length() -> Transformer:
    """The text view from the counts, which are what is written: small whole numbers pack well."""
    return Normalizer(p=2.0, inputCol="counts", outputCol="text_view")


VIEWS = ("text_view", "meta_view")


@dataclass
class Quality:
    """Fitted views, and by view the slope and intercept that calibrate its logit."""

    views: dict[str, LogisticRegressionModel]
    curves: dict[str, tuple[float, float]]

    def score(self, rows: DataFrame) -> DataFrame:
        """Adds ``score``; takes the columns of :func:`with_views`."""
        out = PipelineModel([*feature_stages(), unit_length()]).transform(rows)
        logits = []
        for v, m in self.views.items():
            out = m.setRawPredictionCol(f"raw_{v}").setProbabilityCol("").setPredictionCol("").transform(out)
            a, b = self.curves[v]
            logits.append(vector_to_array(f"raw_{v}")[1] * a + b)
        mean = sum(logits[1:], logits[0]) / len(logits)
        return out.withColumn("score", 1 / (1 + F.exp(-F.greatest(F.least(mean, F.lit(500.0)), F.lit(-500.0)))))


def _learn(seen: DataFrame, view: str, exchanged: DataFrame | None = None) -> LogisticRegressionModel:
    """A view's model of the rows ``y, weight`` and the view: labelled ones and, if any, exchanged ones."""
    text = view == "text_view"  # already of unit length; a stronger penalty would leave it sure of nothing
    rows = seen.select("y", F.lit(1.0).alias("weight"), view).coalesce(FIT_PARTS)
    if exchanged is not None:
        rows = rows.union(exchanged.select("y", "weight", view))
    return LogisticRegression(featuresCol=view, labelCol="y", weightCol="weight", regParam=1e-5 if text else 1e-3, maxIter=20,
                              standardization=not text).fit(rows)


def _logit(rows: DataFrame, model: LogisticRegressionModel, name: str = "logit") -> DataFrame:
    raw = f"raw_{name}"
    out = model.setRawPredictionCol(raw).setProbabilityCol("").setPredictionCol("").transform(rows)
    return out.withColumn(name, vector_to_array(raw)[1]).drop(raw)


def score_bin(logit: Column) -> Column:
    return F.least(F.greatest(F.floor(logit / BIN), F.lit(-OUTERMOST)), F.lit(OUTERMOST)).cast("int")


def surest(counts: dict[int, int], share: float, rate: float) -> dict[float, tuple[int, int]]:
    """By class (1.0, 0.0): the bin from which on (up for 1, down for 0) lie its surest documents, and how many
    they are; ``share`` of all, in the proportion ``rate`` of class 1, whole bins, none less sure than ``SURE``.
    A class of which the view is sure nowhere is left out."""
    size = sum(counts.values())
    least = math.ceil(math.log(SURE / (1 - SURE)) / BIN)
    out = {}
    for label, part in ((1.0, rate), (0.0, 1 - rate)):
        n, cut = 0, None
        for b in sorted(counts, reverse=label == 1.0):
            if n >= size * share * part or (b < least if label else b >= -least):
                break
            n, cut = n + counts[b], b
        if cut is not None:
            out[label] = cut, n
    return out


def _exchanged(pool: DataFrame, model: LogisticRegressionModel, cuts: dict[float, tuple[int, int]], share: float,
               labelled: dict[float, int]) -> DataFrame | None:
    """All unlabelled rows beyond the cuts with their label ``y`` and ``weight``; None where there are none."""
    if not cuts:
        return None
    b, y, weight = F.col("bin"), F.lit(None).cast("double"), F.lit(0.0)
    for label, (cut, n) in cuts.items():
        inside = b >= cut if label else b <= cut
        y = F.when(inside, label).otherwise(y)
        weight = F.when(inside, min(1.0, share * labelled[label] / n)).otherwise(weight)
    marked = _logit(pool, model).withColumn("bin", score_bin(F.col("logit")))
    return marked.withColumn("y", y).withColumn("weight", weight).where("y is not null")


def _calibrate(rows: DataFrame, model: LogisticRegressionModel) -> tuple[float, float]:
    logit = _logit(rows, model, "x").select("x", "y")
    one = VectorAssembler(inputCols=["x"], outputCol="f").transform(logit)
    fit = LogisticRegression(featuresCol="f", labelCol="y", regParam=1e-3, maxIter=25).fit(one)
    return float(fit.coefficients[0]), float(fit.intercept)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        source_col: str = "source", label_id_col: str = "doc_id", label_col: str = "quality", rounds: int = ROUNDS,
        max_labelled: int = MAX_LABELLED) -> Quality | None:
    """Both views after ``rounds`` exchanges; None without labelled documents of both classes."""
    with session_conf(docs.sparkSession, spark__sql__parquet__columnarReaderBatchSize=str(READ_ROWS)):
        return _fit(docs, labels, id_col, text_col, lang_col, source_col, label_id_col, label_col, rounds, max_labelled)


def _fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str,
         label_id_col: str, label_col: str, rounds: int, max_labelled: int) -> Quality | None:
    known = (labels.select(F.col(label_id_col).alias("id"), F.col(label_col).alias("y"))
             .where("id is not null and y is not null").groupBy("id").agg(F.max(F.when(F.col("y") > 0, 1.0).otherwise(0.0)).alias("y")))
    known = pin(known, "quality-labels")
    named = known.select(F.col("id").alias(id_col))
    n_known = known.count()
    ids = docs.select(F.col(id_col).alias("id")).join(small_side(known, n_known), "id").distinct()
    ids = pin(ids.withColumn("h", F.xxhash64("id", F.lit(7))), "quality-ids")
    # the first rows of each class by hash: a bounded, repeatable sample
    parts = [ids.where(F.col("y") == y).orderBy("h", "id").limit(max_labelled) for y in (1.0, 0.0)]
    sample = pin(parts[0].union(parts[1]), "quality-sample")
    stages = PipelineModel(feature_stages())
    views = with_views(docs.join(small_side(sample.select(F.col("id").alias(id_col)), 2 * max_labelled), id_col, "left_semi"),
                       id_col, text_col, lang_col, source_col)
    rows = stages.transform(views.join(small_side(sample, 2 * max_labelled), "id"))
    rows = unit_length().transform(pin(rows.select("id", "h", "y", "counts", "meta_view"), "quality-views"))
    holdout = F.pmod("h", F.lit(4)) == 0
    seen, held = rows.where(~holdout), rows.where(holdout)
    labelled, kept_out = ({r["y"]: r["count"] for r in part.groupBy("y").count().collect()} for part in (seen, held))
    if len(labelled) < 2 or len(kept_out) < 2:
        return None
    models = {v: _learn(seen, v) for v in VIEWS}
    if rounds:
        rest = with_views(docs.join(small_side(named, n_known), id_col, "left_anti"), id_col, text_col, lang_col, source_col)
        pool = unit_length().transform(pin(stages.transform(rest).select("counts", "meta_view"), "quality-pool"))
    rate = labelled[1.0] / sum(labelled.values())
    for r in range(rounds):
        share = min(1.0, EXCHANGE * (r + 1))
        marked = reduce(lambda df, v: _logit(df, models[v], v + "_logit"), VIEWS, pool)
        bins = (marked.select(F.explode(F.array(*(F.struct(F.lit(v).alias("view"), score_bin(F.col(v + "_logit")).alias("bin"))
                                                   for v in VIEWS))).alias("x"))
                .groupBy("x.view", "x.bin").count().collect())  # at most 10,001 bins a view
        found = {v: surest({b["bin"]: b["count"] for b in bins if b["view"] == v}, share, rate) for v in VIEWS}
        models = {other: _learn(seen, other, _exchanged(pool, models[v], found[v], share, labelled))
                  for v, other in zip(VIEWS, VIEWS[::-1], strict=True)}
    return Quality(models, {v: _calibrate(held, m) for v, m in models.items()})


def score(docs: DataFrame, model: Quality | None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          source_col: str = "source") -> DataFrame:
    """``doc_id, score, predicted`` for every row; predicted is 1 (good) at a score of 0.5 or more."""
    rows = with_views(docs, id_col, text_col, lang_col, source_col)
    out = rows.withColumn("score", F.lit(1.0)) if model is None else model.score(rows)
    return out.select(F.col("id").alias("doc_id"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Quality | None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
              source_col: str = "source") -> DataFrame:
    """The rows of ``docs``, all columns unchanged, whose score is at least 0.5."""
    if model is None:
        return docs
    views = with_views(docs, id_col, text_col, lang_col, source_col, F.struct("*").alias("whole"))
    return model.score(views).where("score >= 0.5").select("whole.*")
