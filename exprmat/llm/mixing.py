"""Soft-membership mixing: document rates whose expected domain token totals match target weights.

A classifier fitted on a labelled table predicts each document's domain posteriors. With m_d a
document's share of all tokens, p_d its posteriors and r_d its rate (expected copies), the expected
domain shares are T = sum of m_d r_d p_d. Distributed projected gradient descent minimises

    1/2 (T - t)' G^-1 (T - t) + rho/2 sum m_d (r_d - 1)^2   over r_d >= 0,   G = sum m_d p_d p_d'

G (with a small ridge) only weighs the residuals: domains of few tokens count as much as large ones. A
rate depends on its own posteriors and on the residual vectors of the steps so far, so no rates are
written per step: each step (with Nesterov's momentum, begun anew when it leads uphill) folds the vectors so far over
the documents, and aggregates one vector. The objective is strongly convex, so the projected gradient bounds
how far the rates still are from the minimum (root mean square over tokens); no domain's total is farther
from its limit. Steps end when this bound is at most ``TOLERANCE``; if they run out, a warning gives the
bound and the gap to the targets. Copies are the rate's whole part, and one more where a hash of the id
falls below the rest.

The classifier is fitted on a bounded sample: at most ``max_labelled`` rows of each domain, by hash of
the id. Posteriors, token counts and every step cover all documents.

Cases: a null or empty text has no tokens, no say in the totals, and its rate follows its posteriors;
labels given more than once count as the first domain by name; null labels and ids are skipped; domains
that no labelled document has cannot be predicted and their targets are left out (the rest is scaled up
to 1); with one domain its posterior is 1; without labelled documents all rates are 1; repeated rows each
get a row; an empty table gives no rows.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame

from exprmat.llm.common import pin, small_side
from exprmat.llm.quality import FIT_PARTS, TEXT_BITS, text_pieces

MAX_LABELLED = 4_000
RHO = 1e-2
#: Added to G, as a share of its trace: domains that posteriors hardly tell apart don't set the scale.
RIDGE = 1e-3
#: Largest distance of the rates from the minimum at which steps end, and the most steps.
TOLERANCE = 1e-4
STEPS = 1_000


def _features() -> PipelineModel:
    return PipelineModel([HashingTF(numFeatures=1 << TEXT_BITS, inputCol="pieces", outputCol="counts"),
                          Normalizer(p=2.0, inputCol="counts", outputCol="text_view")])


def posteriors(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id",
               domain_col: str = "domain", max_labelled: int = MAX_LABELLED, *keep: Column) -> tuple[DataFrame, list[str]]:
    """``id, n_tokens, p`` of every document (and columns to keep), and the domains in the order of ``p``."""
    known = (labelled.select(F.col(label_id_col).alias("id"), F.col(domain_col).cast("string").alias("domain"))
             .where("id is not null and domain is not null").groupBy("id").agg(F.min("domain").alias("domain")))
    ids = docs.select(F.col(id_col).alias("id")).where("id is not null").distinct().join(known, "id")
    ids = pin(ids.withColumn("h", F.xxhash64("id", F.lit(3))), "mixing-labelled")
    domains = [r["domain"] for r in ids.select("domain").distinct().orderBy("domain").collect()]
    rows = docs.select(*keep, F.col(id_col).alias("id"), text_pieces(F.col(text_col)).alias("pieces"))
    base = [c for c in rows.columns if c != "pieces"]
    if len(domains) < 2:
        return rows.select(*base, F.size("pieces").cast("long").alias("n_tokens"),
                           F.array(*(F.lit(1.0) for _ in domains)).cast("array<double>").alias("p")), domains
    sample = None
    for y, d in enumerate(domains):
        part = ids.where(F.col("domain") == d).orderBy("h", "id").limit(max_labelled).select("id", F.lit(float(y)).alias("y"))
        sample = part if sample is None else sample.union(part)
    texts = docs.select(F.col(id_col).alias("id"), text_pieces(F.col(text_col)).alias("pieces"))
    learn = pin(_features().transform(texts.join(small_side(sample, max_labelled * len(domains)), "id")).select("y", "text_view"), "mixing-sample")
    model = LogisticRegression(featuresCol="text_view", labelCol="y", regParam=1e-6, maxIter=40, family="multinomial",
                               standardization=False).fit(learn.coalesce(FIT_PARTS))
    scored = model.setProbabilityCol("prob").setPredictionCol("").setRawPredictionCol("").transform(_features().transform(rows))
    return scored.select(*base, F.size("pieces").cast("long").alias("n_tokens"), vector_to_array("prob").alias("p")), domains


def walk(p: np.ndarray, moves: list[np.ndarray], step: float, rho: float) -> tuple[np.ndarray, ...]:
    """Rates after the steps so far from 1 and the next look-ahead point, then the rates before the last step
    and its look-ahead point, for rows of posteriors at once. A move is a step's residual vector, then its
    momentum (Nesterov's acceleration)."""
    r = y = old = at = np.ones(len(p))
    for u in moves:
        old, at = r, y
        r = np.maximum(0, y - step * (p @ u[:-1] + rho * (y - 1)))
        y = r + u[-1] * (r - old)
    return r, y, old, at


def sums_at(soft: DataFrame, size: float, moves: list[np.ndarray], step: float, rho: float, k: int) -> np.ndarray:
    """Expected domain shares at the look-ahead point and at the rates; the last step's squared length from its
    look-ahead point, and whether it went against the momentum (above 0). Each task sends one vector. (In Arrow
    batches, since literals that change each step would make Spark compile the whole stage anew.)"""
    names = [f"s{j}" for j in range(2 * k + 2)]

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(names))
        for b in batches:
            p = b.column("p").flatten().to_numpy().reshape(-1, k)
            m = b.column("n_tokens").to_numpy() / size
            r, y, old, at = walk(p, moves, step, rho)
            total += np.concatenate([(m * y) @ p, (m * r) @ p, [m @ (at - r)**2, m @ ((at - r) * (r - old))]])
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in total], names=names)

    sums = soft.select("n_tokens", "p").mapInArrow(part, ", ".join(f"{c} double" for c in names))
    return np.array(sums.agg(*(F.sum(c) for c in names)).first(), float)


def fit_rates(soft: DataFrame, targets: np.ndarray, rho: float = RHO, steps: int = STEPS, tolerance: float = TOLERANCE) -> Column:
    """The rate as an expression of column ``p``."""
    k = len(targets)
    size = soft.agg(F.sum("n_tokens")).first()[0] or 0
    if not size or not k:
        return F.lit(1.0)
    m = F.col("n_tokens") / F.lit(float(size))
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    sums = soft.agg(*(F.sum(m * F.get("p", F.lit(i)) * F.get("p", F.lit(j))) for i, j in pairs)).first()
    gram = np.zeros((k, k))
    for (i, j), x in zip(pairs, sums, strict=True):
        gram[i, j] = gram[j, i] = x
    weigh = np.linalg.inv(gram + RIDGE * np.trace(gram) * np.eye(k))
    # in the metric of m, the gradient's slope is at most 1 + rho: W^1/2 G W^1/2 is at most the identity
    step, moves, age = 1 / (1 + rho), [], 0
    while True:
        sums = sums_at(soft, float(size), moves, step, rho, k)
        # a step shrinks the distance to the minimum by 1 / (1 + rho) at least, so what is left is bounded by its length
        left = np.sqrt(sums[-2]) / rho if moves else np.inf
        if left <= tolerance:
            break
        if len(moves) >= steps:
            warnings.warn(f"mixing rates: {steps} steps ended at most {left:.2g} from the minimum (asked: {tolerance:.2g}), "
                          f"domain totals at most {np.abs(sums[k:2 * k] - targets).max():.2g} from their targets", stacklevel=2)
            break
        age = 0 if sums[-1] > 0 else age
        moves.append(np.append(weigh @ (sums[:k] - targets), age / (age + 3)))
        age += 1

    @F.arrow_udf("double")
    def rate(p: pa.Array) -> pa.Array:
        return pa.array(walk(p.flatten().to_numpy().reshape(-1, k), moves, step, rho)[0])

    return rate(F.col("p"))


def mix(docs: DataFrame, labelled: DataFrame, targets: Mapping[str, float], id_col: str = "doc_id", text_col: str = "text",
        label_id_col: str = "doc_id", domain_col: str = "domain", seed: int = 42, max_labelled: int = MAX_LABELLED,
        whole: bool = False) -> DataFrame:
    """Every document's ``doc_id, n_tokens, p, rate, copies``; with ``whole`` the row itself too, as a struct."""
    keep = [F.struct("*").alias("whole")] if whole else []
    soft, domains = posteriors(docs, labelled, id_col, text_col, label_id_col, domain_col, max_labelled, *keep)
    light = posteriors_table(soft)
    if not whole:
        soft = light
    t = np.array([targets.get(d, 0.0) for d in domains], float)
    if t.sum() <= 0:
        rate = F.lit(1.0)
    else:
        rate = fit_rates(light, t / t.sum())
    chance = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    out = soft.withColumn("rate", rate)
    return out.select(F.col("id").alias("doc_id"), "n_tokens", "p", "rate",
                      (F.floor("rate") + (chance < F.col("rate") - F.floor("rate")).cast("long")).alias("copies"),
                      *(["whole"] if whole else []))


def posteriors_table(soft: DataFrame) -> DataFrame:
    """Token counts and posteriors as a small written table, so that no step reads texts."""
    return pin(soft.select("id", "n_tokens", "p"), "mixing-posteriors")
