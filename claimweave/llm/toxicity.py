"""Toxicity by class-conditional Kneser-Ney models over the characters of words.

Each class has its own document counts of character 6- and 5-grams; both back off to shared counts of the two
classes together, so that an expression too rare for either model says nothing.  A word's
length-normalised log-likelihoods under both models are compared; a document's most telling words, its
mean and its length go through a logistic regression fitted on labelled rows that the counts did not use.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import free_others, hold, settle, trim

ORDER = 6
_WORD = re.compile(r"[^\W_]+")
_BEGIN, _END = "\x02", "\x03"
_DISCOUNT = 0.75
#: Words whose scores are remembered per worker.
REMEMBERED = 150_000
#: Rows scored at a time: the strings of only so many are alive beside their Arrow batch.
SLICE = 500
TOP = 4


def _grams(word: str) -> list[str]:
    padded = _BEGIN * (ORDER - 1) + word + _END
    return [padded[i : i + ORDER] for i in range(len(word) + 1)]


def _backoff(counts: DataFrame, shared: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From both classes' counts (gram, o, t) of one order, with the order below as base: log ratios of seen grams and of contexts.

    ``shared``: pooled probability (gram, p) of each shorter gram.  Where a class lacks the context, its probability is the base's.
    """
    context = F.expr("substring(gram, 1, length(gram) - 1)")
    contexts = counts.groupBy(context.alias("context")).agg(*[x for c in "ot" for x in (F.sum(c).alias(f"total_{c}"), F.count_if(F.col(c) > 0).alias(f"kinds_{c}"))])
    weight = {c: F.when(F.col(f"total_{c}") > 0, F.lit(_DISCOUNT) * F.col(f"kinds_{c}") / F.col(f"total_{c}")).otherwise(1.0) for c in "ot"}
    contexts = contexts.select("context", *[F.greatest(F.col(f"total_{c}"), F.lit(1.0)).alias(f"total_{c}") for c in "ot"], *[weight[c].alias(f"weight_{c}") for c in "ot"])
    both = counts.withColumn("context", context).withColumn("shorter", F.expr("substring(gram, 2)")).join(contexts, "context")
    both = both.join(shared.select(F.col("gram").alias("shorter"), "p"), "shorter", "left")
    p = {c: F.greatest(F.col(c) - _DISCOUNT, F.lit(0.0)) / F.col(f"total_{c}") + F.col(f"weight_{c}") * F.coalesce("p", F.lit(1e-6)) for c in "ot"}
    return both.select("gram", F.log(p["t"] / p["o"]).alias("x")), contexts.select(F.col("context").alias("gram"), F.log(F.col("weight_t") / F.col("weight_o")).alias("x"))


def _lower(grams: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Continuation counts (gram, o, t) of the order below ``grams``, and the pooled probabilities of the two orders below."""
    shorter = F.expr("substring(gram, 2)")
    continued = grams.groupBy(shorter.alias("gram")).agg(F.count_if(F.col("o") > 0).cast("double").alias("o"), F.count_if(F.col("t") > 0).cast("double").alias("t"), F.count("*").alias("n"))
    pooled, shared = continued.select("gram", "n"), []
    for _ in range(2):
        context = F.expr("substring(gram, 1, length(gram) - 1)")
        sums = pooled.groupBy(context.alias("context")).agg(F.sum("n").alias("total"))
        shared.append(pooled.withColumn("context", context).join(sums, "context").select("gram", (F.col("n") / F.col("total")).alias("p")))
        pooled = pooled.groupBy(shorter.alias("gram")).agg(F.count("*").alias("n"))
    return continued.select("gram", "o", "t"), shared


@dataclass
class Model:
    """Log ratios (toxic to ordinary) of grams by order, of contexts by order, and the logistic weights."""

    ratios: list[dict[str, float]]
    contexts: list[dict[str, float]]
    weights: np.ndarray | None = None

    @classmethod
    def fit(cls, grams: DataFrame) -> Model:
        """``grams``: counts (gram, o, t: ordinary, toxic) of every gram of order ORDER."""
        continued, shared = _lower(grams)
        high, low = _backoff(grams, shared[0]), _backoff(continued, shared[1])

        def told(df: DataFrame) -> dict[str, float]:
            rows = df.toArrow()
            return dict(zip(rows.column("gram").to_pylist(), rows.column("x").to_pylist(), strict=True))

        return cls([told(high[0]), told(low[0])], [told(high[1]), told(low[1])])

    def word(self, word: str) -> float:
        """The difference of the word's log-likelihoods under the two models, by its length."""
        total = 0.0
        for gram in _grams(word):
            if (x := self.ratios[0].get(gram)) is not None:
                total += x
                continue
            total += self.contexts[0].get(gram[:-1], 0.0)
            if (x := self.ratios[1].get(gram[1:])) is not None:
                total += x
            else:
                total += self.contexts[1].get(gram[1:-1], 0.0)
        return total / (len(word) + 1)

    def features(self, text: str, known: dict[str, float]) -> list[float]:
        """The TOP highest word scores, their mean over all words, the share of telling words and the log length."""
        words = _WORD.findall(text.lower())
        scores = np.zeros(len(words))
        for i, w in enumerate(words):
            s = known.get(w)
            if s is None:
                if len(known) > REMEMBERED:
                    known.clear()
                s = known[w] = self.word(w)
            scores[i] = s
        n = len(scores)
        top = -np.sort(-(np.partition(scores, n - TOP)[n - TOP :] if n > TOP else np.concatenate([scores, np.zeros(TOP - n)])))
        mean = float(scores.mean()) if n else 0.0
        return [*top.tolist(), mean, float((scores > 0.5).mean()) * 10 if n else 0.0, math.log1p(n) / 5]

    def score(self, features: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(features))
        z = np.column_stack([np.ones(len(features)), features]) @ self.weights
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.02, rounds: int = 40) -> np.ndarray:
    """Weights (bias first) of a logistic regression by Newton's method, classes weighted alike."""
    x = np.column_stack([np.ones(len(x)), x])
    n1 = max(y.sum(), 1)
    n0 = max(len(y) - y.sum(), 1)
    share = np.where(y == 1, len(y) / (2 * n1), len(y) / (2 * n0))
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty)
    ridge[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        gradient = x.T @ (share * (p - y)) + ridge * w
        hessian = (x * (share * p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def held_out() -> Column:
    """True for rows that training never sees."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = 4000) -> Model:
    """Counts come from every labelled document that is neither held out nor among the third kept for the logistic
    regression, and keep every gram; so the model, which is broadcast, grows with the vocabulary of the labelled rows.
    The regression has few weights and takes up to ``rows`` documents of each class (by hash of doc_id) from its third."""
    told = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).where(~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    told = told.withColumn("fits", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(3)) == 0)
    texts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    some = [told.where(F.col("fits") & (F.col("toxic") == c)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for c in (0, 1)]
    sample = settle(texts.join(told.where(~F.col("fits")).unionByName(some[0]).unionByName(some[1]), "doc_id"))

    def count(batches):
        free_others()
        for batch in batches:
            pair: tuple[Counter, Counter] = (Counter(), Counter())
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                words = set(_WORD.findall(text.lower()))
                for word in words:
                    for g in _grams(word):
                        pair[toxic != 0][g] += 1
            names = list(pair[0].keys() | pair[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([float(pair[0][g]) for g in names]), pa.array([float(pair[1][g]) for g in names])], names=["gram", "ordinary", "toxic"])

    counts = settle(sample.where("not fits").select("text", "toxic").mapInArrow(count, "gram string, ordinary double, toxic double").groupBy("gram").agg(F.sum("ordinary").alias("o"), F.sum("toxic").alias("t")))
    model = Model.fit(counts)

    shared = docs.sparkSession.sparkContext.broadcast(model)

    def describe(batches):
        free_others("toxicity fit")
        known: dict[str, float] = {}
        hold("toxicity fit", known.clear)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([shared.value.features(t, known) for t in batch.column("text").to_pylist()], pa.list_(pa.float64())), batch.column("toxic")], names=["x", "toxic"])
        known.clear()

    fitted = sample.where("fits").select("text", "toxic").mapInArrow(describe, "x array<double>, toxic int").toArrow()
    shared.unpersist()
    x, y = np.array(fitted.column("x").to_pylist()), np.array(fitted.column("toxic").to_pylist())
    if len(y) and 0 < (y != 0).sum() < len(y):
        model.weights = logistic(x, (y != 0).astype(float))
    return model


def score(docs: DataFrame, model: Model, threshold: float = 0.7, keep: list[str] | None = None) -> DataFrame:
    """``keep`` (default doc_id), score (0 to 1) and predicted (1 from ``threshold`` on) of each row's whole text.

    Null and empty texts are scored as texts without words.  Repeated rows score alike; ties at the threshold are
    predicted.  Texts of any length are scored whole.  Without labelled rows of both classes every score is 0.  An empty
    table gives an empty result.
    """
    keep = keep or ["doc_id"]
    if clash := {"score", "predicted"} & set(keep):
        raise ValueError(f"cannot keep columns of these names: {sorted(clash)}")
    base = docs.select(*keep, *([] if "text" in keep else [F.col("text").alias("__text")]))
    place = keep.index("text") if "text" in keep else len(keep)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        free_others("toxicity")
        trim()
        known: dict[str, float] = {}
        hold("toxicity", known.clear)
        for batch in (whole.slice(at, SLICE) for whole in batches for at in range(0, whole.num_rows, SLICE)):
            texts = [t or "" for t in batch.column(place).to_pylist()]
            x = np.array([shared.value.features(t, known) for t in texts]).reshape(len(texts), -1)
            p = shared.value.score(x) if len(texts) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32))], names=[*keep, "score", "predicted"])
        known.clear()

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields[: len(keep)])
    return base.mapInArrow(run, f"{kinds}, score double, predicted int")
