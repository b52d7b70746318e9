"""Toxic passages by maximum-scoring segments over token log-odds.

Learning counts, over a bounded sample of labelled texts, in how many toxic and other texts a unit occurs. Units are
whole words and word beginnings of 3 to 6 letters, so that inflected forms of a toxic stem count together. A unit's
log-odds have a Dirichlet prior in proportion to its overall frequency; units with large and
significant log-odds (by the likelihood-ratio test) form the lexicon. A token scores the highest of its units, divided by
how often the text has used it so far, and DRIFT below zero without one, so that the expected
score is negative and all maximal-scoring segments are found in one linear scan. Segment scores are put on the scale
of extreme-value theory, S' = lambda S - ln(K n), with lambda and K fitted on non-toxic texts; a text's evidence, the
log of its summed exp(S'), becomes a probability by a logistic curve. Both are fitted with the lexicon in use, on the
texts that did not teach it, one in CALIBRATE of the sampled ones.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hingeworks.llm.common import text_batches

#: Labelled texts that teach at most, in expectation; beyond that an even sample by hash of the id is taken.
MAX_TRAIN = 24_000
CALIBRATE = 10
#: Units in the lexicon at most, the most significant first.
MAX_UNITS = 20_000
#: Prior weight in texts; a lexicon unit's least number of toxic texts, least z-score and least log-odds.
PRIOR, LEAST_TEXTS, LEAST_Z, LEAST_ODDS = 10.0, 3, 3.5, 2.5
DRIFT, MOST = 0.15, 6.0
#: A segment is significant below this expected number of equal or better chance segments in a text of its length.
SIGNIFICANT = 0.05
THRESHOLD = 0.3
STEMS = (3, 4, 5, 6)
_TOKEN = re.compile(r"\w+")


def tokens(text: str | None) -> list[str]:
    return _TOKEN.findall((text or "").lower())


def units(token: str) -> list[str]:
    """The whole word, marked at its end, and its beginnings."""
    return [token + "$", *(token[:n] for n in STEMS if len(token) >= n)]


def segments(scores: list[tuple[int, float]], n: int, drift: float = DRIFT) -> list[tuple[float, int, int]]:
    """All maximal-scoring segments (score, start, end) of n tokens that score -drift but for the given (place, score).

    One pass in linear time. A candidate keeps the sum before it (left), the sum through it (right) and a link to the
    nearest earlier candidate of lower left sum; a new one follows these links to find its own, so that what a link has
    passed over is never looked at again. If that earlier one's right sum is lower than the new one's, all from it on
    become one candidate, else the new one is added.
    """
    stack: list[tuple[float, float, int, int, int]] = []  # left sum, right sum, start, end, link
    total, last = 0.0, -1
    for at, score in scores:
        left = total - drift * (at - last - 1)
        total, last = left + score, at
        if score <= 0:
            continue
        start, j = at, len(stack) - 1
        while True:
            while j >= 0 and stack[j][0] >= left:
                j = stack[j][4]
            if j < 0 or stack[j][1] >= total:
                stack.append((left, total, start, at + 1, j))
                break
            left, _, start, _, link = stack[j]
            del stack[j:]
            j = link
    return [(r - l, a, b) for l, r, a, b, _ in stack]


@dataclass
class Model:
    lexicon: dict[str, float] = field(default_factory=dict)
    decay: float = 1.0
    k: float = 1.0
    curve: tuple[float, float] = (0.0, -3.0)
    cache: dict[str, float] = field(default_factory=dict)

    def __getstate__(self):
        return self.__dict__ | {"cache": {}}

    def token_score(self, token: str) -> float:
        known = [u for u in units(token) if u in self.lexicon]
        return max(self.lexicon[u] for u in known) if known else 0.0

    def scan(self, text: str | None) -> tuple[int, list[tuple[float, int, int]]]:
        """Number of tokens and all maximal segments of the whole text."""
        words, cache = tokens(text), self.cache
        if len(cache) > 300_000:
            cache.clear()
        scores, used = [], Counter()
        for i, w in enumerate(words):
            s = cache.get(w)
            if s is None:
                s = cache[w] = self.token_score(w)
            if s:
                used[w] += 1
                scores.append((i, s / used[w] - DRIFT))
        return len(words), segments(scores, len(words))

    def evidence(self, n: int, found: list[tuple[float, int, int]]) -> tuple[float, list[tuple[float, int, int]]]:
        """Log of the summed exp(S') (a floor of ln(1e-3) counts for chance), and the significant segments."""
        scaled = [self.decay * s - math.log(max(self.k * n, 1e-9)) for s, _, _ in found]
        sure = [f for f, x in zip(found, scaled) if math.exp(-min(x, 700.0)) <= SIGNIFICANT]
        return float(np.logaddexp.reduce([math.log(1e-3), *(min(x, 60.0) for x in scaled)])), sure

    def score(self, text: str | None) -> tuple[float, list[tuple[float, int, int]]]:
        x, sure = self.evidence(*self.scan(text))
        a, b = self.curve
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a * x + b)))), sure


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """(text, toxic, part) of labelled texts outside the held-out part, equal texts once; part 0 teaches, part 1 calibrates."""
    own = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic")).where("id is not null and toxic is not null")
    own = own.where(~held_out(F.col("id"))).groupBy("id").agg(F.max("toxic").alias("toxic"))
    n = own.count()
    share = min(1.0, most / max(n, 1))
    kept = own.where(F.pmod(F.xxhash64(F.col("id")), F.lit(1 << 30)) < int(share * (1 << 30)))
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").where("text is not null")
    joined = texts.join(F.broadcast(kept), "id")  # most ids and labels, a bounded sample
    return joined.groupBy("text").agg(F.max("toxic").alias("toxic"), (F.min(F.pmod(F.xxhash64("id"), F.lit(CALIBRATE))) == 3).cast("int").alias("part"))


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN) -> Model:
    """Learn from documents (doc_id, text) and labels (doc_id, toxic), held-out documents left aside.

    Without toxic or without other labelled texts the model has an empty lexicon and gives every text the same score.
    """
    text_batches(docs.sparkSession)
    taught = sample(docs, labels, most).cache()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter[str], Counter[str]] = (Counter(), Counter())  # by label
        for batch in batches:
            for text, bad in zip(*(batch.column(c).to_pylist() for c in ("text", "toxic"))):
                seen[bad == 1].update({u for w in set(tokens(text)) for u in units(w)})
        names = list(set().union(*seen))
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([c[x] for x in names], pa.int64()) for c in seen)], ["unit", "z", "y"])

    size = {(r.part, r.toxic == 1): r.n for r in taught.groupBy("part", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    counts = taught.where("part = 0").mapInArrow(count, "unit string, z long, y long").groupBy("unit").agg(F.sum("z").alias("z"), F.sum("y").alias("y"))
    model, bad, good = Model(), float(size.get((0, True), 0)), float(size.get((0, False), 0))
    if bad and good:
        y, z = F.col("y"), F.col("z")
        prior = F.lit(PRIOR) * (y + z + 1) / F.lit(bad + good + 2)
        odds = lambda k, n: F.log((k + prior) / (F.lit(n + PRIOR) - k - prior + 1e-9))
        part = lambda k, n: F.when(k > 0, k * F.log(k / ((y + z) * (n / (bad + good))))).otherwise(F.lit(0.0))
        rated = counts.where(y >= LEAST_TEXTS).select("unit", (odds(y, bad) - odds(z, good)).alias("odds"), F.sqrt(F.greatest(F.lit(0.0), 2 * (part(y, bad) + part(z, good)))).alias("rank"))
        best = rated.where((F.col("rank") >= LEAST_Z) & (F.col("odds") >= LEAST_ODDS)).orderBy(F.desc("rank"), "unit").limit(MAX_UNITS).collect()
        model.lexicon = {r.unit: min(r.odds, MOST) for r in best}
    _calibrate(model, taught.where("part = 1").select("text", "toxic"))
    taught.unpersist()
    return model


def _calibrate(model: Model, texts: DataFrame) -> None:
    """Fit lambda and K on non-toxic texts, then the logistic curve.

    The segment scores of the sampled texts reach the driver, those of one in CALIBRATE of MAX_TRAIN at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.scan(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array([n for n, _ in found], pa.int64()), pa.array([[s for s, _, _ in f] for _, f in found], pa.list_(pa.float64()))], ["toxic", "n", "scores"])

    rows = texts.mapInArrow(run, "toxic int, n long, scores array<double>").collect()
    clean = [(r.n, max(r.scores)) for r in rows if not r.toxic and r.scores]
    quiet = sum(1 for r in rows if not r.toxic)
    if clean:
        # scores beyond x0 of chance segments fall off as exp(-lambda (x - x0)); their rate a token gives K
        best = np.sort([s for _, s in clean])
        excess = best - best[0]
        model.decay = float(np.clip(1 / max(excess.mean(), 1e-6), 0.3, 3.0))
        rate = len(clean) / max(1.0, float(sum(r.n for r in rows if not r.toxic)))
        model.k = rate * math.exp(model.decay * float(best[0]))
    else:
        model.k = 1 / max(1.0, float(sum(r.n for r in rows if not r.toxic)) or quiet or 1)
    data = [(model.evidence(r.n, [(s, 0, 0) for s in r.scores])[0], int(r.toxic == 1)) for r in rows]
    if len({y for _, y in data}) < 2:
        return
    x, y = np.array(data, dtype=float).T
    up, down = y.sum(), len(y) - y.sum()
    goal = np.where(y == 1, (up + 1) / (up + 2), 1 / (down + 2))  # smoothed targets keep separable data finite
    a, b = 0.0, math.log((up + 1) / (down + 1))
    loss = lambda a, b: (np.logaddexp(0, a * x + b) - goal * (a * x + b)).sum() + 5e-3 * a * a
    for _ in range(100):  # Newton steps, halved until they help
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = p * (1 - p) + 1e-9
        g = np.array([((p - goal) * x).sum() + 1e-2 * a, (p - goal).sum()])
        h = np.array([[(w * x * x).sum() + 1e-2, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-9]])
        step, rate = np.linalg.solve(h, g), 1.0
        while rate > 1e-6 and loss(a - rate * step[0], b - rate * step[1]) > loss(a, b):
            rate /= 2
        a, b = a - rate * step[0], b - rate * step[1]
        if rate * np.abs(step).max() < 1e-8:
            break
    model.curve = (max(0.0, float(a)), float(b))


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, score, passages): passages lists the significant toxic ones as (score, first token, end token).

    Whole texts are scanned; null and empty texts have no passage and the score of no evidence. Repeated rows stay,
    other columns are ignored, an empty table gives no rows.
    """
    passage = pa.list_(pa.struct([("score", pa.float64()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.score(t) for t in batch.column("text").to_pylist()]
            spans = [[{"score": s, "start": a, "end": b} for s, a, b in f] for _, f in found]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([p for p, _ in found], pa.float64()), pa.array(spans, passage)], ["id", "score", "passages"])

    text_batches(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return own.mapInArrow(run, "id long, score double, passages array<struct<score:double,start:int,end:int>>")


def reject_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns kept, whose text scores below the threshold."""
    text_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [model.score(t)[0] < threshold for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted for every text of `documents`; n_passages counts the significant ones."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    found = scored(docs, model)
    return found.select(
        F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), F.size("passages").alias("n_passages")
    )
