"""Toxicity by maximum-scoring segments.

Words get log-odds of toxic against clean training documents under a Dirichlet prior; words and
word beginnings whose odds differ significantly make up a lexicon, all other words cost a little.
A linear-time scan (Ruzzo and Tompa) finds every maximal-scoring segment of a text. Segment scores
of clean text follow an extreme-value law, P(S >= x) = 1 - exp(-K n exp(-lambda x)) for n words, so
each segment gets a significance that allows for the text's length; a document's evidence is the
sum over its segments, which a logistic curve turns into a probability.

Scores depend on the text alone. Training reads labelled rows outside the held-out fold, at most
``TOXIC_ROWS`` and ``CLEAN_ROWS`` of them in an order hashed from their ids; scoring reads every
row's whole text in one narrow pass. The lexicon is broadcast; it holds every significant entry of
the training sample, whose size bounds it.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import pieces, settle, text_of

#: Bounds of the training sample, a class each.
TOXIC_ROWS, CLEAN_ROWS = 10_000, 10_000
#: Least log-likelihood ratio (G squared) of an entry.
SIGNIFICANT = 24.0
#: Lengths of word beginnings that can be entries, and the prior count of an entry in either class.
BEGINNINGS, PRIOR = (4, 5, 6, 7), 0.5
#: Probability by chance up to which a passage counts as significant.
ALPHA = 0.05
#: Score from which a document is taken for toxic.
THRESHOLD = 0.3
#: Words whose score a worker remembers.
REMEMBERED = 1 << 18

#: Numerals that aren't decimal digits, which Python counts among the characters of words. Those beyond
#: U+FFFF are left out: a set with them is searched one by one at every letter.
_NUMERALS = "".join(c for c in map(chr, range(0x10000)) if c.isalnum() and not c.isalpha() and not c.isdecimal())
#: A run of letters, as \\p{L}+ is to the JVM.
WORD = re.compile(rf"[^\W\d_{_NUMERALS}]+")


@dataclass
class ToxicityModel:
    """Fitted parameters; small, and the same on every executor."""

    lexicon: dict[str, float] = field(default_factory=dict)
    gap: float = 0.02
    rate: float = 1.0
    k: float = 0.1
    intercept: float = -3.0
    slope: float = 1.0


def held_out(id_column: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves the remainder 2 by 4; null ids: false."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 4 == 2, F.lit(False))


class _Scores(dict):
    """Score of each word: that of itself, or of its longest known beginning; 0 if none."""

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: str) -> float:
        found = self.lexicon.get("=" + word)
        for n in sorted(BEGINNINGS, reverse=True):
            if found is None and len(word) >= n:
                found = self.lexicon.get(word[:n])
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = found = found or 0.0
        return found


def segments(hits: list[tuple[int, float]], gap: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first word, last word, score) of a sequence.

    hits are the words with positive scores in order; each word between them costs ``gap``. The scan
    keeps candidates with their cumulative scores before and after, joins what improves by joining
    and takes time linear in the hits.
    """
    stack: list[tuple[int, int, float, float]] = []
    total, at = 0.0, 0
    for place, score in hits:
        before = total - gap * (place - at)
        first, last, left, right = place, place, before, before + score
        total, at = right, place + 1
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= left:
                j -= 1
            if j < 0 or stack[j][3] >= right:
                stack.append((first, last, left, right))
                break
            first, left = stack[j][0], stack[j][2]
            del stack[j:]
    return [(first, last, right - left) for first, last, left, right in stack]


class Scorer:
    def __init__(self, model: ToxicityModel):
        self.model, self.scores = model, _Scores(model.lexicon)

    def evidence(self, text: str | None) -> tuple[int, float, list[tuple[int, int, float, float]]]:
        """Words of the text, its evidence, and its significant passages (first word, last word,
        score, probability by chance)."""
        words = WORD.findall((text or "").lower())
        hits = [(i, s) for i, s in enumerate(map(self.scores.__getitem__, words)) if s]
        if not hits:
            return len(words), 0.0, []
        model, evidence, passages = self.model, 0.0, []
        for first, last, score in segments(hits, model.gap):
            excess = model.rate * score - math.log(model.k * len(words))
            chance = -math.expm1(-math.exp(min(-excess, 50.0)))
            evidence += max(0.0, excess)
            if chance <= ALPHA:
                passages.append((first, last, score, chance))
        return len(words), evidence, passages

    def score(self, evidence: float) -> float:
        x = self.model.intercept + self.model.slope * math.log1p(evidence)
        return 1.0 / (1.0 + math.exp(-max(-60.0, min(60.0, x))))


def training_rows(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", label: str = "toxic") -> tuple[DataFrame, dict[int, int]]:
    """Settled (toxic, text) of the training sample, and the number of labelled rows by class.

    Labels of the held-out fold and null labels are left out; an id with several labels counts as
    toxic if one says so. Of rows that repeat an id the one with the smallest text counts.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col(id_column).isNotNull() & ~held_out(id_column)).groupBy(id_column).agg(F.max((F.col(label) > 0).cast("int")).alias("__toxic"))
    known = settle(known, "labels")
    totals = {r["__toxic"]: r["count"] for r in known.groupBy("__toxic").count().collect()}
    drawn = [known.filter(F.col("__toxic") == c).orderBy(F.xxhash64(id_column), id_column).limit(n) for c, n in ((1, TOXIC_ROWS), (0, CLEAN_ROWS))]
    sample = drawn[0].unionByName(drawn[1]).withColumnRenamed(id_column, "__id")
    rows = docs.select(F.col(id_column).alias("__of"), text_of("text").alias("text")).join(F.broadcast(sample), F.col("__of") == F.col("__id"))
    rows = rows.groupBy("__of", "__toxic").agg(F.min("text").alias("text"))
    return settle(rows.select(F.col("__toxic").alias("toxic"), "text"), "training"), totals


def fit_lexicon(rows: DataFrame) -> tuple[dict[str, float], float]:
    """Entries with their log-odds, and the cost of a word that is none.

    Counts are of contexts: a word counts once with each word that follows it, in each class, so that
    copies of one document, exact or near, don't pass for many. "=word" stands for a whole word, a
    bare string for a beginning.
    """
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))
    pairs = rows.withColumn("words", words).select("toxic", F.explode(F.arrays_zip(F.col("words").alias("word"), F.slice("words", 2, F.greatest(F.size("words"), F.lit(1))).alias("next"))).alias("x"))
    contexts = pairs.select("toxic", "x.word", F.xxhash64("x.next").alias("next")).filter(F.length("word") >= 3).groupBy("word", "next").agg(F.max("toxic").alias("t"), F.max(1 - F.col("toxic")).alias("c"))
    counts = settle(contexts.groupBy("word").agg(F.sum("t").alias("t"), F.sum("c").alias("c")), "words")
    sums = counts.agg(F.sum("t"), F.sum("c")).first()
    n_toxic, n_clean = float(sums[0] or 0), float(sums[1] or 0)
    if not n_toxic or not n_clean:
        return {}, ToxicityModel.gap
    entries = F.array(F.concat(F.lit("="), F.col("word")), *[F.when(F.length("word") >= n, F.substring("word", 1, n)) for n in BEGINNINGS])
    features = counts.select("t", "c", F.explode(entries).alias("entry")).filter("entry IS NOT NULL").groupBy("entry").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    share = n_toxic / (n_toxic + n_clean)
    t, c = F.col("t"), F.col("c")
    part = lambda seen, expected: F.when(seen > 0, seen * F.ln(seen / expected)).otherwise(0.0)
    g2 = 2 * (part(t, (t + c) * share) + part(c, (t + c) * (1 - share)))
    odds = F.ln((t + PRIOR) / n_toxic) - F.ln((c + PRIOR) / n_clean)
    best = features.withColumn("odds", odds).withColumn("g2", g2).filter((F.col("odds") > 1) & (F.col("g2") >= SIGNIFICANT)).orderBy("entry")
    found = best.select("entry", "odds", "t", "c").collect()
    whole = [r for r in found if r["entry"].startswith("=")]
    of_toxic, of_clean = sum(r["t"] for r in whole) / n_toxic, sum(r["c"] for r in whole) / n_clean
    gap = math.log((1 - min(of_clean, 0.9)) / (1 - min(of_toxic, 0.9)))
    return {r["entry"]: r["odds"] for r in found}, max(ToxicityModel.gap, gap)


def fit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id") -> ToxicityModel:
    """Fit lexicon, extreme-value parameters and calibration. Without labels of both classes the
    lexicon is empty and every score is the base rate."""
    rows, totals = training_rows(docs, labels, id_column)
    model = ToxicityModel()
    everything = sum(totals.values())
    base = (totals.get(1, 0) + 0.5) / (everything + 1.0) if everything else 0.05
    model.intercept = math.log(base / (1 - base))
    model.lexicon, model.gap = fit_lexicon(rows)
    if not model.lexicon:
        return model
    # each training document: its best segment under the clean law, and its evidence under that law
    best = np.array(_scored(rows, model, "best").select("toxic", "n_words", "value").collect(), dtype=float).reshape(-1, 3)
    clean = best[(best[:, 0] == 0) & (best[:, 2] > 0)]
    if len(clean) >= 20:
        model.k = float(np.clip(np.exp(np.mean(model.rate * clean[:, 2] - 0.5772 - np.log(clean[:, 1]))), 1e-4, 10.0))
    pairs = np.array(_scored(rows, model, "evidence").select("toxic", "value").collect(), dtype=float).reshape(-1, 2)
    weight = np.where(pairs[:, 0] > 0, totals.get(1, 0) / max(1, (pairs[:, 0] > 0).sum()), totals.get(0, 0) / max(1, (pairs[:, 0] == 0).sum()))
    model.intercept, model.slope = _logistic(np.log1p(pairs[:, 1]), pairs[:, 0], weight)
    return model


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.05) -> tuple[float, float]:
    """Intercept and slope of a weighted logistic curve, by Newton steps; the ridge keeps the slope finite."""
    a = np.stack([np.ones_like(x), x], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        pull = np.array([1e-6, ridge])
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + np.diag(pull), a.T @ (weight * (y - p)) - pull * w)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), max(0.0, float(w[1]))


def _scored(rows: DataFrame, model: ToxicityModel, what: str) -> DataFrame:
    """(toxic, n_words, value) of training rows; value: the best segment's score or the evidence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch, texts in pieces(batches, "text"):
            sizes, values = [], []
            for text in texts:
                n, evidence, _ = scorer.evidence(text)
                if what == "best":
                    words = WORD.findall(text.lower())
                    hits = [(i, s) for i, s in enumerate(map(scorer.scores.__getitem__, words)) if s]
                    evidence = max((s for _, _, s in segments(hits, model.gap)), default=0.0)
                sizes.append(n)
                values.append(evidence)
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(sizes, pa.int64()), pa.array(values, pa.float64())], names=["toxic", "n_words", "value"])

    return rows.select("toxic", "text").mapInArrow(run, "toxic int, n_words long, value double")


PASSAGE = T.StructType([T.StructField("first_word", T.IntegerType()), T.StructField("last_word", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType()), T.StructField("chance", T.DoubleType())])


def _spans(text: str, passages: list[tuple[int, int, float, float]]) -> list[dict]:
    """Passages with their code-point offsets in the text as lower-cased."""
    if not passages:
        return []
    places = [m.span() for m in WORD.finditer(text.lower())]
    return [{"first_word": a, "last_word": b, "start": places[a][0], "end": places[b][1], "score": s, "chance": p} for a, b, s, p in passages]


def score(docs: DataFrame, model: ToxicityModel, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add toxicity (0 to 1), evidence and passages, the significant toxic passages of each text.

    Null and empty texts score by the base rate of documents without evidence. Narrow, with no
    shuffle; columns of docs that have the outputs' names are replaced.
    """
    new = ["toxicity", "evidence", "passages"]
    kept = [c for c in (docs.columns if keep is None else keep) if c not in new]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField("toxicity", T.DoubleType()), T.StructField("evidence", T.DoubleType()), T.StructField("passages", T.ArrayType(PASSAGE))])
    of = text if text in kept else "__text"
    shared = docs.sparkSession.sparkContext.broadcast(model)
    arrow_passages = pa.list_(pa.struct([("first_word", pa.int32()), ("last_word", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("chance", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch, texts in pieces(batches, of):
            scores, evidences, passages = [], [], []
            for value in texts:
                _, evidence, found = scorer.evidence(value)
                scores.append(scorer.score(evidence))
                evidences.append(evidence)
                passages.append(_spans(value or "", found))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(scores, pa.float64()), pa.array(evidences, pa.float64()), pa.array(passages, arrow_passages)], names=kept + new)

    return docs.select(*kept, *([] if text in kept else [F.col(text).alias("__text")])).mapInArrow(run, schema)
