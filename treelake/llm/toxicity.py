"""Toxicity: a factorization machine over hashed terms.

A text's terms are its distinct words and their first 3, 4, 5 and 6 letters, each
hashed to 32 bits. The machine's log-odds are a bias, a weight for each term and
the dot products of the factor vectors of each pair of terms, so that two terms
that are harmless alone (an insult's word in a quotation, a group's name) can be
toxic together. Terms get parameters for either of two reasons, the others have none:
the labels depend on them alone (chi-square; at most TERMS), or they depend on a pair
of them beyond what either tells alone (the contrast of the four shares of toxic texts,
with both, one, the other and neither; at most PAIR_TERMS), among the pairs of
the PAIR_WORDS words that most texts of the sample have. So words that are neutral
alone and toxic in pairs are learned too.

Fitting takes at most SAMPLE labelled training rows, those with the least
xxhash64 of their id: a bound of the classifier's fit, which the driver's memory
depends on. Scoring covers every row.

Defined cases: a null or empty text has no terms and gets the bias's score;
rows with a null label, a null id or no label are scored, not learned from (a null id counts as not held out); without any
labelled row, or with one class only, all scores are the (smoothed) base rate;
texts are read whole; equal texts get equal scores; an empty table gives an
empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treelake.llm._arrow import col, keep_rows, map_columns, slices
from treelake.llm._spark import written

SAMPLE, TERMS, FACTORS, STEPS = 16_000, 4096, 8, 150
#: Least chi-square of a term and of a pair's contrast, and least rows that have it.
CHI2, PAIR_CHI2, ROWS = 20.0, 40.0, 4
#: Words whose pairs are tried, and most terms that they give.
PAIR_WORDS, PAIR_TERMS = 1024, 128
THRESHOLD = 0.3
_WORD = re.compile(r"[^\W\d_]+")
_PREFIXES = (3, 4, 5, 6)
CACHE = 1 << 17


def word_terms(word: str) -> list[int]:
    found = [zlib.crc32(f"<{word}>".encode())]
    return found + [zlib.crc32(f"<{word[:n]}".encode()) for n in _PREFIXES if len(word) >= n]


def terms(text: str | None) -> set[int]:
    """Hashed terms of a text."""
    return {h for w in set(_WORD.findall((text or "").lower())) for h in word_terms(w)}


class Machine:
    """vocabulary: hashed terms in ascending order; weights (n), factors (n, k)."""

    def __init__(self, vocabulary: np.ndarray, bias: float, weights: np.ndarray, factors: np.ndarray) -> None:
        self.bias, self.weights, self.factors = bias, weights, factors
        self.index = {int(h): k for k, h in enumerate(vocabulary)}
        self.words: dict[str, tuple[int, ...]] = {}

    def _word(self, word: str) -> tuple[int, ...]:
        if len(self.words) >= CACHE:
            self.words.clear()
        found = self.words[word] = tuple(k for h in word_terms(word) if (k := self.index.get(h)) is not None)
        return found

    def scores(self, texts: list[str | None]) -> list[float]:
        out, get, make = [], self.words.get, self._word
        for text in texts:
            at: set[int] = set()
            for w in set(_WORD.findall((text or "").lower())):
                found = get(w)
                if found is None:
                    found = make(w)
                if found:
                    at.update(found)
            z = self.bias
            if at:
                ks = np.fromiter(sorted(at), np.int64, len(at))
                v = self.factors[ks]
                z += self.weights[ks].sum() + 0.5 * ((v.sum(0) ** 2) - (v**2).sum(0)).sum()
            out.append(float(1 / (1 + np.exp(-np.clip(z, -500, 500)))))
        return out


def fit(rows: list[np.ndarray], labels: np.ndarray, vocabulary: np.ndarray | None = None, factors: int = FACTORS, steps: int = STEPS, l2: float = 1e-3, rate: float = 0.05) -> Machine:
    """rows: hashed terms of each text (those of the ascending vocabulary, if given); labels: 0 or 1.

    Full-batch Adam on the logistic loss; deterministic.
    """
    n, positive = len(rows), float(labels.sum())
    bias = float(np.log((positive + 1) / (n - positive + 10)))
    if vocabulary is None:
        vocabulary = np.unique(np.concatenate(rows)) if rows else np.zeros(0, np.int64)
    m = len(vocabulary)
    if not positive or positive == n or not m:
        return Machine(np.zeros(0, np.int64), bias, np.zeros(0), np.zeros((0, factors)))
    row = np.repeat(np.arange(n), [len(r) for r in rows])
    at = np.searchsorted(vocabulary, np.concatenate(rows))
    if not len(at):
        return Machine(np.zeros(0, np.int64), bias, np.zeros(0), np.zeros((0, factors)))
    starts, own = np.unique(row, return_index=True)  # rows with a chosen term, and where each begins
    rng = np.random.default_rng(0)
    p = {"b": np.array([bias]), "w": np.zeros(m), "v": rng.normal(0, 0.01, (m, factors)).astype(np.float32)}
    labels, by_term = labels.astype(np.float32), np.argsort(at, kind="stable")
    have, first = np.unique(at[by_term], return_index=True)
    of_term = row[by_term]
    mean, var = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}
    for t in range(1, steps + 1):
        v = p["v"][at]
        sums = np.zeros((n, factors), np.float32)
        sums[starts] = np.add.reduceat(v, own)
        z = np.full(n, p["b"][0])
        z[starts] += np.add.reduceat(p["w"][at], own) + 0.5 * ((sums[starts] ** 2).sum(1) - np.add.reduceat((v**2).sum(1), own))
        g = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - labels) / n
        # The gradient of a term's factors: over its rows, the sum of g times the row's other factors.
        weight = g[of_term]
        gw, gv = np.zeros(m), np.zeros((m, factors))
        gw[have] = np.add.reduceat(weight, first)
        gv[have] = np.add.reduceat((g[:, None] * sums).astype(np.float32)[of_term], first) - gw[have][:, None] * p["v"][have]
        grad = {"b": np.array([g.sum()]), "w": gw + l2 / n * p["w"], "v": gv + l2 / n * p["v"]}
        for k in p:
            mean[k] += 0.1 * (grad[k] - mean[k])
            var[k] += 0.001 * (grad[k] ** 2 - var[k])
            p[k] -= rate * (mean[k] / (1 - 0.9**t)) / (np.sqrt(var[k] / (1 - 0.999**t)) + 1e-9)
    return Machine(vocabulary, float(p["b"][0]), p["w"], p["v"])


def train(docs: DataFrame, labels: DataFrame, may_learn: Callable[[Column], Column], id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Machine:
    """Fit on at most ``sample`` labelled rows for whose id may_learn holds."""
    key = col(id_col)
    known = labels.select(key.alias("i"), col(label_col).cast("int").alias("y")).where(may_learn(F.col("i")) & F.col("y").isin(0, 1) & F.col("i").isNotNull())
    chosen = known.orderBy(F.xxhash64("i"), "i", "y").limit(sample)
    texts = docs.select(key.alias("i"), col(text_col).cast("string").alias("t"))
    joined = written(texts.join(F.broadcast(chosen), "i").select("i", "t", "y"), "toxicity-sample")  # at most ``sample`` rows
    whole = joined.agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("p")).first()
    if not 0 < whole["p"] < whole["n"]:
        return fit([np.zeros(0, np.int64)] * whole["n"], np.full(whole["n"], float(whole["p"] > 0)))
    counts = written(_term_counts(joined), "toxicity-terms")
    alone = _alone(counts, whole["n"], whole["p"])
    vocabulary = np.union1d(alone, _in_pairs(joined, counts, whole["n"], alone))
    return fit(*_rows_of(joined, vocabulary), vocabulary)


def _rows_of(joined: DataFrame, vocabulary: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Of each row of the sample, in order of id, the hashed terms that are in the vocabulary, and the label."""
    known = joined.sparkSession.sparkContext.broadcast(set(vocabulary.tolist()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashed = [sorted(terms(t.as_py()) & known.value) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2).cast(pa.int32()), pa.array(hashed, pa.list_(pa.int64()))], names=["i", "y", "h"])

    kind = joined.schema["i"].dataType.simpleString()
    got = joined.mapInArrow(run, f"i {kind}, y int, h array<long>").toArrow().sort_by([("i", "ascending"), ("y", "ascending")])
    hashed = got["h"].combine_chunks()
    rows = np.split(hashed.flatten().to_numpy(), np.cumsum(pc.list_value_length(hashed).to_numpy())[:-1])
    return rows, got["y"].to_numpy().astype(float)


def _term_counts(joined: DataFrame) -> DataFrame:
    """(h, whole, have, hit): rows that have a term, and toxic ones; whole: a word and not its first letters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = batch.column(2).to_numpy()
            for a, b in slices(batch.column(1)):
                texts = batch.column(1).slice(a, b - a).to_pylist()
                found = [np.fromiter(x, np.int64, len(x)) for x in map(terms, texts)]
                words = {zlib.crc32(f"<{w}>".encode()) for t in texts for w in set(_WORD.findall((t or "").lower()))}
                flat = np.concatenate(found)
                h, at, have = np.unique(flat, return_inverse=True, return_counts=True)
                hit = np.bincount(at, np.repeat(y[a:b], [len(x) for x in found]), len(h)).astype(np.int64)
                whole = np.isin(h, np.fromiter(words, np.int64, len(words)))
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(whole), pa.array(have), pa.array(hit)], names=["h", "whole", "have", "hit"])

    found = joined.mapInArrow(run, "h long, whole boolean, have long, hit long")
    return found.groupBy("h").agg(F.max("whole").alias("whole"), F.sum("have").alias("have"), F.sum("hit").alias("hit"))


def _alone(counts: DataFrame, n: int, positive: int) -> np.ndarray:
    """Hashed terms of the largest chi-square."""
    share = positive / n
    have = F.col("have").cast("double")
    chi2 = F.pow(F.col("hit") - have * share, F.lit(2.0)) / (have * (share * (1 - share)) * (1 - have / n))
    best = counts.where((F.col("have") >= ROWS) & (F.col("have") < n)).select("h", chi2.alias("x")).where(F.col("x") >= CHI2).orderBy(F.desc("x"), "h").limit(TERMS)
    return best.toPandas()["h"].to_numpy(np.int64)


def _in_pairs(joined: DataFrame, counts: DataFrame, n: int, alone: np.ndarray) -> np.ndarray:
    """Hashed words of the pairs of largest contrast, other than pairs of terms chosen alone. The sample's rows and PAIR_WORDS bound the driver's tables."""
    often = counts.where(F.col("whole") & (F.col("have") >= ROWS) & (F.col("have") < n)).orderBy(F.desc("have"), "h").limit(PAIR_WORDS)
    words = np.sort(often.toPandas()["h"].to_numpy(np.int64))
    if len(words) < 2:
        return words[:0]
    rows, labels = _rows_of(joined, words)
    x = np.zeros((len(rows), len(words)), np.float32)
    x[np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.searchsorted(words, np.concatenate(rows))] = 1
    return np.unique(words[np.stack(pair_contrasts(x, labels, np.isin(words, alone))[:2])])


def pair_contrasts(x: np.ndarray, labels: np.ndarray, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, z squared) of columns a < b of 0 and 1 whose pair tells of the labels beyond either, the largest first; at most PAIR_TERMS columns.

    Pairs of two ``known`` columns are left out.
    """
    n, toxic = len(x), float(labels.sum())
    both, hits = x.T @ x, x.T @ (x * labels[:, None].astype(np.float32))
    have, hit = both.diagonal().copy(), hits.diagonal().copy()
    contrast, variance = 0.0, 0.0
    for sign, m, k in (
        (1, both, hits),
        (-1, have[:, None] - both, hit[:, None] - hits),
        (-1, have[None, :] - both, hit[None, :] - hits),
        (1, n - have[:, None] - have[None, :] + both, toxic - hit[:, None] - hit[None, :] + hits),
    ):
        share = (k + 0.5) / (m + 1)
        contrast = contrast + sign * share
        variance = variance + share * (1 - share) / (m + 1)
    z = np.triu(contrast**2 / variance, 1)
    z[both < ROWS] = 0
    if known is not None:
        z[np.ix_(known, known)] = 0
    a, b = np.nonzero(z >= PAIR_CHI2)
    order = np.lexsort((b, a, -z[a, b]))
    a, b = a[order], b[order]
    seen, new = np.unique(np.stack([a, b], 1).reshape(-1), return_index=True)
    if len(seen) > PAIR_TERMS:
        end = np.sort(new)[PAIR_TERMS] // 2
        a, b = a[:end], b[:end]
    return a, b, z[a, b]


def score(docs: DataFrame, machine: Machine, held_out: Column, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, held_out, score, predicted) of every text."""
    held = docs.sparkSession.sparkContext.broadcast(machine)
    kind = docs.select(col(id_col)).schema[0].dataType.simpleString()

    def start():
        machine = held.value

        def run(ids, texts, out):
            s = machine.scores(texts)
            yield {"i": ids, "held_out": out, "score": s, "predicted": [int(x >= threshold) for x in s]}

        return run

    rows = docs.select(col(id_col).alias("i"), col(text_col).cast("string").alias("t"), held_out.alias("h"))
    out = map_columns(rows, f"i {kind}, held_out boolean, score double, predicted int", start)
    return out.selectExpr(f"i as `{id_col}`", "held_out", "score", "predicted")


def keep_clean(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Rows of docs, all columns, whose score is below the threshold."""
    held = docs.sparkSession.sparkContext.broadcast(machine)

    def start():
        machine = held.value
        return lambda texts: [s < threshold for s in machine.scores(texts)]

    return keep_rows(docs, id_col, text_col, start)
