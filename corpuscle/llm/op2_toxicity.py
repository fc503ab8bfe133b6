"""Toxicity: misspelling-tolerant lexicon hits, weighed by their context.

A lexicon of a few fixed terms and of terms and stems learned from labelled rows becomes
one trie; Levenshtein automata of all its terms run along it (``automaton``) and find each
word of a text that is a term or a misspelling. A window of words around each hit
tells quotation (quote marks around it, a word that reports speech) from abuse. A
logistic model over the hits' figures gives the score.

Learning is bounded: at most ``PER_CLASS`` labelled rows of each class (see
``labelled.sample``), at most ``MAX_TERMS`` learned terms. One part of the sample gives
the lexicon, the other the model, so that chance terms get no credit. Every document
is scored over its whole text; id, language and source are no inputs.

Defined cases: a null or empty text has no hit and gets the score of a text without
hits; a null doc_id is kept and is not held out; repeated rows are scored each; an
empty table gives an empty result; without usable labels the fixed terms and preset
weights decide; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuscle.llm.automaton import FuzzyLexicon
from corpuscle.llm.labelled import held_out, sample

PER_CLASS = 6000
MAX_TERMS = 2000
#: Letters of the stems that are learned beside whole words; a term that ends in * is a stem.
STEMS = (4, 5, 6, 7, 8)
#: A word is a term if chance explains its rows with a probability of at most exp(-SURPRISE).
SURPRISE = 15
#: Words on each side of a hit that its context is judged by.
WINDOW = 6

# Terms that count before any label is seen.
SEED_TERMS = ("clown", "disgusting", "idiot", "loser", "moron", "pathetic", "scum", "stupid", "trash", "worthless")
# Words that report or name what others say.
REPORTING = frozenset("said says wrote writes quoted quote called word term phrase sagte schrieb wort dit écrit mot dijo escribió palabra".split())
# Marks that open and close a quotation.
OPEN, CLOSE = "\"“„«‘'", "\"”“»’'"
# Digits and signs that stand for letters.
LEET = str.maketrans("013457@$", "oieastas")

WORD = re.compile(r"\w+(?:[@$*]+\w+)*")
COLUMNS = ("exact", "fuzzy", "quoted", "weight", "density", "rate")
#: Weights of COLUMNS and, last, the constant, where there are too few labels.
PRESET = (1.5, 0.6, -0.3, 0.6, 0.5, 0.1, -3.0)


def learn_lexicon(train: DataFrame, max_terms: int = MAX_TERMS) -> list[tuple[str, float]]:
    """(term, weight) of words far more frequent in toxic than in other rows of ``train``."""
    words = F.filter(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}_]+")), lambda w: F.length(w).between(3, 40))

    def stems(k: int) -> Column:
        return F.transform(F.filter(words, lambda w: F.length(w) > k), lambda w: F.concat(F.substring(w, 1, k), F.lit("*")))

    each = train.dropDuplicates(["text"]).select("y", F.explode(F.array_distinct(F.concat(words, *map(stems, STEMS)))).alias("word"))
    counts = each.groupBy("word").agg(F.sum("y").alias("t"), F.sum(1 - F.col("y")).alias("c"))
    totals = train.dropDuplicates(["text"]).agg(F.sum("y"), F.sum(1 - F.col("y"))).first()
    n_toxic, n_clean = totals[0] or 0, totals[1] or 0
    weight = F.log((F.col("t") + 0.5) / (n_toxic + 1)) - F.log((F.col("c") + 0.5) / (n_clean + 1))
    # a bound of the chance that so many of a word's rows are toxic, as a natural logarithm
    share, n = (n_toxic + 1) / (n_toxic + n_clean + 2), F.col("t") + F.col("c")
    surprise = F.col("t") * F.log(F.col("t") / n / share) + F.when(F.col("c") > 0, F.col("c") * F.log(F.col("c") / n / (1 - share))).otherwise(0.0)
    rows = counts.where(F.col("t") >= max(3, n_toxic // 200)).withColumn("w", weight).where((F.col("w") >= 2.5) & (surprise >= SURPRISE)).orderBy(F.desc("t"), F.desc("w"), "word").limit(max_terms).select("word", "w").collect()
    learned = {r.word: min(float(r.w), 6.0) for r in rows}
    return sorted({**dict.fromkeys(SEED_TERMS, 3.0), **learned}.items())


class Scorer:
    """Figures of one text's hits. Made anew in each task from the lexicon."""

    def __init__(self, lexicon: list[tuple[str, float]]):
        self.weights = {term: w for term, w in lexicon if not term.endswith("*")}
        self.stems = {term[:-1]: w for term, w in lexicon if term.endswith("*")}
        self.fuzzy = FuzzyLexicon(list(self.weights), list(self.stems))
        self.known: dict[str, tuple[float, bool] | None] = {}

    def look(self, word: str) -> tuple[float, bool] | None:
        """(weight, exact) of a word that is a term, begins with a stem, or is a misspelling of a term."""
        hit, begins = self.fuzzy.read(word)
        if hit is not None and hit[0] == 0:
            return self.weights[self.fuzzy.terms[hit[1]]], True
        if begins or word in self.stems:
            return max(self.stems[s] for s in (*(self.fuzzy.stems[i] for i in begins), word) if s in self.stems), True
        if hit is None and any(c in "013457@$*" for c in word) and not word.isdigit():
            hit = self.fuzzy.find(word.translate(LEET))
        return None if hit is None else (self.weights[self.fuzzy.terms[hit[1]]] / (1 + hit[0]), False)

    def figures(self, text: str) -> tuple[float, ...]:
        """COLUMNS of a text."""
        text = text.lower()
        words = WORD.findall(text)
        known, hits = self.known, set()
        if len(known) > 500_000:
            known.clear()
        for word in set(words):
            if word not in known:
                known[word] = self.look(word)
            if known[word] is not None:
                hits.add(word)
        if not hits:
            return (0.0,) * len(COLUMNS)
        exact = fuzzy = quoted = weight = 0.0
        spans = [m.span() for m in WORD.finditer(text)]
        places = [i for i, w in enumerate(words) if w in hits]
        density = 0
        for n, i in enumerate(places):
            w, is_exact = known[words[i]]
            if self.is_quoted(text, words, spans, i):
                quoted += 1
                continue
            exact += is_exact
            fuzzy += not is_exact
            weight = max(weight, w)
            density = max(density, sum(1 for j in places[n : n + 2 * WINDOW] if j <= i + 2 * WINDOW))
        return math.log1p(exact), math.log1p(fuzzy), math.log1p(quoted), weight, math.log1p(density), math.log1p(1000 * exact / len(words))

    @staticmethod
    def is_quoted(text: str, words: list[str], spans: list[tuple[int, int]], i: int) -> bool:
        """Whether quote marks stand around a hit within its window, or it follows a reporting word and a mark."""
        low, high = max(0, i - WINDOW), min(len(words) - 1, i + WINDOW)
        before, after = text[spans[low][0] : spans[i][0]], text[spans[i][1] : spans[high][1] + 1]
        opened = any(before.rfind(o) > before.rfind(c) or (o == c and before.count(o) % 2) for o, c in zip(OPEN, CLOSE, strict=True) if o in before)
        closed = any(c in after for c in CLOSE)
        reported = any(w in REPORTING for w in words[low:i])
        return opened and closed or reported and (opened or closed)


def with_figures(documents: DataFrame, lexicon: list[tuple[str, float]], keep: list[str]) -> DataFrame:
    """(kept, COLUMNS): the columns ``keep`` of ``documents`` as one struct, and the figures of the text."""
    rows = documents.select(F.struct(*keep).alias("kept"), F.col("text").alias("text"))
    schema = T.StructType([rows.schema["kept"], *(T.StructField(c, T.DoubleType()) for c in COLUMNS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(lexicon)
        for batch in batches:
            figures = np.array([scorer.figures(t.as_py() or "") for t in batch.column(1)], dtype=float).reshape(-1, len(COLUMNS))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(figures[:, j]) for j in range(len(COLUMNS)))], ["kept", *COLUMNS])

    return rows.mapInArrow(run, schema)


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Ridge logistic weights by Newton's method, the constant last."""
    x = np.hstack([x, np.ones((len(x), 1))])
    b, penalty = np.zeros(x.shape[1]), np.diag([ridge] * (x.shape[1] - 1) + [1e-4])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + penalty, x.T @ (weight * (p - y)) + penalty @ b)
        b -= step
        if np.abs(step).max() < 1e-6:
            break
    return b


class Model:
    """A lexicon and the logistic weights over its hits' figures."""

    def __init__(self, lexicon: list[tuple[str, float]], weights: list[float]):
        self.lexicon, self.weights = lexicon, weights

    def score(self, documents: DataFrame, keep: list[str] | None = None) -> DataFrame:
        """(doc_id, held_out, score, predicted) of every document; with ``keep``, a struct ``kept`` of those columns for doc_id."""
        rows = with_figures(documents, self.lexicon, keep or ["doc_id"])
        margin = F.lit(self.weights[-1])
        for name, w in zip(COLUMNS, self.weights, strict=False):
            margin = margin + F.col(name) * w
        score = 1 / (1 + F.exp(-margin))
        scored = rows.select("kept", held_out("kept.doc_id").alias("held_out"), score.alias("score"))
        scored = scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int"))
        return scored if keep else scored.select("kept.doc_id", "held_out", "score", "predicted")


def fit(documents: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Learn lexicon and weights from the rows that may be learned from."""
    train = sample(documents, labels, "toxic", per_class).withColumn("part", F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(3)))
    lexicon = learn_lexicon(train.where("part < 2").select("text", "y"))
    rows = with_figures(train.where("part = 2"), lexicon, ["doc_id", "y", "n_class"]).select("kept.*", *COLUMNS).collect()
    rows.sort(key=lambda r: (r.doc_id, tuple(r)))
    y = np.array([r.y for r in rows], dtype=float)
    if min(y.sum(), len(y) - y.sum(), 5) < 5:
        return Model(lexicon, list(PRESET))
    x = np.array([[r[c] for c in COLUMNS] for r in rows])
    share = {k: np.mean(y == k) / next(r.n_class for r in rows if r.y == k) for k in (0, 1)}
    weight = np.array([1 / share[int(k)] for k in y])
    return Model(lexicon, [float(v) for v in fit_logistic(x, y, weight / weight.mean())])
