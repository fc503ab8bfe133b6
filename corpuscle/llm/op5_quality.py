"""Quality classifier: a sparse ensemble of rules, compiled into Spark columns.

Statistics of each whole text are Spark expressions. Small trees are grown on them
over a bounded sample of labelled rows; every path from a root to a node is a
conjunctive rule; a lasso logistic fit keeps few rules. Rules and weights become one
Spark column, so scoring runs no Python.

Learning is bounded: at most ``PER_CLASS`` labelled rows of each class (see
``labelled.sample``), weighed by the class's share of all labelled rows. Id, language and source are no inputs.

Defined cases: a null or empty text has zero statistics and is scored like any other;
a null doc_id is kept and is not held out; repeated rows are scored each; an empty
table gives an empty result; without labels of both classes every score is 0.5; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.llm.labelled import held_out, sample

PER_CLASS = 6000
TREES, DEPTH, LEAST = 40, 3, 8
#: Lasso penalty a row, and rounds of the fit.
PENALTY, ROUNDS = 0.002, 600

Rule = tuple[tuple[int, bool, float], ...]  # (statistic, above, threshold), all of which hold


def statistics() -> dict[str, Column]:
    """Statistics of the column ``text``, each linear in its length."""
    text = F.coalesce("text", F.lit(""))
    n = F.greatest(F.length(text), F.lit(1))
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    n_words = F.greatest(F.size(words), F.lit(1))

    def share(pattern: str) -> Column:
        return F.regexp_count(text, F.lit(pattern)) / n

    return {
        "log_chars": F.log1p(F.length(text).cast("double")),
        "mean_word": F.length(text) / n_words,
        "distinct_words": F.size(F.array_distinct(words)) / n_words,
        "repeated_next": F.regexp_count(text, F.lit(r"(?<!\S)(\S++)(?=\s\1(?!\S))")) / n_words,
        "upper": share(r"\p{Lu}"),
        "digits": share(r"[0-9]"),
        "symbols": share(r"[^\p{L}\p{N}\s.,]"),
        "stops": share(r"[.!?]"),
        "lines": share(r"\n"),
    }


class Tree:
    """Paths of one classification tree, grown on a bootstrap of the rows."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rng: np.random.Generator):
        self.paths: list[Rule] = []
        self._grow(x, y, (), rng)

    def _grow(self, x: np.ndarray, y: np.ndarray, path: Rule, rng: np.random.Generator) -> None:
        if path:
            self.paths.append(path)
        if len(path) >= DEPTH or len(y) < 2 * LEAST or y.min() == y.max():
            return
        best, total, n = None, y.sum(), len(y)
        for j in rng.choice(x.shape[1], size=max(2, x.shape[1] // 2), replace=False):
            for t in np.unique(np.quantile(x[:, j], np.linspace(0.02, 0.98, 40))):
                above = x[:, j] > t
                k, s = above.sum(), y[above].sum()
                if min(k, n - k) < LEAST:
                    continue
                gain = s * s / k + (total - s) ** 2 / (n - k) + (k - s) ** 2 / k + (n - k - total + s) ** 2 / (n - k)
                if best is None or gain > best[0] + 1e-12:
                    best = gain, int(j), float(t)
        if best is None:
            return
        _, j, t = best
        above = x[:, j] > t
        self._grow(x[above], y[above], (*path, (j, True, t)), rng)
        self._grow(x[~above], y[~above], (*path, (j, False, t)), rng)


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for j, above, t in rule:
        out &= (x[:, j] > t) == above
    return out


def fit_lasso(z: np.ndarray, y: np.ndarray, row: np.ndarray, penalty: float = PENALTY, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Lasso logistic weights and constant, by accelerated proximal gradient; ``row`` weighs rows, 1 on average."""
    n, k = z.shape
    step = 4 * n / max(1e-9, np.linalg.norm(np.sqrt(row)[:, None] * np.hstack([z, np.ones((n, 1))]), 2) ** 2)
    rate = float((row * y).mean())
    b, c = np.zeros(k), float(np.log((rate + 1e-6) / (1 - rate + 1e-6)))
    vb, vc, m = b, c, 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ vb + vc, -30, 30)))
        nb = vb - step * (z.T @ (row * (p - y))) / n
        nb = np.sign(nb) * np.maximum(np.abs(nb) - step * penalty, 0)
        nc = vc - step * float((row * (p - y)).mean())
        nm = (1 + np.sqrt(1 + 4 * m * m)) / 2
        vb, vc = nb + (m - 1) / nm * (nb - b), nc + (m - 1) / nm * (nc - c)
        b, c, m = nb, nc, nm
    return b, c


class RuleModel:
    """Weighted rules over ``names``; an empty model scores 0.5."""

    def __init__(self, names: list[str], rules: list[tuple[Rule, float]], constant: float):
        self.names, self.rules, self.constant = names, rules, constant

    def column(self) -> Column:
        """The score of a row that holds the statistics."""
        margin = F.lit(self.constant)
        for rule, weight in self.rules:
            test = F.lit(True)
            for j, above, t in rule:
                test = test & ((F.col(self.names[j]) > t) if above else (F.col(self.names[j]) <= t))
            margin = margin + F.when(test, weight).otherwise(0.0)
        return 1 / (1 + F.exp(-margin))

    def score(self, documents: DataFrame, threshold: float = 0.3) -> DataFrame:
        """(doc_id, held_out, score, predicted) of every document."""
        used = sorted({self.names[j] for rule, _ in self.rules for j, _, _ in rule})
        stats = statistics()
        rows = documents.select("doc_id", *(stats[k].alias(k) for k in used))
        scored = rows.select("doc_id", held_out().alias("held_out"), self.column().alias("score"))
        return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0).cast("int"))


def fit(documents: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> RuleModel:
    """Grow trees, read their rules and weigh them, over the rows that may be learned from."""
    stats = statistics()
    names = list(stats)
    rows = sample(documents, labels, "quality", per_class).select("doc_id", "y", "n_class", *(v.alias(k) for k, v in stats.items())).collect()
    rows.sort(key=lambda r: (r.doc_id, tuple(r)))
    y = np.array([r.y for r in rows], dtype=float)
    if not len(y) or y.min() == y.max():
        return RuleModel(names, [], 0.0)
    x = np.array([[r[k] for k in names] for r in rows], dtype=float)
    rng = np.random.default_rng(5)
    rules: dict[bytes, Rule] = {}
    for _ in range(TREES):
        take = rng.integers(0, len(y), len(y))
        for path in Tree(x[take], y[take], rng).paths:
            rules.setdefault(np.packbits(holds(path, x)).tobytes(), path)
    z = np.stack([holds(r, x) for r in rules.values()], axis=1).astype(float)
    row = np.array([r.n_class / (y == r.y).sum() for r in rows])  # so that the sample has the classes' shares of all labelled rows
    weights, constant = fit_lasso(z, y, row / row.mean())
    kept = [(r, float(w)) for r, w in zip(rules.values(), weights, strict=True) if abs(w) > 1e-3]
    return RuleModel(names, kept, constant)
