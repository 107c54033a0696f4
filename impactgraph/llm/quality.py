"""Quality scores from a sparse rule ensemble.

Statistics of the text are Spark columns. On a bounded sample of labelled rows, boosted shallow trees propose rules: the path to each node
is a conjunction of thresholds. A lasso logistic fit keeps few of them, and the kept rules compile into one Spark column, so
scoring is one projection without a shuffle or Python.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, spare
from .toxicity import examples, remainder

MARKS, DIGITS, CAPITALS = "|$%#&*@!~^<>{}[]=_+\\", "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
OUT = ("score", "predicted", "held_out")


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a whole text; an empty one has zeros. Ratios are per character, word or line."""
    t = F.coalesce(text, F.lit(""))
    chars = F.char_length(t)
    words, lines = F.split(t, " "), F.split(t, "\n")
    per = lambda a, b: F.coalesce(a / F.when(b > 0, b), F.lit(0.0))
    lost = lambda signs: chars - F.char_length(F.translate(t, signs, ""))
    marks, n_words = lost(MARKS), F.size(words)
    distinct = F.size(F.array_distinct(words))
    return {
        "log_chars": F.log1p(chars.cast("double")),
        "log_words": F.log1p(n_words.cast("double")),
        "word_length": per(chars.cast("double"), n_words),
        "distinct_words": per(distinct.cast("double"), n_words),
        "distinct_root": per(distinct.cast("double"), F.sqrt(n_words.cast("double"))),
        "distinct_lines": per(F.size(F.array_distinct(lines)).cast("double"), F.size(lines)),
        "line_words": per(n_words.cast("double"), F.size(lines)),
        "marks": per(marks.cast("double"), chars),
        "marks_word": per(marks.cast("double"), n_words),
        "digits": per(lost(DIGITS).cast("double"), chars),
        "capitals": per(lost(CAPITALS).cast("double"), chars),
        "stops": per(lost(".,;:?").cast("double"), n_words),
    }


NAMES = ["log_chars", "log_words", "word_length", "distinct_words", "distinct_root", "distinct_lines", "line_words", "marks", "marks_word", "digits", "capitals", "stops"]
Rule = tuple[tuple[int, bool, float], ...]


def _split(x: np.ndarray, g: np.ndarray, h: np.ndarray, least: int) -> tuple[float, int, float]:
    """(gain, feature, threshold) of the best cut of Newton statistics; rows go left when x <= threshold."""
    best = (1e-9, -1, 0.0)
    base = g.sum() ** 2 / (h.sum() + 1)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, gl, hl = x[order, f], np.cumsum(g[order]), np.cumsum(h[order])
        at = np.flatnonzero(v[:-1] < v[1:])
        at = at[(at + 1 >= least) & (len(v) - at - 1 >= least)]
        if len(at):
            gain = gl[at] ** 2 / (hl[at] + 1) + (gl[-1] - gl[at]) ** 2 / (hl[-1] - hl[at] + 1) - base
            i = int(gain.argmax())
            if gain[i] > best[0]:
                best = (float(gain[i]), f, float((v[at[i]] + v[at[i] + 1]) / 2))
    return best


def tree_rules(x: np.ndarray, y: np.ndarray, trees: int = 30, depth: int = 3, rate: float = 0.3, least: int = 8) -> list[Rule]:
    """The paths to all nodes of boosted trees, each once: conjunctions of (feature, above, threshold)."""
    rules: dict[Rule, None] = {}
    p = min(max(float(y.mean()), 0.01), 0.99)
    margin = np.full(len(y), np.log(p / (1 - p)))

    def grow(rows: np.ndarray, path: Rule, g, h, left: int) -> None:
        if path:
            rules[tuple(sorted(path))] = None
        cut = _split(x[rows], g[rows], h[rows], least) if left and len(rows) >= 2 * least else (0, -1, 0)
        if cut[1] < 0:
            margin[rows] += rate * np.clip(-g[rows].sum() / (h[rows].sum() + 1), -4, 4)
            return
        below = x[rows, cut[1]] <= cut[2]
        grow(rows[below], (*path, (cut[1], False, cut[2])), g, h, left - 1)
        grow(rows[~below], (*path, (cut[1], True, cut[2])), g, h, left - 1)

    for _ in range(trees):
        q = 1 / (1 + np.exp(-margin))
        grow(np.arange(len(y)), (), q - y, q * (1 - q), depth)
    return list(rules)


def applies(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for f, above, t in rule:
        out &= (x[:, f] > t) if above else (x[:, f] <= t)
    return out


def lasso(a: np.ndarray, y: np.ndarray, w: np.ndarray, strength: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Logistic regression with an l1 penalty, by accelerated proximal steps; the intercept is free."""
    w = w / w.sum()
    d = np.concatenate((np.ones((len(a), 1)), a), axis=1)
    size = 4.0 / max(np.linalg.norm((d * w[:, None] ** 0.5), 2) ** 2, 1e-9)
    beta = point = np.zeros(d.shape[1])
    speed = 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(d @ point, -30, 30)))
        nxt = point - size * (d.T @ (w * (p - y)))
        nxt[1:] = np.sign(nxt[1:]) * np.maximum(np.abs(nxt[1:]) - size * strength, 0)
        faster = (1 + (1 + 4 * speed * speed) ** 0.5) / 2
        point = nxt + (speed - 1) / faster * (nxt - beta)
        beta, speed = nxt, faster
    return float(beta[0]), beta[1:]


def fit(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, list[tuple[Rule, float]]]:
    """Intercept and weighted rules; the penalty is the one with the least loss on every fourth row."""
    if not len(y) or y.min() == y.max():
        rate = (float(y.sum()) + 0.5) / (len(y) + 1.0)
        return float(np.log(rate / (1 - rate))), []
    rules = tree_rules(x, y)
    a = np.stack([applies(r, x) for r in rules], axis=1).astype(float)
    scale = np.maximum(a.std(axis=0), 0.05)
    test = np.arange(len(y)) % 4 == 3
    losses = []
    for strength in (0.03, 0.01, 0.003, 0.001):
        b, beta = lasso((a / scale)[~test], y[~test], w[~test], strength)
        p = np.clip(1 / (1 + np.exp(-(b + (a / scale)[test] @ beta))), 1e-6, 1 - 1e-6)
        losses.append((float(-(w[test] * (y[test] * np.log(p) + (1 - y[test]) * np.log(1 - p))).sum()), strength))
    b, beta = lasso(a / scale, y, w, min(losses)[1], 800)
    return b, [(r, float(v / s)) for r, v, s in zip(rules, beta, scale, strict=True) if abs(v) > 1e-4]


def compile_rules(intercept: float, rules: list[tuple[Rule, float]], columns: list[Column]) -> Column:
    """The ensemble as a Spark column: a logistic of the weights of the rules that apply."""
    total = F.lit(intercept)
    for rule, weight in rules:
        holds = None
        for f, above, t in rule:
            one = columns[f] > t if above else columns[f] <= t
            holds = one if holds is None else holds & one
        total = total + F.when(holds, F.lit(weight)).otherwise(0.0)
    return 1 / (1 + F.exp(-total))


def quality(docs: DataFrame, labels: DataFrame, per_label: int = 2000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with score (0 to 1), predicted (score >= 0.7) and held_out (crc32 of the id as text is 2 modulo 4; not learnt from).

    Learns from at most per_label labelled rows of either label, whatever their length: only their statistics leave the executors. Null texts count as empty; repeated rows get equal scores; without labels all get the
    same score. Input columns that bear an output's name are replaced. An empty table gives no rows.
    """
    docs = docs.drop(*OUT)
    stats = spare(docs.columns, "__stats")
    measured = lambda df: df.select("id", "label", "h", F.struct(*[c.alias(n) for n, c in statistics(F.col("text")).items()]).alias("x"))
    rows, rates = examples(docs, labels, "quality", remainder("doc_id", 4) != 2, per_label, measured, id_col, text_col)
    rows.sort(key=lambda r: r[0])
    x = np.array([list(r[2]) for r in rows], dtype=float).reshape(len(rows), len(NAMES))
    y = np.array([r[1] for r in rows], dtype=float)
    intercept, rules = fit(x, y, np.array([1 / rates[r[1]] for r in rows]))
    out = docs.withColumn(stats, F.struct(*[c.alias(n) for n, c in statistics(F.col(text_col)).items()]))
    out = out.withColumn("score", compile_rules(intercept, rules, [F.col(f"{stats}.{n}") for n in NAMES])).drop(stats)
    return out.withColumns({"predicted": F.when(F.col("score") >= 0.7, 1).otherwise(0), "held_out": F.coalesce(remainder(id_col, 4) == 2, F.lit(False))})


def op7_quality(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select("doc_id", "held_out", "score", "predicted")
