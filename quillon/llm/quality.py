"""Operator 6: quality classifier, a sparse ensemble of rules compiled to column expressions."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import slices, text_buffer
from quillon.llm.shingles import distinct, words

# Labelled rows that one model is fitted on at most: those with the smallest hashes.
SAMPLE_ROWS = 20_000


# Byte classes, as tables of 256 flags.
CLASS = {
    name: np.isin(np.arange(256), list(members))
    for name, members in {"upper": range(65, 91), "digits": range(48, 58), "marks": b"!?#$%&*@^~=+<>_\\/", "bar": b"|", "stops": b".,;:", "letters": [*range(65, 91), *range(97, 123), *range(0xC3, 256)]}.items()
}
NAMES = ["chars", "words", "word_chars", "words_per_line", "upper", "digits", "marks", "bars", "stops", "letters", "repeats", "distinct", "marked_words"]


def measure(column: pa.Array) -> np.ndarray:
    """One row of NAMES per text. Letters beyond ASCII are counted as letters; the upper-case ones of Latin-1 as upper case."""
    data, offsets = text_buffer(column)
    return np.vstack([np.zeros((0, len(NAMES))), *(_measure(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in slices(offsets))])


def _measure(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    def total(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[at]).astype(float)

    hashes, _, last, starts = words(data, offsets)
    lead = (data & 0xC0) != 0x80
    capital = CLASS["upper"][data]
    capital[:-1] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
    chars, n = total(lead, offsets), np.diff(starts).astype(float)
    some, each = np.maximum(chars, 1), np.maximum(n, 1)
    again = np.zeros(len(hashes), bool)
    again[1:] = hashes[1:] == hashes[:-1]
    again[starts[:-1][starts[:-1] < len(hashes)]] = False
    values = {
        "chars": chars, "words": n, "word_chars": chars / each, "words_per_line": n / (total(data == 10, offsets) + 1), "upper": total(capital, offsets) / some,
        "digits": total(CLASS["digits"][data], offsets) / some, "marks": total(CLASS["marks"][data], offsets) / some, "bars": total(data == 124, offsets) / some,
        "stops": total(CLASS["stops"][data], offsets) / some, "letters": total(lead & CLASS["letters"][data], offsets) / some, "repeats": total(again, starts) / each,
        "distinct": np.diff(distinct(hashes, starts)[1]) / each, "marked_words": total((CLASS["marks"] | CLASS["bar"])[data[last - 1]], starts) / each,
    }
    return np.column_stack([values[c] for c in NAMES])


def with_statistics(docs: DataFrame, *columns: Column | str) -> DataFrame:
    """``columns`` and the numbers of NAMES for every whole text; a null text counts as empty."""
    kept = docs.select(F.struct(*columns).alias("__row"), F.col("text").alias("__text"))
    schema = f"__row {kept.schema['__row'].dataType.simpleString()}, " + ", ".join(f"`{c}` double" for c in NAMES)

    def run(batches):
        for batch in batches:
            got = measure(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(got[:, j]) for j in range(len(NAMES)))], names=["__row", *NAMES])

    return kept.mapInArrow(run, schema).select("__row.*", *NAMES)


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, is_greater, threshold) and its weight in the score."""

    terms: tuple[tuple[str, bool, float], ...]
    weight: float


@dataclass(frozen=True)
class RuleModel:
    intercept: float
    rules: tuple[Rule, ...] = field(default=())

    def column(self) -> Column:
        """The model over columns named like the statistics: one minus-or-plus per rule, then the logistic function."""
        total = F.lit(self.intercept)
        for rule in self.rules:
            test = F.lit(True)
            for name, greater, cut in rule.terms:
                test = test & ((F.col(name) > F.lit(cut)) if greater else (F.col(name) <= F.lit(cut)))
            total = total + F.when(test, F.lit(rule.weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def split(x: np.ndarray, residual: np.ndarray, least: int) -> tuple[float, int, float] | None:
    """The statistic and threshold that lower the squared error of the residual most."""
    best, n = None, len(residual)
    if n < 2 * least:
        return None
    for j in range(x.shape[1]):
        order = np.argsort(x[:, j], kind="stable")
        v, r = x[order, j], residual[order].cumsum()
        at = np.arange(least, n - least + 1)
        at = at[v[at - 1] < v[np.minimum(at, n - 1)]]
        if not len(at):
            continue
        gain = r[at - 1] ** 2 / at + (r[-1] - r[at - 1]) ** 2 / (n - at)
        k = int(gain.argmax())
        if best is None or gain[k] > best[0]:
            best = (float(gain[k]), j, float((v[at[k] - 1] + v[at[k]]) / 2))
    return best


def grow(x: np.ndarray, residual: np.ndarray, rows: np.ndarray, depth: int, least: int, path: tuple, rules: list, out: np.ndarray, step: float) -> None:
    """A regression tree on the residual; every node's path from the root is a rule."""
    found = split(x[rows], residual[rows], least) if depth else None
    if found is None:
        out[rows] += step * residual[rows].mean() * 4  # a quarter is the largest curvature of the logistic loss
        return
    _, j, cut = found
    for greater in (False, True):
        side = rows[(x[rows, j] > cut) == greater]
        rules.append(path + ((j, greater, cut),))
        grow(x, residual, side, depth - 1, least, rules[-1], rules, out, step)


def tree_rules(x: np.ndarray, y: np.ndarray, trees: int, depth: int, seed: int, step: float = 0.3) -> list[tuple]:
    """Paths of boosted trees, each on half of the rows drawn anew."""
    rng, score, rules = np.random.default_rng(seed), np.zeros(len(y)), []
    score += np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))
    for _ in range(trees):
        residual = y - 1 / (1 + np.exp(-score))
        rows = np.flatnonzero(rng.random(len(y)) < 0.5)
        change = np.zeros(len(y))
        grow(x, residual, rows, depth, max(5, len(rows) // 200), (), rules, change, step)
        score += change
    return list(dict.fromkeys(rules))


def fires(x: np.ndarray, rules: list[tuple]) -> np.ndarray:
    out = np.ones((len(x), len(rules)))
    for k, rule in enumerate(rules):
        for j, greater, cut in rule:
            out[:, k] *= (x[:, j] > cut) == greater
    return out


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 300) -> tuple[float, np.ndarray]:
    """Logistic regression with an L1 penalty on the weights and none on the intercept, by accelerated proximal steps."""
    n = len(y)
    design = np.hstack([np.ones((n, 1)), z])
    step = 4 * n / max(np.linalg.eigvalsh(design.T @ design)[-1], 1e-9)
    w = np.zeros(design.shape[1])
    w[0] = np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))
    v, t = w.copy(), 1.0
    for _ in range(rounds):
        g = design.T @ (1 / (1 + np.exp(-design @ v)) - y) / n
        new = v - step * g
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * penalty, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + (t - 1) / t2 * (new - w), new, t2
    return float(w[0]), w[1:]


def fit(x: np.ndarray, y: np.ndarray, names: list[str], trees: int = 30, depth: int = 3, penalty: float = 0.002, seed: int = 7) -> RuleModel:
    """Rules from tree paths, then lasso weights; rules whose weight is zero are left out."""
    if not len(y):
        return RuleModel(0.0)
    rules = tree_rules(x, y, trees, depth, seed) if 0 < y.mean() < 1 else []
    if not rules:
        return RuleModel(float(np.log((y.mean() + 0.01) / (1 - y.mean() + 0.01))))
    intercept, weights = lasso_logistic(fires(x, rules), y, penalty)
    kept = [Rule(tuple((names[j], g, c) for j, g, c in r), float(w)) for r, w in zip(rules, weights) if abs(w) > 1e-6]
    return RuleModel(intercept, tuple(kept))


def learn(docs: DataFrame, labels: DataFrame, train: Column, sample_rows: int = SAMPLE_ROWS) -> RuleModel:
    """Fit on the training rows among ``sample_rows`` labels: those with the smallest hash of (doc_id, label).

    Labels other than 0 and 1 are left out; a document with several labels gives a row for each. Without labels the model is
    a constant. The sample is drawn from the labels alone and is broadcast, its size being the bound, so no text is shuffled.
    """
    chosen = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("label_id"), "quality")
    chosen = chosen.withColumn("order", F.xxhash64("label_id", "quality")).orderBy("order", "label_id", "quality").limit(sample_rows)
    rows = docs.filter(train).select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id"))
    rows = with_statistics(rows, "order", "doc_id", "quality")
    got = rows.toPandas().sort_values(["order", "doc_id", "quality", *NAMES])
    return fit(got[NAMES].to_numpy(float).reshape(len(got), len(NAMES)), got["quality"].to_numpy(float), NAMES)


def score(docs: DataFrame, model: RuleModel, columns: list[str]) -> DataFrame:
    """``columns`` and score (0 to 1) of every whole text; a null or empty text has statistics of zero and a score like any other.

    The rules are column expressions over the statistics. An input column named score is replaced.
    """
    inner = with_statistics(docs, F.struct(*[c for c in columns if c != "score"]).alias("__kept"))
    return inner.select("__kept.*", model.column().alias("score"))


def accept(docs: DataFrame, model: RuleModel, least: float) -> DataFrame:
    """Documents whose score is at least ``least``, with their own columns."""
    return score(docs.select(F.struct(*docs.columns).alias("__doc"), "text"), model, ["__doc"]).filter(F.col("score") >= least).select("__doc.*")
