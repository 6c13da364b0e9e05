"""Quality classifier: a sparse ensemble of conjunctive rules over text statistics, compiled to columns."""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import per_batch

STATISTICS = ("chars", "words", "word_length", "upper", "digit", "mark", "symbol", "bang", "wide", "space", "lines", "repeated_lines", "line_length", "distinct_words", "top_word", "long_words", "short_words", "entropy", "symbol_words", "upper_words", "links", "repeated_pairs")
MARKS = np.zeros(256, bool)
MARKS[list(b".,;:'\"()-?")] = True
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[c for c in range(33, 127) if not chr(c).isalnum() and not MARKS[c]]] = True


def statistics(text: str) -> list[float]:
    """Shares and means that tell prose from junk; all are 0 for the empty text."""
    data = text.encode("utf-8", "surrogatepass")
    if not data:
        return [0.0] * len(STATISTICS)
    seen = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    n = len(data)
    words = data.split()
    n_words = max(1, len(words))
    often = Counter(words)
    lines = [x for x in data.split(b"\n") if x.strip()]
    sizes = [len(w) for w in words]
    share = seen[seen > 0] / n
    pairs = Counter(zip(words, words[1:], strict=False))
    return [
        float(len(text)), float(len(words)), sum(sizes) / n_words, seen[65:91].sum() / n, seen[48:58].sum() / n, seen[MARKS].sum() / n, seen[SYMBOLS].sum() / n, seen[33] / n, seen[128:].sum() / n,
        (seen[32] + seen[9:14].sum()) / n, float(len(lines)), 1 - len(set(lines)) / max(1, len(lines)), n / max(1, len(lines)), len(often) / n_words, max(often.values(), default=0) / n_words,
        sum(s > 12 for s in sizes) / n_words, sum(s <= 2 for s in sizes) / n_words, float(-(share * np.log2(share)).sum()), sum(not w[-1:].isalnum() and w[-1:] not in b".,;:?\"')" and w[-1] < 128 for w in words) / n_words,
        sum(w.isupper() for w in words) / n_words, data.count(b"http") / n_words, sum(c for c in pairs.values() if c > 1) / n_words,
    ]


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id (and every other column but text) with the statistics of text."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [statistics(t.as_py()) for t in batch.column("text")]
            kept = [n for n in batch.schema.names if n != "text"]
            columns = list(zip(*rows, strict=True)) or [[]] * len(STATISTICS)
            return pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), *(pa.array(map(float, c), pa.float64()) for c in columns)], [*kept, *STATISTICS])

        return step

    kept = [f"`{n}` {t}" for n, t in docs.dtypes if n != "text"]
    return per_batch(docs, ", ".join([*kept, *(f"{n} double" for n in STATISTICS)]), make)


Test = tuple[int, bool, float]  # statistic, whether above, threshold


@dataclass(frozen=True)
class Ensemble:
    intercept: float
    rules: tuple[tuple[tuple[Test, ...], float], ...]

    def column(self) -> Column:
        """The score as one expression: the logistic of the intercept and the weights of the rules that hold."""
        parts = [F.lit(self.intercept)]
        for tests, weight in self.rules:
            holds = reduce(lambda a, b: a & b, [F.col(STATISTICS[k]) > t if above else F.col(STATISTICS[k]) <= t for k, above, t in tests])
            parts.append(F.when(holds, F.lit(weight)).otherwise(F.lit(0.0)))
        return 1 / (1 + F.exp(-reduce(lambda a, b: a + b, parts)))

    def score(self, row: list[float]) -> float:
        total = self.intercept + sum(w for tests, w in self.rules if all((row[k] > t) == above for k, above, t in tests))
        return 1 / (1 + math.exp(-total))


def tree_paths(x: np.ndarray, cuts: list[np.ndarray], bins: np.ndarray, target: np.ndarray, rows: np.ndarray, depth: int, least: int) -> list[tuple[tuple[Test, ...], np.ndarray]]:
    """Paths to all nodes below the root of a regression tree, each with the rows that reach it."""
    if depth == 0 or len(rows) < 2 * least:
        return []
    best = None
    total, n = target[rows].sum(), len(rows)
    for k, cut in enumerate(cuts):
        if not len(cut):
            continue
        count = np.bincount(bins[rows, k], minlength=len(cut) + 1)[:-1].cumsum()
        left = np.bincount(bins[rows, k], weights=target[rows], minlength=len(cut) + 1)[:-1].cumsum()
        fit = (count >= least) & (n - count >= least)
        gain = np.where(fit, left**2 / np.maximum(count, 1) + (total - left) ** 2 / np.maximum(n - count, 1), -np.inf)
        at = int(np.argmax(gain))
        if fit[at] and (best is None or gain[at] > best[0] + 1e-12):
            best = gain[at], k, float(cut[at])
    if best is None or best[0] <= total**2 / n + 0.5:
        return []
    _, k, cut = best
    out = []
    for above in (False, True):
        inside = rows[(x[rows, k] > cut) == above]
        out.append((((k, above, cut),), inside))
        out += [(((k, above, cut), *tests), r) for tests, r in tree_paths(x, cuts, bins, target, inside, depth - 1, least)]
    return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 25, depth: int = 3, step: float = 0.3, penalty: float = 1e-3, rounds: int = 200) -> Ensemble:
    """Boosted trees give the rules; lasso logistic regression (accelerated proximal gradient) keeps a few of them."""
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return Ensemble(float(math.log(share / (1 - share))), ())
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0.01, 0.99, 50), method="lower")) for k in range(x.shape[1])]
    bins = np.stack([np.searchsorted(c, x[:, k], side="left") for k, c in enumerate(cuts)], 1)
    share = y.mean()
    value = np.full(len(y), math.log(share / (1 - share)))
    found: dict[tuple, np.ndarray] = {}
    everyone = np.arange(len(y))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-value))
        paths = tree_paths(x, cuts, bins, y - p, everyone, depth, max(5, len(y) // 500))
        if not paths:
            break
        covered = {tests[:-1] for tests, _ in paths if len(tests) > 1}
        for tests, rows in paths:
            found.setdefault(tuple(sorted(tests)), rows)
            if tests not in covered:
                value[rows] += step * (y[rows] - p[rows]).sum() / max(1e-6, (p[rows] * (1 - p[rows])).sum())
        value = np.clip(value, -12, 12)
    names = sorted(found)
    z = np.zeros((len(y), len(names)), np.float32)
    for k, tests in enumerate(names):
        z[found[tests], k] = 1
    centre = z.mean(0)
    spread = np.maximum(z.std(0), 1e-3)
    w, b = lasso((z - centre) / spread, y, penalty, rounds)
    scaled = (w / spread).astype(float)
    return Ensemble(float(b - (scaled * centre).sum()), tuple((names[k], float(scaled[k])) for k in np.flatnonzero(np.abs(w) > 1e-6)))


def lasso(z: np.ndarray, y: np.ndarray, penalty: float, rounds: int) -> tuple[np.ndarray, np.float32]:
    """Weights and intercept of least mean logistic loss plus ``penalty`` times the sum of the weights' sizes."""
    share = y.mean()
    w, b = np.zeros(z.shape[1], np.float32), np.float32(math.log(share / (1 - share)))
    if not len(w):
        return w, b
    square, top = z.T @ z / len(y), np.ones(len(w), np.float32)
    for _ in range(30):
        top = square @ top
        top /= np.linalg.norm(top)
    lip = np.float32(0.25 * (1.1 * top @ square @ top + 1))  # the logistic loss is at most this steep in its slope
    y = y.astype(np.float32)
    ahead_w, ahead_b, t = w, b, 1.0
    for _ in range(rounds):
        error = (1 / (1 + np.exp(-(z @ ahead_w + ahead_b))) - y).astype(np.float32)
        new_w = ahead_w - (z.T @ error) / len(y) / lip
        new_w = np.sign(new_w) * np.maximum(np.abs(new_w) - np.float32(penalty) / lip, 0)
        new_b = ahead_b - error.mean() / lip
        new_t = (1 + math.sqrt(1 + 4 * t * t)) / 2
        go = np.float32((t - 1) / new_t)
        ahead_w, ahead_b = new_w + go * (new_w - w), new_b + go * (new_b - b)
        w, b, t = new_w, new_b, new_t
    return w, b


def learn(docs: DataFrame, labels: DataFrame, most: int) -> Ensemble:
    """Fit on ``most`` rows at the most: labelled ids drawn by a hash, of rows of one id and label the least text.

    The drawn ids alone are broadcast, and the driver gets a row of statistics for each of them.
    """
    allowed = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) != 0, F.lit(False))
    drawn = labels.where(allowed & F.col("quality").isNotNull()).select("doc_id", F.col("quality").cast("int").alias("cairn_label")).distinct()
    drawn = drawn.orderBy(F.xxhash64("doc_id"), "doc_id", "cairn_label").limit(most)
    rows = docs.join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "cairn_label").agg(F.min("text").alias("text"))
    rows = with_statistics(rows).toPandas().sort_values(["doc_id", "cairn_label"])
    return fit(rows[list(STATISTICS)].to_numpy(float), rows["cairn_label"].to_numpy(float))


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_labels: int = 8_000, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.

    Only text makes a score; null text counts as empty and is scored like any other.  Null ids are neither held out
    nor learned from; null labels are left out; of rows of one id one is learned from for each of its labels; repeated
    rows give a row each, with equal scores for equal texts; an empty table gives none.  Very long texts are read
    whole.  Of splits of equal gain the first statistic and the least cut are taken.  Without
    labels, or with one class of them, the score is the smoothed share of label 1.  Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    model = learn(rows, labels, most_labels)
    scored = with_statistics(rows).select("doc_id", model.column().alias("score"))
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
