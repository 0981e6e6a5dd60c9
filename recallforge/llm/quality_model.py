"""Op 4, quality classifier: Bradley-Terry scores from preference pairs, thresholded by a score quantile.

Features of every text are computed once and written to the shared folder; the pairs are labelled good documents
preferred to labelled bad ones, and the weights minimize the logistic loss on feature differences.  The threshold is
the quantile of the training scores at the share of bad documents; it becomes 0.3 on the score's scale from 0 to 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import documents, materialize, slices

#: Characters whose shares are features.
MARKS = "#*$%&|<>!?.,;:()[]{}=/\\\"'-_0"
FEATURES = ("words", "word_length", "upper", "digits", "not_ascii", "distinct_words", "repeated_lines", "words_a_line", "end_marks", "longest_word", "stray_ends", "repeated_next", *(f"mark_{i}" for i in range(len(MARKS) - 1)))
MOST_ROWS, PAIRS_EACH, CUT = 20_000, 24, 0.3


def features(text: str | None) -> list[float]:
    """Features of a whole text; null and empty texts give zeros."""
    if not text:
        return [0.0] * len(FEATURES)
    data = text.encode("utf-8", "replace")
    words = data.split()
    n, m = max(len(words), 1), max(len(data), 1)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    lines = [x for x in data.split(b"\n") if x.strip()]
    word_bytes = sum(map(len, words))
    pairs = len(set(zip(words, words[1:], strict=False)))
    ends = sum(w[-1] in b"#*$%&|<>!" for w in words)
    out = [np.log1p(len(words)), min(word_bytes / n, 40) / 10, counts[65:91].sum() / m, counts[48:58].sum() / m, counts[128:].sum() / m, len(set(words)) / n, 1 - len(set(lines)) / max(len(lines), 1), np.log1p(len(words) / max(len(lines), 1)), counts[[33, 46, 63]].sum() / n, np.log1p(max(map(len, words), default=0)), ends / n, 1 - pairs / max(len(words) - 1, 1) if len(words) > 1 else 0.0]
    return [float(x) for x in out] + [float(np.sqrt(counts[ord(c)] / m)) for c in MARKS[:-1]]


def feature_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def computed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                rows = [features(t) for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.list_(pa.float32()))], names=["doc_id", "x"])

    return docs.selectExpr(f"`{id_col}` doc_id", f"`{text_col}` text").mapInArrow(computed, "doc_id long, x array<float>")


def fit(x: np.ndarray, good: np.ndarray, seed: int = 7, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """Bradley-Terry weights on the features, and the threshold on the scores.  Without pairs, zeros."""
    pos, neg = np.flatnonzero(good == 1), np.flatnonzero(good == 0)
    if not len(pos) or not len(neg):
        return np.zeros(x.shape[1]), 0.0
    scale = x.std(0) + 1e-6
    rng = np.random.default_rng(seed)
    small, large = (neg, pos) if len(neg) <= len(pos) else (pos, neg)
    a, b = np.repeat(small, PAIRS_EACH), rng.choice(large, len(small) * PAIRS_EACH)
    diff = (x[b] - x[a] if small is neg else x[a] - x[b]) / scale
    w = np.zeros(x.shape[1])
    for _ in range(30):  # Newton steps
        p = 1 / (1 + np.exp(np.clip(diff @ w, -30, 30)))
        step = np.linalg.solve((diff * (p * (1 - p))[:, None]).T @ diff + ridge * np.eye(len(w)), diff.T @ p - ridge * w)
        w += step * min(1.0, 4 / (np.abs(step).max() + 1e-9))
        if np.abs(step).max() < 1e-5:
            break
    w = w / scale
    scores = x @ w
    return w, float(np.quantile(scores, len(neg) / len(x)))


def score_quality(docs: DataFrame, labels: DataFrame, learn: str, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", most_rows: int = MOST_ROWS) -> DataFrame:
    """(doc_id, score, predicted, raw) of every row of ``docs``.

    ``learn`` is an SQL condition on ``labels`` that picks the rows to learn from; of these, the ``most_rows`` with the
    smallest digest of their id are used (a documented bound).  Null and empty texts are scored by their features, which
    are zeros; null labels are left out; repeated rows are scored each, and learned from once an id and label.  With no
    usable labels all scores are 0.3.
    """
    table = materialize(feature_table(docs, id_col, text_col), "quality-features")
    picked = labels.filter(learn).select(F.col("doc_id").alias("doc_id"), F.col(label_col).cast("int").alias("y")).dropna().orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(most_rows)
    # one row of each id, in a fixed order, so that training can be repeated; a row holds a bounded number of features
    rows = table.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "y").agg(F.min("x").alias("x")).orderBy(F.xxhash64("doc_id"), "doc_id", "y").select("x", "y").toArrow()
    x = np.array(rows.column("x").to_pylist(), np.float64).reshape(-1, len(FEATURES))
    w, cut = fit(x, np.asarray(rows.column("y").to_pylist(), np.int64))
    raw = sum((F.col("x")[i].cast("double") * F.lit(float(v)) for i, v in enumerate(w)), F.lit(0.0))
    score = 1 / (1 + F.exp(F.lit(float(np.log((1 - CUT) / CUT))) - (F.col("raw") - F.lit(cut))))
    return table.select("doc_id", raw.alias("raw")).select("doc_id", score.alias("score"), F.when(F.col("raw") >= cut, 1).otherwise(0).alias("predicted"), "raw")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; null, empty and very long texts, ties and repeated rows as in ``score_quality``."""
    held = "crc32(cast(cast(doc_id as string) as binary)) % 5 = 0"
    scored = score_quality(documents(spark, sf_dir, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"), f"not ({held})")
    return scored.select("doc_id", F.expr(held).alias("held_out"), "score", F.when(F.col("score") >= CUT, 1).otherwise(0).alias("predicted"))
