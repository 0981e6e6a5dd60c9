"""Op 1, toxicity: a support vector machine on string subsequence kernels, with Nystrom landmarks.

Units are words in lower case with marks for both ends, pieces of very long words, the letters and digits of words with
other characters between them, and runs of single letters put together.  The kernel of two units sums their common subsequences of ``ORDER`` characters, each gap costing a factor
``DECAY``, so characters put between those of an insult only lower it; it is normalized to 1 for equal units.  Kernel
values to a few landmark units give Nystrom features; a linear SVM on them is trained on labelled documents as bags of
units (the best unit of each toxic document is its witness, retrained in rounds).  Decisions under the margin's ``FLOOR``
count as that floor.  A document's score is a logistic curve of the best decision over all units of its whole text, and
of the number and the share of toxic units.

Kernels to all landmarks are needed for training only: a decision is linear in the subsequences of a unit, so the trained
machine is one table of weights of subsequences, and a unit is decided by looking up each of its own, whatever the number
of landmarks.  Every unit of every document is decided so; scoring is a map without a shuffle.
"""

from __future__ import annotations

import functools
import itertools
import json
import math
import random
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import documents, slices

ORDER, DECAY, UNIT, CUT = 4, 0.7, 24, 0.3
#: The least and the largest decision, decided units that a task remembers, and elements of the arrays that subsequences are looked up in.
FLOOR, CEILING, REMEMBERED, ELEMENTS = -0.8, 0.4, 400_000, 1 << 20
#: Bounds of the training sample: documents of each label, landmarks, and distinct clean units to train on; and how many
#: toxic units are learned from in stretched forms too, and in how many forms.
MOST_DOCS, LANDMARKS, MOST_CLEAN, STRETCHED, GAPPED = 2_000, 192, 40_000, 24, 6
PARTED = re.compile(r"[^\W_][\W_]+[^\W_]")
SPACED = re.compile(r"(?<!\S)\w(?:[ \t]\w){2,}(?!\S)")


def units(text: str | None) -> Counter:
    """The units of a whole text with their counts; none for null, empty and blank texts."""
    if not text:
        return Counter()
    low = text.lower()
    found = Counter(low.split())
    for w in [w for w in found if len(w) > UNIT]:
        n = found.pop(w)
        for i in range(0, len(w) - UNIT // 2, UNIT // 2):
            found[w[i : i + UNIT]] += n
    for w in [w for w in found if PARTED.search(w)]:
        found[re.sub(r"[\W_]+", "", w)[:UNIT]] += found[w]
    if any(len(w) == 1 for w in found):
        for m in SPACED.finditer(low):
            run = re.sub(r"[ \t]", "", m[0])
            found.update(run[i : i + UNIT] for i in range(0, max(1, len(run) - UNIT // 2), UNIT // 2))
    return found


def _soft(f: np.ndarray | float) -> np.ndarray | float:
    return 1 / (1 + np.exp(-np.clip(6 * f, -30, 30)))


def summary(bag: Counter, known: dict[str, float]) -> tuple[float, float, float]:
    """What a document's score sees: its best decision, and how many units, and what share of them, are toxic.

    ``known`` has the decisions of all units above the floor at least.
    """
    if not bag:
        return FLOOR, 0.0, math.log(1e-3)
    hits = [u for u in bag if known.get(u, FLOOR) > FLOOR]
    f, n, total = np.array([known[u] for u in hits]), np.array([bag[u] for u in hits], float), sum(bag.values())
    soft = float(n @ _soft(f)) + (total - n.sum()) * _soft(FLOOR)
    return float(f.max(initial=FLOOR)), math.log1p(soft), math.log(soft / total + 1e-3)


def codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Characters as numbers, with both end marks, padded by zeros; and lengths."""
    marked = ["\x01\x02" + w + "\x03" for w in words]  # two at the start, where stems are
    width = max(map(len, marked), default=2)
    out = np.frombuffer("".join(w.ljust(width, "\0") for w in marked).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), width)
    return out, np.array([len(w) for w in marked])


def kernel(a: np.ndarray, b: np.ndarray, pairwise: bool) -> np.ndarray:
    """Subsequence kernel of order ``ORDER``: rows of ``a`` with all rows of ``b``, or (pairwise) with the same row."""
    shape = (len(a),) if pairwise else (len(a), len(b))
    n, m, d2 = a.shape[1], b.shape[1], np.float32(DECAY * DECAY)
    decay = np.float32(DECAY)
    # before[o][j]: K' of order o for the prefix of a read so far and the first j characters of b
    before = [[np.ones(shape, np.float32)] * (m + 1)] + [[np.zeros(shape, np.float32) for _ in range(m + 1)] for _ in range(ORDER - 1)]
    total = np.zeros(shape, np.float32)
    for i in range(n):
        x = a[:, i] if pairwise else a[:, i][:, None]
        equal = [((x == (b[:, j] if pairwise else b[:, j][None, :])) & (x != 0)).astype(np.float32) * d2 for j in range(m)]
        for j in range(m):
            total += equal[j] * before[ORDER - 1][j]
        for o in range(ORDER - 1, 0, -1):
            run = np.zeros(shape, np.float32)
            for j in range(m):
                run = decay * run + equal[j] * before[o - 1][j]
                before[o][j + 1] = decay * before[o][j + 1] + run
    return total


@functools.cache
def places(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a word of ``n`` characters: all pairs of places (first, second), and all subsequences of four as two pairs, with their decay."""
    first, second = np.triu_indices(n, 1)
    pair = np.zeros((n, n), np.int64)
    pair[first, second] = np.arange(len(first))
    four = np.array(list(itertools.combinations(range(n), ORDER)), np.int64).reshape(-1, ORDER)
    return first, second, pair[four[:, 0], four[:, 1]], pair[four[:, 2], four[:, 3]], DECAY ** (four[:, 3] - four[:, 0] + 1.0)


class Weights:
    """A decision as weights of subsequences: two pairs of characters, each with a number among those that landmarks have."""

    def __init__(self, words: list[str], alpha: np.ndarray):
        c, lengths = codes(words)
        self.chars = np.unique(c[c != 0])
        own = np.sqrt(kernel(c, c, True) + 1e-12)
        rows = []
        for row, n, a, k in zip(c, lengths, alpha, own, strict=True):
            if n >= ORDER and a:
                first, second, i, j, decay = places(int(n))
                ids = self.numbers(row[None, :n])[0]
                pairs = ids[first] * (len(self.chars) + 1) + ids[second]
                rows.append(np.c_[pairs[i], pairs[j], decay * (a / k)])
        found = np.concatenate(rows) if rows else np.zeros((0, 3))
        size = len(self.chars) + 1
        self.begin, self.end = np.zeros(size * size, np.int64), np.zeros(size * size, np.int64)
        for at, column in ((self.begin, 0), (self.end, 1)):
            some = np.unique(found[:, column].astype(np.int64))
            at[some] = np.arange(1, len(some) + 1)
        self.width = int(self.end.max(initial=0)) + 1
        self.table = np.zeros((int(self.begin.max(initial=0)) + 1) * self.width)
        np.add.at(self.table, self.begin[found[:, 0].astype(np.int64)] * self.width + self.end[found[:, 1].astype(np.int64)], found[:, 2])

    def numbers(self, c: np.ndarray) -> np.ndarray:
        """Numbers of characters, 0 for those of no landmark."""
        at = np.minimum(np.searchsorted(self.chars, c), len(self.chars) - 1)
        return np.where(self.chars[at] == c, at + 1, 0).astype(np.int64)

    def sums(self, c: np.ndarray) -> np.ndarray:
        """The weights of all subsequences of words of one length."""
        first, second, i, j, decay = places(c.shape[1])
        out = np.zeros(len(c))
        step = max(1, ELEMENTS // max(len(i), 1))
        for s in range(0, len(c), step):
            ids = self.numbers(c[s : s + step])
            pairs = ids[:, first] * (len(self.chars) + 1) + ids[:, second]
            out[s : s + step] = (self.table[(self.begin[pairs] * self.width)[:, i] + self.end[pairs][:, j]] * decay).sum(1)
        return out


@dataclass
class Model:
    """Landmarks and what turns kernel values to them into a decision and a score."""

    landmarks: list[str]
    alpha: np.ndarray
    bias: float
    curve: np.ndarray  # of the document's summary, then the constant

    def __post_init__(self) -> None:
        self.weights = Weights(self.landmarks, self.alpha)
        self.known: dict[str, float] = {}

    def values(self, words: list[str]) -> np.ndarray:
        """Normalized kernels of units to all landmarks."""
        out = np.zeros((len(words), len(self.landmarks)), np.float32)
        ends = sorted(range(len(self.landmarks)), key=lambda i: len(self.landmarks[i]))
        # landmarks of about the same length go together, so that none is padded far
        parts = [(part, codes([self.landmarks[i] for i in part])[0]) for part in (ends[k : k + 32] for k in range(0, len(ends), 32))]
        own = [np.sqrt(kernel(c, c, True) + 1e-12) for _, c in parts]
        by = sorted(range(len(words)), key=lambda i: len(words[i]))
        for s in range(0, len(by), 512):
            rows = by[s : s + 512]
            c, _ = codes([words[i] for i in rows])
            length = np.sqrt(kernel(c, c, True) + 1e-12)[:, None]
            for (part, landmarks), k in zip(parts, own, strict=True):
                out[np.ix_(rows, part)] = kernel(c, landmarks, False) / length / k[None, :]
        return out

    def decisions(self, words: list[str]) -> np.ndarray:
        """Decisions of units, between the floor and the ceiling."""
        return np.clip(self.margins(words), FLOOR, CEILING)

    def margins(self, words: list[str]) -> np.ndarray:
        """Decisions of units, the floor at least.

        The length of a unit is computed only where the least that it can be would leave the decision above the floor.
        """
        out = np.full(len(words), FLOOR)
        by: dict[int, list[int]] = defaultdict(list)
        for i, w in enumerate(words):
            by[len(w) + 3].append(i)
        for n, at in by.items():
            rows = np.array(at)
            c, _ = codes([words[i] for i in at])
            sums = self.weights.sums(c)
            least = np.sqrt((places(n)[4] ** 2).sum() + 1e-12)
            near = np.flatnonzero(np.where(sums > 0, sums / least, 0.0) + self.bias > FLOOR - 1e-3)
            if len(near):
                out[rows[near]] = sums[near] / np.sqrt(kernel(c[near], c[near], True) + 1e-12) + self.bias
        return np.maximum(np.round(out, 4), FLOOR)

    def above(self, words: list[str]) -> dict[str, float]:
        """The units above the floor, with their decisions."""
        f = self.decisions(words)
        return {words[i]: float(f[i]) for i in np.flatnonzero(f > FLOOR)}

    def scores(self, texts: Iterable[str | None]) -> list[float]:
        """Scores of whole texts; units are looked up among those already decided."""
        bags = [units(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = list({u for bag in bags for u in bag} - self.known.keys())
        self.known.update(zip(new, self.decisions(new).tolist(), strict=True))
        seen = np.array([summary(bag, self.known) for bag in bags], np.float64).reshape(-1, 3)
        return (1 / (1 + np.exp(-np.clip(seen @ self.curve[:3] + self.curve[3], -30, 30)))).tolist()


def svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 20.0, rows: int = 8192) -> tuple[np.ndarray, float]:
    """A linear SVM with squared hinge loss, by Newton steps; y is +1 or -1.  Rows are taken up in blocks, without a copy of all."""
    n = x.shape[1] + 1
    reg = np.eye(n)
    reg[-1, -1] = 1e-3
    w = np.zeros(n)
    for _ in range(25):
        left, right = reg.copy(), np.zeros(n)
        for s in range(0, len(x), rows):
            z = np.hstack([x[s : s + rows], np.ones((len(x[s : s + rows]), 1))]).astype(np.float64)
            active = y[s : s + rows] * (z @ w) < 1
            z, ca = z[active], c * weight[s : s + rows][active]
            left += (z * ca[:, None]).T @ z
            right += z.T @ (ca * y[s : s + rows][active])
        new = np.linalg.solve(left, right)
        if np.abs(new - w).max() < 1e-6:
            break
        w = new
    return w[:-1], float(w[-1])


def stretched(words: list[str], alphabet: str, each: int = GAPPED) -> list[str]:
    """Words with one or two characters put in, and with one in every gap; the same for the same words."""
    rnd, out = random.Random(0), []

    def put(w: str, gaps: Iterable[int]) -> str:
        held = set(gaps)
        return "".join(c + (rnd.choice(alphabet) if i in held else "") for i, c in enumerate(w))

    for w in words:
        inner = range(len(w) - 1)
        for k in range(each):
            out.append(put(w, rnd.sample(inner, min(1 + k % 2, len(inner)))))
        out.append(put(w, inner)[:UNIT])
    return list(dict.fromkeys(out))


def train(bags: list[Counter], toxic: np.ndarray, rounds: int = 3, landmarks: int = LANDMARKS, most_clean: int = MOST_CLEAN) -> Model:
    """A model from labelled documents as bags of units; without both labels it scores all documents low.

    ``landmarks`` bounds the units that kernels are computed to, ``most_clean`` the distinct clean units to learn from.
    """
    pos, neg = [b for b, t in zip(bags, toxic, strict=True) if t == 1], [b for b, t in zip(bags, toxic, strict=True) if t == 0]
    in_pos, in_neg = Counter(u for b in pos for u in b), Counter(u for b in neg for u in b)
    if not pos or not neg or not in_pos:
        return Model(["-"], np.zeros(1), FLOOR, np.array([0.0, 0.0, 0.0, -3.0]))

    def lift(u: str) -> float:
        return np.log((in_pos[u] + 0.5) / (len(pos) + 1)) - np.log((in_neg[u] + 0.5) / (len(neg) + 1))

    ranked = sorted(in_pos, key=lambda u: (-lift(u) * (in_pos[u] > 1), -in_pos[u], u))
    clean = sorted(in_neg, key=lambda u: (-in_neg[u], u))
    rare = clean[200:]
    # insults may be stretched: the surest units are learned from with characters put in, which no clean unit has
    sure = [u for u in ranked if in_pos[u] > 1 and lift(u) > 2.5 and len(u) >= ORDER and u.isalpha()][:STRETCHED]
    alphabet = "".join(sorted({c for u in clean[:2000] for c in u if c.isalpha()})) or "x"
    longer = [u for u in stretched(sure, alphabet) if not in_neg[u]]
    # the frequent half and an even sample of the rest may be learned from
    chosen = list(dict.fromkeys([*ranked[: landmarks * 3 // 8], *longer[:: max(1, len(longer) * 4 // landmarks)], *clean[: landmarks // 8], *rare[:: max(1, len(rare) // max(1, landmarks // 4))]]))[:landmarks]
    model = Model(chosen, np.zeros(len(chosen)), 0.0, np.zeros(4))
    vals, vecs = np.linalg.eigh(model.values(chosen).astype(np.float64))
    keep = vals > 1e-4
    root = (vecs[:, keep] / np.sqrt(vals[keep])).astype(np.float32)  # Nystrom: features are kernels times this
    negatives = list(dict.fromkeys([*clean[: most_clean // 2], *rare[:: max(1, -(-len(rare) * 2 // most_clean))]]))[:most_clean]
    xn = model.values(negatives) @ root
    wn = np.sqrt([in_neg[u] for u in negatives])
    witness = {u for u in ranked if in_pos[u] > 1 and lift(u) > 2.5} or set(ranked[:1])
    every = sorted(in_pos)
    for k in range(rounds):
        some = sorted({*witness, *longer})
        wp = np.array([in_pos[u] or 2 for u in some], float)
        w, bias = svm(np.vstack([model.values(some) @ root, xn]), np.r_[np.ones(len(some)), -np.ones(len(xn))], np.r_[wp / wp.sum() * wn.sum() / 8, wn])
        model = Model(chosen, root @ w, bias, np.zeros(4))
        if k + 1 < rounds:
            f = dict(zip(every, model.margins(every).tolist(), strict=True))
            best = [max(b, key=lambda u: (f[u], u)) for b in pos if b]
            witness = {u for u in best if f[u] > -0.5 and lift(u) > 0} | {u for u in every if f[u] > 0 and lift(u) > 0.7} or witness
    known = model.above(sorted(set(in_neg) | set(in_pos)))
    d = np.array([summary(b, known) for b in [*pos, *neg]])
    # a logistic curve with Platt's smoothed targets
    goal = np.r_[np.full(len(pos), (len(pos) + 1) / (len(pos) + 2)), np.full(len(neg), 1 / (len(neg) + 2))]
    mean, scale = d.mean(0), d.std(0) + 1e-6
    z, ab = np.c_[(d - mean) / scale, np.ones(len(d))], np.zeros(4)
    ridge = np.diag([0.1, 0.1, 0.1, 1e-3])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ ab, -30, 30)))
        ab = ab + np.clip(np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (goal - p) - ridge @ ab), -2, 2)
    model.curve = np.r_[ab[:3] / scale, ab[3] - (ab[:3] * mean / scale).sum()]
    return model


def learn(docs: DataFrame, labels: DataFrame, condition: str, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", most_docs: int = MOST_DOCS, landmarks: int = LANDMARKS, most_clean: int = MOST_CLEAN) -> Model:
    """A model from the ``most_docs`` documents of each label, among the labels where ``condition`` holds, with the
    smallest digests of their ids (a documented bound); their whole texts are read.

    Rows with a null id or label are left out.  Of repeated labels of an id each counts; of repeated rows of an id one
    is read, the one with the smallest digest of its text.  Null and empty texts are empty bags; empty tables give a model
    that scores all documents low.
    """
    some = labels.filter(condition).select("doc_id", F.col(label_col).cast("int").alias("y")).dropna()
    picked = None
    for y in (0, 1):
        part = some.filter(f"y = {y}").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_docs)
        picked = part if picked is None else picked.unionByName(part)

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                found = [json.dumps(units(t)) for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(found, pa.string())], names=["doc_id", "y", "u"])

    rows = docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"`{text_col}` text").join(F.broadcast(picked), "doc_id")
    got = rows.select("doc_id", "y", "text").mapInArrow(bags, "doc_id long, y int, u string")
    got = got.groupBy("doc_id", "y").agg(F.min_by("u", F.xxhash64("u")).alias("u")).orderBy(F.xxhash64("doc_id"), "doc_id", "y").toArrow()
    return train([Counter(json.loads(b)) for b in got.column("u").to_pylist()], np.array(got.column("y").to_pylist(), int), landmarks=landmarks, most_clean=most_clean)


def score_toxicity(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from 0.3 on); columns of these names are replaced.

    Null, empty and blank texts get the score of a document without units.  Every row is scored from its
    own whole text, so repeated rows have equal scores; all other columns stay as they are.
    """
    base = docs.drop("score", "predicted")
    schema = base.withColumns({"score": F.lit(0.0), "predicted": F.lit(0)}).schema
    sent = docs.sparkSession.sparkContext.broadcast((model.landmarks, model.alpha, model.bias, model.curve))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*sent.value)
        for whole in batches:
            for batch in slices(whole, text_col):
                s = m.scores(batch.column(text_col).to_pylist())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64()), pa.array([int(v >= CUT) for v in s], pa.int32())], names=[*batch.schema.names, "score", "predicted"])

    return base.mapInArrow(scored, schema)


HELD_OUT = "crc32(cast(cast(doc_id as string) as binary)) % 4 = 2"


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; null, empty and very long texts, and repeated rows, as in ``score_toxicity``."""
    docs = documents(spark, sf_dir, "doc_id", "text")
    model = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), f"not ({HELD_OUT})")
    scored = score_toxicity(docs.withColumn("text", F.coalesce("text", F.lit(""))), model)
    return scored.select("doc_id", F.expr(HELD_OUT).alias("held_out"), "score", "predicted")
