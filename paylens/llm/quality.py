"""Quality scores by Bradley-Terry pairwise ranking.

A document's strength is a weighted sum of features of its text. In a pair of a
good and a bad labelled document, the good one is preferred with a probability
that is logistic in the difference of their strengths; the weights minimise the
logistic loss over all pairs, on differences of features. The threshold is the
quantile of the strengths of the labelled documents at the share of bad ones.
A score is the logistic of the strength's distance from the threshold, shifted
so that the threshold scores 0.3.

Every labelled document that is not held out teaches, in all its pairs. Pairs
are not written out: a Newton step sums the features of good and of bad documents
by bins of strength, a 32nd wide, and pairs of bins then stand for their pairs, at
the bins' mean strengths. A second pass sums the products of features, weighted
by bin. Sums are of whole numbers, equal in any order, and come to the driver as
at most two rows a bin. Without both kinds of labels every document scores 0.5.
Texts that are null or empty have features as any other text (all zero).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paylens.llm.common import map_rows, map_texts, prepare
from paylens.operators.quantiles import values_at

CUT = 0.3
RIDGE = 1e-3
#: Bins of strength a unit; strengths further from 0 than ``FAR`` are in the last bins.
BINS, FAR = 32, 32
#: A Newton step below this ends the descent.
NEAR = 1e-3
#: Rows whose sums are taken at once, as whole numbers of 64 bits.
ROWS = 4096

FEATURES = (
    "letters", "digits", "upper", "blanks", "lines", "stops", "odd_signs", "bars", "non_ascii", "controls",
    "word_length", "long_words", "distinct", "distinct_rate", "repeated_lines", "same_word_runs", "length", "signs_in_words",
)


def _bytes_in(low: str) -> np.ndarray:
    return np.isin(np.arange(256), list(low.encode()))


_DIGITS, _UPPER = _bytes_in("0123456789"), _bytes_in("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LETTERS = _bytes_in("abcdefghijklmnopqrstuvwxyz") | _UPPER | (np.arange(256) >= 128)
_STOPS = _bytes_in(".,;:?'\"-()")
_CONTROLS = (np.arange(256) < 32) & ~_bytes_in("\n\r\t")
_ODD = (np.arange(256) > 32) & (np.arange(256) < 127) & ~(_DIGITS | _LETTERS | _STOPS)
#: A column a class of bytes: each byte's share in the classes.
_CLASSES = np.stack([_LETTERS, _DIGITS, _UPPER, _bytes_in(" "), _bytes_in("\n"), _STOPS, _ODD, _bytes_in("|"), np.arange(256) >= 192, _CONTROLS], 1).astype(float)


def features(text: str) -> np.ndarray:
    """The features of a whole text."""
    out = np.zeros(len(FEATURES))
    raw = text.encode()
    if not raw:
        return out
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    out[:10] = counts @ _CLASSES / len(raw)
    words = raw.split()
    if words:
        n = len(words)
        kinds = set(words)
        lengths = np.fromiter(map(len, words), np.int64, n)
        out[10] = min(20.0, lengths.mean()) / 10
        out[11] = (lengths > 14).mean()
        out[12] = len(kinds) / n
        out[13] = np.log(1 + len(kinds)) / np.log(1 + n)
        out[15] = sum(map(bytes.__eq__, words, words[1:])) / n
        out[17] = min(1.0, out[6] * len(raw) / n)
    lines = raw.split(b"\n")
    out[14] = 1 - len(set(lines)) / len(lines)
    out[16] = np.log(len(raw)) / 10
    return out


@dataclass(frozen=True)
class Ranking:
    """A learnt ranking: how to scale features, their weights, and the strength at the threshold."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    cut: float = CUT

    def score(self, rows: np.ndarray) -> np.ndarray:
        if not self.weights.any():
            return np.full(len(rows), 0.5)
        distance = (rows - self.mean) / self.scale @ self.weights - self.threshold
        # The same distance in any order of summation.
        distance = np.round(np.clip(distance, -30, 30), 9)
        return 1 / (1 + np.exp(-distance) * (1 - self.cut) / self.cut)


#: What sums rows: keys (good, place), a row each, and whole numbers (how many rows, then one a feature).
Sums = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
#: Applies it to all rows: sums by key, of floats times ``2 ** bits``.
Total = Callable[[Sums], dict[tuple[bool, int], np.ndarray]]


def _whole(values: np.ndarray, bits: int) -> np.ndarray:
    return np.rint(np.ldexp(values, bits)).astype(np.int64)


def _strengths(scaled: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Each row's sum by itself, so that it does not depend on the rows beside it."""
    return (scaled * weights).sum(1)


def _bins(strengths: np.ndarray) -> np.ndarray:
    return np.floor(np.clip(strengths, -FAR, FAR) * BINS).astype(np.int64)


def _moments(rows: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return np.zeros((1, 2), np.int64), np.append(len(rows), _whole(rows, bits).sum(0))[None]


def _by_bin(rows: np.ndarray, good: np.ndarray, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    scaled = (rows - mean) / scale
    keys, of = np.unique(np.stack([good.astype(np.int64), _bins(_strengths(scaled, weights))], 1), axis=0, return_inverse=True)
    sums = np.zeros((len(keys), 1 + rows.shape[1]), np.int64)
    np.add.at(sums, of.ravel(), np.column_stack([np.ones(len(rows), np.int64), _whole(scaled, 24)]))
    return keys, sums


def _products(
    rows: np.ndarray, good: np.ndarray, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, bends: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Products of features, times the row's entry of ``bends`` (by kind and bin); a key's place is the first feature."""
    scaled = (rows - mean) / scale
    weighted = scaled * bends[good.astype(int), _bins(_strengths(scaled, weights)) + FAR * BINS][:, None]
    keys, sums = [], []
    for kind in (False, True):
        mine = good == kind
        for i in range(rows.shape[1]):
            keys.append((int(kind), i))
            sums.append(np.append(mine.sum(), _whole(weighted[mine, i : i + 1] * scaled[mine], 24).sum(0)))
    return np.array(keys), np.array(sums)


def _descended(step: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Newton steps from the slope and bend of the mean loss."""
    weights = np.zeros(len(FEATURES))
    for _ in range(25):
        slope, bend = step(weights)
        move = np.linalg.solve(bend + RIDGE * np.eye(len(weights)), slope + RIDGE * weights)
        weights = weights - move
        if np.abs(move).max() < NEAR:
            break
    return weights


def _preferred(differences: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(differences, -30, 30)))


def _scaling(total: Total) -> tuple[np.ndarray, np.ndarray]:
    found = total(lambda rows, good: _moments(rows, 40))[False, 0]
    mean = np.ldexp(found[1:], -40) / found[0]
    found = total(lambda rows, good: _moments((rows - mean) ** 2, 46))[False, 0]
    scale = np.sqrt(np.ldexp(found[1:], -46) / found[0])
    return mean, np.where(scale > 1e-6, scale, 1.0)


def _of_all_pairs(total: Total, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """The weights that minimise the loss over all pairs of a good and a bad row."""

    def step(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = total(lambda rows, good: _by_bin(rows, good, mean, scale, weights))
        bins, numbers, sums = [], [], []
        for kind in (False, True):
            keys = sorted(k for k in found if k[0] == kind)
            bins.append(np.array([place for _, place in keys]) + FAR * BINS)
            numbers.append(np.array([found[k][0] for k in keys]))
            sums.append(np.ldexp(np.array([found[k][1:] for k in keys]), -24) / numbers[-1].sum())
        (n_bad, n_good), (bad, good) = (n / n.sum() for n in numbers), sums
        p = _preferred((good @ weights / n_good)[:, None] - (bad @ weights / n_bad)[None])
        slope = (p - 1) @ n_bad @ good - n_good @ (p - 1) @ bad
        bent = p * (1 - p)
        bends = np.zeros((2, 2 * FAR * BINS + 1))
        bends[0, bins[0]], bends[1, bins[1]] = n_good @ bent, bent @ n_bad
        found = total(lambda rows, labels: _products(rows, labels, mean, scale, weights, bends))
        bend = -good.T @ bent @ bad
        bend = bend + bend.T
        for (_, i), values in found.items():
            bend[i] += np.ldexp(values[1:], -24) / values[0]
        return slope, (bend + bend.T) / 2

    return _descended(step)


def _of_drawn_pairs(scaled: np.ndarray, good: np.ndarray, pairs: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    differences = scaled[rng.choice(np.flatnonzero(good), pairs)] - scaled[rng.choice(np.flatnonzero(~good), pairs)]

    def step(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = _preferred(differences @ weights)
        return differences.T @ (p - 1) / pairs, (differences * (p * (1 - p))[:, None]).T @ differences / pairs

    return _descended(step)


def _untaught(cut: float) -> Ranking:
    k = len(FEATURES)
    return Ranking(np.zeros(k), np.ones(k), np.zeros(k), 0.0, cut)


def fitted(rows: np.ndarray, good: np.ndarray, pairs: int | None = None, cut: float = CUT, seed: int = 1) -> Ranking:
    """What ``learnt`` learns, from feature rows and labels at hand; from ``pairs`` drawn pairs, if that is fewer than all."""
    if not good.any() or good.all():
        return _untaught(cut)

    def total(of: Sums) -> dict[tuple[bool, int], np.ndarray]:
        return {(bool(kind), int(place)): values.astype(float) for (kind, place), values in zip(*of(rows, good))}

    mean, scale = _scaling(total)
    scaled = (rows - mean) / scale
    if pairs is None or pairs >= int(good.sum()) * int((~good).sum()):
        weights = _of_all_pairs(total, mean, scale)
    else:
        weights = _of_drawn_pairs(scaled, good, pairs, seed)
    threshold = float(np.quantile(_strengths(scaled, weights), float((~good).mean()), method="midpoint"))
    return Ranking(mean, scale, weights, threshold, cut)


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows and labels of a batch of (good, features)."""
    rows = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
    return rows, np.array(batch.column(0).to_pylist(), bool)


def _total(taught: DataFrame) -> Total:
    columns = [f"s{i}" for i in range(1 + len(FEATURES))]
    schema = "good boolean, place int, " + ", ".join(f"{c} long" for c in columns)

    def total(of: Sums) -> dict[tuple[bool, int], np.ndarray]:
        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS):
                    keys, sums = of(*_arrays(batch.slice(at, ROWS)))
                    yield {"good": (keys[:, 0] > 0).tolist(), "place": keys[:, 1].tolist()} | dict(zip(columns, sums.T.tolist()))

        each = map_rows(taught.select("good", "features"), schema, rows)
        found = each.groupBy("good", "place").agg(*(F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in columns)).collect()
        return {(r["good"], r["place"]): np.array([float(r[c]) for c in columns]) for r in found}

    return total


def learnt(
    docs: DataFrame,
    labels: DataFrame,
    held_out: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    sample: int | None = None,
) -> Ranking:
    """Learn from all labelled documents that are not held out.

    Features are taken before the join, so that no text is shuffled, and kept for
    the passes. Of labels that disagree, the lowest holds. Labels of absent
    documents and rows without an id teach nothing. With ``sample``, weights come
    from as many documents only, the first of each kind by a hash of the id, half
    of them each or more where the other kind has fewer; the threshold is that of
    all.
    """
    prepare(docs.sparkSession)
    labelled = (
        labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
        .where("id is not null and label is not null")
        .groupBy("id")
        .agg((F.min("label") > 0).alias("good"))
    )
    kind = docs.schema[id_col].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        for batch in batches:
            yield {"id": batch.column(0), "features": [features(t or "").tolist() for t in batch.column(1).to_pylist()]}

    texts = docs.where(~held_out).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null")
    found = map_rows(texts, f"id {kind}, features array<double>", rows)
    # Repeated rows of an id teach once.
    taught = found.join(labelled, "id").groupBy("id", "good").agg(F.min("features").alias("features")).checkpoint()
    counts = {r["good"]: r["count"] for r in taught.groupBy("good").count().collect()}
    if len(counts) < 2:
        return _untaught(CUT)
    few = taught
    if sample is not None:
        shares = {kind: max(sample // 2, sample - counts[not kind]) for kind in counts}
        few, more = (taught.where(F.col("good") == kind).orderBy(F.xxhash64("id"), "id").limit(shares[kind]) for kind in (False, True))
        few = few.union(more).checkpoint()
    total = _total(few)
    mean, scale = _scaling(total)
    weights = _of_all_pairs(total, mean, scale)

    def strengths(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        for batch in batches:
            yield {"strength": _strengths((_arrays(batch)[0] - mean) / scale, weights).tolist()}

    n = sum(counts.values())
    place = counts[False] / n * (n - 1)
    ends = math.floor(place), math.ceil(place)
    at = values_at(map_rows(taught.select("good", "features"), "strength double", strengths), "strength", ends)
    return Ranking(mean, scale, weights, (at[ends[0]] + at[ends[1]]) / 2)


def scored(docs: DataFrame, ranking: Ranking, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: held_out, score (0 to 1) and predicted (1 if the score reaches the cut)."""
    shared = prepare(docs.sparkSession).sparkContext.broadcast(ranking)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        for batch in batches:
            scores = _scores(shared.value, batch.column(2).to_pylist())
            predicted = (scores >= shared.value.cut).astype(int).tolist()
            yield {"doc_id": batch.column(0), "held_out": batch.column(1), "score": scores.tolist(), "predicted": predicted}

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out.alias("held_out"), F.col(text_col).alias("text"))
    return map_rows(chosen, "doc_id long, held_out boolean, score double, predicted int", rows)


def _scores(ranking: Ranking, texts: list) -> np.ndarray:
    if not texts:
        return np.empty(0)
    return ranking.score(np.array([features(t or "") for t in texts]))


def accepted(docs: DataFrame, ranking: Ranking, text_col: str = "text") -> DataFrame:
    """The documents whose score reaches the cut, all columns as they are."""
    shared = prepare(docs.sparkSession).sparkContext.broadcast(ranking)

    def change(texts: list) -> tuple[list, list]:
        return texts, (_scores(shared.value, texts) >= shared.value.cut).tolist()

    return map_texts(docs, text_col, change)
