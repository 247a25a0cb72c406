"""Document fingerprints by consistent weighted sampling.

A document is a bag of words, each weighted by its count. For every coordinate
k, a word draws r and c from Gamma(2, 1) and b from [0, 1), all from a hash of
the word and k, so that each document that has the word draws the same. With
weight w, t = floor(ln w / r + b) and ln a = ln c - r (t - b) - r. The word
with the least a is sampled, together with its t. Two documents sample the same
pair with a probability equal to their generalised Jaccard similarity, the sum
of the lesser weights over the sum of the greater ones.

Words are runs between ASCII white space as they stand; a word of over 32 bytes
counts as its windows of 8 bytes, so that a text without spaces is compared in
parts. Null is an empty text. Empty texts share one fingerprint, alike to each
other (1.0) and to nothing else.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paylens.llm.common import map_rows, mixed, prepare, streams

COORDINATES = 64
LONG_WORD, PIECE = 32, 8
#: Several ranges a partition even out its size.
RANGES_A_PARTITION = 4
#: Words whose draws a worker keeps at a time: 512 bytes each.
KEPT_WORDS = 300_000


def term_weights(text: str) -> Counter:
    """Counts of the words of a text, in UTF-8."""
    counts = Counter(text.encode().split())
    for word in [w for w in counts if len(w) > LONG_WORD]:
        n = counts.pop(word)
        for piece, m in Counter(word[i : i + PIECE] for i in range(len(word) - PIECE + 1)).items():
            counts[piece] += n * m
    return counts


class Sampler:
    """Signatures of weighted terms. A signature is one 32-bit number a coordinate."""

    def __init__(self, coordinates: int = COORDINATES, seed: int = 1, kept: int = KEPT_WORDS):
        self.n, self.kept = coordinates, kept
        self.lanes = [streams(coordinates, seed + i) for i in range(3)]
        self.at: dict[tuple[bytes, int], int] = {}
        self.draws = np.empty((0, coordinates), np.uint64)
        self.empty = np.zeros(coordinates, np.uint32)

    def _draw(self, terms: list[tuple[bytes, int]]) -> np.ndarray:
        """For each term and coordinate ln a in the upper 32 bits, orderable, and the sampled pair below."""
        keys = np.array([xxhash.xxh64_intdigest(t) for t, _ in terms], np.uint64)[:, None]
        weights = np.array([w for _, w in terms], np.float32)[:, None]
        with np.errstate(over="ignore"):
            first, second = mixed(keys * self.lanes[0]), mixed(keys * self.lanes[1])
            r, ln_c = _gamma(first), np.log(_gamma(second))
            b = (first & np.uint64(0xFFFF)).astype(np.int32).astype(np.float32) * np.float32(2.0**-16)
            pair = np.broadcast_to(mixed(keys) >> np.uint64(32), r.shape)
            if weights.max() == 1:  # t is 0 everywhere
                ln_a = ln_c + r * (b - np.float32(1))
            else:
                t = np.floor(np.log(weights) / r + b)
                ln_a = ln_c - r * (t - b) - r
                pair = mixed(keys ^ (t.astype(np.int64).view(np.uint64) * self.lanes[2])) >> np.uint64(32)
            bits = ln_a.view(np.uint32)
            order = np.where(bits >> np.uint32(31), ~bits, bits | np.uint32(0x80000000))
        return order.astype(np.uint64) << np.uint64(32) | pair

    def _drawn(self, terms: list[tuple[bytes, int]]) -> np.ndarray:
        """The same, by parts that fit a processor's cache; words that occur once are the cheaper ones."""
        once = [i for i, (_, w) in enumerate(terms) if w == 1]
        more = [i for i, (_, w) in enumerate(terms) if w != 1]
        out = np.empty((len(terms), self.n), np.uint64)
        for places in (once, more):
            for i in range(0, len(places), 512):
                part = places[i : i + 512]
                out[part] = self._draw([terms[k] for k in part])
        return out

    def signature(self, weights: Counter) -> np.ndarray:
        terms = list(weights.items())
        if not terms:
            return self.empty
        if len(terms) > self.kept:  # a very long text: in parts, past the store
            least = [self._drawn(terms[i : i + 4096]).min(0) for i in range(0, len(terms), 4096)]
            return np.min(least, 0).astype(np.uint32)
        at = self.at
        rows = [at.get(t, -1) for t in terms]
        missing = [i for i, row in enumerate(rows) if row < 0]
        if missing:
            if len(at) + len(missing) > self.kept:
                at.clear()
                missing = list(range(len(terms)))
            start = len(at)
            if start + len(missing) > len(self.draws):
                grown = np.empty((min(self.kept, max(4096, 2 * (start + len(missing)))), self.n), np.uint64)
                grown[:start] = self.draws[:start]
                self.draws = grown
            drawn = [terms[i] for i in missing]
            self.draws[start : start + len(missing)] = self._drawn(drawn)
            at.update(zip(drawn, range(start, start + len(drawn))))
            for place, i in enumerate(missing, start):
                rows[i] = place
        return np.minimum.reduce(self.draws[rows], axis=0).astype(np.uint32)

    def of_text(self, text: str) -> np.ndarray:
        return self.signature(term_weights(text))


def _gamma(x: np.ndarray) -> np.ndarray:
    """Gamma(2, 1) of the upper two times 24 of 64 random bits."""
    high = (x >> np.uint64(40)).astype(np.int32).astype(np.float32) + np.float32(1)
    low = ((x >> np.uint64(16)).astype(np.uint32) & np.uint32(0xFFFFFF)).view(np.int32).astype(np.float32) + np.float32(1)
    return np.maximum(-np.log(high * np.float32(2.0**-24) * (low * np.float32(2.0**-24))), np.float32(1e-9))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal coordinates: an estimate of the generalised Jaccard similarity."""
    return float(np.mean(a == b))


def printed(signature: np.ndarray) -> str:
    return signature.astype(">u4").tobytes().hex()


_SAMPLERS: dict[int, Sampler] = {}


def worker_sampler(coordinates: int) -> Sampler:
    """One sampler a Python worker, kept from task to task for the draws that it holds."""
    if coordinates not in _SAMPLERS:
        _SAMPLERS[coordinates] = Sampler(coordinates)
    return _SAMPLERS[coordinates]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", coordinates: int = COORDINATES) -> DataFrame:
    """One row a document: its id and its fingerprint in hexadecimal."""
    prepare(docs.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        sampler = worker_sampler(coordinates)
        for batch in batches:
            yield {
                "doc_id": batch.column(0),
                "fingerprint": [printed(sampler.of_text(t or "")) for t in batch.column(1).to_pylist()],
            }

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_rows(chosen, "doc_id long, fingerprint string", rows)


def edited(text: str, following: str) -> str:
    """The last third of a text replaced by as much of the beginning of another."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def neighbour_fingerprints(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    coordinates: int = COORDINATES,
    ranges: int | None = None,
) -> DataFrame:
    """Fingerprints of each text and its edited text, and how near the text is to both its neighbours.

    The next document is the one with the next lower id, after the last the
    first. Ids are cut into ranges of like numbers of rows (some for each of the
    session's shuffle partitions); each range also gets a copy of the first
    document of the range below. So the texts are shuffled once, a task streams
    its sorted range, and no window gathers all rows. What the driver sees are
    one bound and one greatest id a range.

    Rows without an id come last; rows of one id follow each other by text. An
    only row follows itself.
    """
    spark = prepare(docs.sparkSession)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = ranges or RANGES_A_PARTITION * partitions
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ids = chosen.select("doc_id")
    cuts = ids.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 100 * n)).first()[0] or []
    bounds = [float("-inf"), *sorted({float(c) for c in cuts}), float("inf")]

    def with_range(df: DataFrame) -> DataFrame:
        if len(bounds) == 2:
            df = df.withColumn("at", F.lit(0.0))
        else:
            cutter = Bucketizer(splits=bounds, inputCol="number", outputCol="at", handleInvalid="keep")
            df = cutter.transform(df.withColumn("number", F.coalesce(F.col("doc_id").cast("double"), F.lit(0.0))))
        at = F.when(F.col("doc_id").isNull(), -1).otherwise(F.col("at").cast("int"))
        return df.select("doc_id", *[c for c in df.columns if c == "text"], at.alias("range"))

    # At most one row a range.
    first = with_range(ids).groupBy("range").agg(F.max("doc_id").alias("top")).orderBy(F.desc("range")).collect()
    above = [r["range"] for r in first[-1:] + first[:-1]]
    halo = spark.createDataFrame(
        [(r["top"], r["range"], to) for r, to in zip(first, above)], "top long, in_range int, also int"
    )
    placed = (
        with_range(chosen)
        .join(F.broadcast(halo), F.col("doc_id").eqNullSafe(F.col("top")) & (F.col("range") == F.col("in_range")), "left")
        .select(
            "doc_id",
            "text",
            F.explode(
                F.when(
                    F.col("also").isNotNull(),
                    F.array(F.struct(F.col("range").alias("at"), F.lit(0).alias("copy")), F.struct(F.col("also").alias("at"), F.lit(1).alias("copy"))),
                ).otherwise(F.array(F.struct(F.col("range").alias("at"), F.lit(0).alias("copy"))))
            ).alias("place"),
        )
        .select("doc_id", "text", "place.at", "place.copy")
        .repartition(partitions, "at")
        .sortWithinPartitions(F.desc("at"), "copy", F.desc("doc_id"), "text")
    )

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        sampler = worker_sampler(coordinates)
        before = None  # (range, id, text, signature), still without its next document
        for batch in batches:
            out = {c: [] for c in ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")}
            for doc_id, text, at, copy in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "at", "copy"))):
                if copy and (before is None or before[0] != at):
                    continue  # further rows of the id that begins the range below
                own = sampler.of_text(text)
                if before is not None and before[0] == at:
                    _, last_id, last, signature = before
                    changed = edited(last, text)
                    other = signature if changed == last else sampler.of_text(changed)
                    for name, value in (
                        ("doc_id", last_id), ("n_chars", len(last)),
                        ("edited_sha256", hashlib.sha256(changed.encode()).hexdigest()),
                        ("fingerprint", printed(signature)), ("edited_fingerprint", printed(other)),
                        ("near_edited", likeness(signature, other)), ("near_next", likeness(signature, own)),
                    ):
                        out[name].append(value)
                before = None if copy else (at, doc_id, text, own)
            yield out

    return map_rows(
        placed,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string,"
        " near_edited double, near_next double",
        rows,
    )
