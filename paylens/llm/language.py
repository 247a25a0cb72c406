"""Language identification by hyperdimensional profiles.

Each letter has a fixed random vector of +1 and -1, drawn from a hash of its
code point. A trigram's vector binds those of its letters, the first rotated
twice and the second once, by products. A document's vector bundles (sums)
those of its trigrams; a language's prototype bundles its documents, each scaled
to one length. A document gets the language of the nearest prototype by cosine.

Texts are lower-cased; what is no letter parts words, and one blank stands
between them. Texts that are null or have no letter are ``und`` with score 0.
Prototypes are learnt from all labelled documents, whose vectors are summed in
tasks; with no labelled document at all, every text is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paylens.llm.common import map_rows, mixed, prepare

DIMENSIONS = 1024
#: Trigrams whose vectors a worker keeps, one byte a dimension.
KEPT_TRIGRAMS = 60_000
#: Documents, and letters, of one product of counts and vectors.
GROUP, GROUP_LETTERS = 64, 2_000_000

_BLANK = 0x20


class Profiles:
    def __init__(self, dimensions: int = DIMENSIONS):
        self.d = dimensions
        self.at: dict[int, int] = {}
        self.vectors = np.empty((0, dimensions), np.int8)
        self.letters: dict[int, np.ndarray] = {}
        self.alphabet: np.ndarray | None = None

    def letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            lanes = np.arange((self.d + 63) // 64, dtype=np.uint64) + np.uint64(code) * np.uint64(1 << 20)
            bits = np.unpackbits(mixed(mixed(lanes)).view(np.uint8))[: self.d]
            self.letters[code] = bits.astype(np.int8) * 2 - 1
        return self.letters[code]

    def trigram(self, code: int) -> np.ndarray:
        a, b, c = code >> 42, code >> 21 & 0x1FFFFF, code & 0x1FFFFF
        return np.roll(self.letter(a), 2) * np.roll(self.letter(b), 1) * self.letter(c)

    def trigrams(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Distinct trigrams, of three code points each, and their counts."""
        if self.alphabet is None:
            self.alphabet = np.array([chr(c).isalpha() for c in range(0x110000)])
        codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = np.where(self.alphabet[codes], codes, _BLANK)
        kept = codes != _BLANK
        if not kept.any():
            return np.empty(0, np.int64), np.empty(0, np.int64)
        kept[1:] |= codes[:-1] != _BLANK  # the first blank of each run
        codes = codes[kept]
        codes = codes[int(codes[0] == _BLANK) : len(codes) - int(codes[-1] == _BLANK)]
        codes = np.concatenate([[_BLANK], codes, [_BLANK]]).astype(np.int64)
        return np.unique(codes[:-2] << 42 | codes[1:-1] << 21 | codes[2:], return_counts=True)

    def rows(self, grams: np.ndarray) -> np.ndarray:
        """Places of the trigrams' vectors."""
        listed = grams.tolist()
        missing = [g for g in listed if g not in self.at]
        if missing:
            if len(self.at) + len(missing) > max(KEPT_TRIGRAMS, len(listed)):
                self.at.clear()
                missing = listed
            need = len(self.at) + len(missing)
            if need > len(self.vectors):
                grown = np.empty((max(4096, 2 * need), self.d), np.int8)
                grown[: len(self.at)] = self.vectors[: len(self.at)]
                self.vectors = grown
            for g in missing:
                place = self.at[g] = len(self.at)
                self.vectors[place] = self.trigram(g)
        return np.array([self.at[g] for g in listed])

    def bundles(self, texts: list[str]) -> np.ndarray:
        """The vectors of some texts, zero for those without a letter."""
        found = [self.trigrams(t) for t in texts]
        grams, places = np.unique(np.concatenate([g for g, _ in found]), return_inverse=True)
        out = np.zeros((len(texts), self.d), np.float32)
        ends = np.cumsum([len(g) for g, _ in found])
        for start in range(0, len(grams), 8192):
            part = grams[start : start + 8192]
            counts = np.zeros((len(texts), len(part)), np.float32)
            for i, (g, n) in enumerate(found):
                at = places[ends[i] - len(g) : ends[i]] - start
                inside = (at >= 0) & (at < len(part))
                counts[i, at[inside]] = n[inside]
            at = self.rows(part)
            out += counts @ self.vectors[at].astype(np.float32)
        return out


_PROFILES: dict[int, Profiles] = {}


def worker_profiles(dimensions: int) -> Profiles:
    if dimensions not in _PROFILES:
        _PROFILES[dimensions] = Profiles(dimensions)
    return _PROFILES[dimensions]


def _grouped(texts: list[str]) -> Iterator[list[str]]:
    group: list[str] = []
    letters = 0
    for text in texts:
        group.append(text)
        letters += len(text)
        if len(group) == GROUP or letters > GROUP_LETTERS:
            yield group
            group, letters = [], 0
    if group:
        yield group


def prototypes(docs: DataFrame, text_col: str, lang_col: str, dimensions: int) -> tuple[list[str], np.ndarray]:
    """Names and unit vectors of the languages of all labelled documents."""
    labelled = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    labelled = labelled.where("lang is not null and text is not null")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        profiles, sums = worker_profiles(dimensions), {}
        for batch in batches:
            texts, langs = (batch.column(i).to_pylist() for i in (0, 1))
            at = 0
            for group in _grouped(texts):
                vectors = profiles.bundles(group)
                lengths = np.linalg.norm(vectors, axis=1, keepdims=True)
                # Whole numbers, so that sums do not depend on their order.
                scaled = np.rint(1e4 * vectors / np.maximum(lengths, 1e-9)).astype(np.int64)
                for lang, v in zip(langs[at : at + len(group)], scaled):
                    sums[lang] = sums[lang] + v if lang in sums else v
                at += len(group)
        for lang, v in sums.items():
            yield {"lang": [lang] * dimensions, "place": list(range(dimensions)), "value": v.tolist()}

    parts = map_rows(labelled, "lang string, place int, value long", rows)
    # One row a language and dimension.
    summed = parts.groupBy("lang", "place").agg(F.sum("value").alias("value")).collect()
    names = sorted({r["lang"] for r in summed})
    table = np.zeros((len(names), dimensions))
    where = {name: i for i, name in enumerate(names)}
    for r in summed:
        table[where[r["lang"]], r["place"]] = r["value"]
    lengths = np.linalg.norm(table, axis=1)
    used = lengths > 0
    return [n for n, u in zip(names, used) if u], (table[used] / lengths[used, None]).astype(np.float32)


def identified(
    docs: DataFrame,
    held_out: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    dimensions: int = DIMENSIONS,
) -> DataFrame:
    """One row a document: held_out, the predicted language and its cosine (0 if negative).

    Labels of held-out documents are not looked at. Labels serve to learn
    prototypes only; a prediction sees nothing but the text.
    """
    prepare(docs.sparkSession)
    names, table = prototypes(docs.where(~held_out), text_col, lang_col, dimensions)
    shared = docs.sparkSession.sparkContext.broadcast((names, table))  # languages times dimensions

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        profiles = worker_profiles(dimensions)
        names, table = shared.value
        for batch in batches:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            langs, scores = [], []
            for group in _grouped(texts):
                vectors = profiles.bundles(group)
                lengths = np.linalg.norm(vectors, axis=1)
                if not names:
                    langs.extend(["und"] * len(group))
                    scores.extend([0.0] * len(group))
                    continue
                cosines = (vectors @ table.T) / np.maximum(lengths, 1e-9)[:, None]
                best = cosines.argmax(1)
                for i, b in enumerate(best):
                    langs.append(names[b] if lengths[i] else "und")
                    scores.append(float(min(1.0, max(0.0, cosines[i, b]))) if lengths[i] else 0.0)
            yield {"doc_id": batch.column(0), "held_out": batch.column(1), "lang_pred": langs, "score": scores}

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out.alias("held_out"), F.col(text_col).alias("text"))
    return map_rows(chosen, "doc_id long, held_out boolean, lang_pred string, score double", rows)
