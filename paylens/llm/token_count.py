"""Token counts by pre-token.

A text is cut into pre-tokens: a run of blanks with the word after it. No piece
of the vocabulary holds a blank after another character (checked when the model
is loaded), so no merge crosses a cut, and the pieces of a text are the pieces
of its pre-tokens. Pieces are counted once for each distinct pre-token of the table; the counts are
joined to the frequencies of pre-tokens in each document, and their products
summed. Ids of a text are never made.

1. *Frequent pre-tokens.* Each task names its most frequent pre-tokens, of which
   a bounded number is kept, counted once and sent to all tasks. That bound is
   no cap: it only tells which of two joins a pre-token takes.
2. *The others* go with their frequencies, a row for each document that has one,
   to the task that their pre-token is dealt to. There equal ones follow each
   other and are counted once. A pre-token that a task did not name makes up a
   small share of the task's, so none of them is a hot key.
3. *Sums* by document, of what was joined and of the document's frequent ones;
   Spark combines the rows of a task before they are shuffled.

Null is an empty text, of no tokens. Documents are told apart by their place in
the table, so repeated rows, and rows of one id or none, each give a row of
their own. A very long text without blanks is one pre-token like others. A table
without rows gives none.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain, groupby, islice
from operator import itemgetter

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paylens.llm.common import map_rows, prepare, sliced

#: Frequent pre-tokens that all tasks get, of up to SHORT bytes; and longer ones, of up to LONG bytes.
FREQUENT, SHORT = 200_000, 64
FREQUENT_LONG, LONG = 100, 100_000
#: Frequent pre-tokens that a task names, and distinct ones that it keeps count of to find them.
NAMED, KEPT = 20_000, 400_000
#: Pre-tokens that are counted at a time, rows of one that wait for it, and rows that are handed on at a time.
AT_ONCE, FEW, ROWS = 4096, 64, 100_000
_MARK = "\u2581"
#: A blank, or the mark that the model writes for it.
_SPLIT = re.compile(f"[ {_MARK}]+[^ {_MARK}]*")


class PieceCounter:
    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any(_MARK in p.lstrip(_MARK) for p in pieces):
            raise ValueError("a piece crosses pre-tokens")
        self.begins = np.array([p.startswith(_MARK) for p in pieces])

    def frequencies(self, text: str) -> Counter:
        """How often each pre-token occurs, without its first blank; a run of blanks at the end as a mark and its length."""
        if not text:
            return Counter()
        if "  " not in text and _MARK not in text and text[-1] != " " and text[0] != " ":
            return Counter(text.split(" "))
        found = Counter(p[1:].replace(_MARK, " ") for p in _SPLIT.findall(" " + text))
        end = len(text) + 1 - len((" " + text).rstrip(" " + _MARK))
        if end:
            found[" " * (end - 1)] -= 1
            found = +found
            found[f"{_MARK}{end}"] = 1
        return found

    def count(self, pretokens: list[str]) -> list[int]:
        """Pieces of each pre-token. The model itself puts the first blank before a text.

        Words are read as one text, in which each piece with a blank begins a
        new one; runs of several blanks are read one by one.
        """
        sizes = [0] * len(pretokens)
        plain = [i for i, p in enumerate(pretokens) if p and " " not in p and p[0] != _MARK]
        if plain:
            ids = np.array(self.model.encode(" ".join([pretokens[i] for i in plain])))
            begins = np.flatnonzero(self.begins[ids])
            for i, n in zip(plain, np.diff(np.append(begins, len(ids))).tolist(), strict=True):
                sizes[i] = n
        for i, p in enumerate(pretokens):
            if p[:1] == _MARK:  # taken behind a letter
                sizes[i] = len(self.model.encode("a" + " " * int(p[1:]))) - len(self.model.encode("a"))
            elif " " in p:
                sizes[i] = len(self.model.encode(p))
        return sizes

    def n_tokens(self, text: str) -> int:
        frequencies = self.frequencies(text)
        return sum(map(int.__mul__, self.count(list(frequencies)), frequencies.values()))


def named(texts: Iterator[str], counter: PieceCounter) -> list[tuple[str, int]]:
    """The most frequent pre-tokens of a task that occur twice at least, with about how often they do."""
    counts: Counter = Counter()
    for text in texts:
        counts.update(counter.frequencies(text))
        if len(counts) > KEPT:
            counts = Counter(dict(counts.most_common(KEPT // 2)))
    return [(p, n) for p, n in counts.most_common(NAMED) if n > 1 and len(p.encode()) <= LONG]


def joined_counts(rows: Iterator[tuple[int, str, int]], counter: PieceCounter) -> Iterator[tuple[list[int], list[int]]]:
    """(documents, pieces) of (document, pre-token, frequency) sorted by pre-token; each pre-token is counted once."""
    docs: list[int] = []
    pieces: list[int] = []
    pretokens: list[str] = []
    waiting: list[list[tuple[int, str, int]]] = []

    def settle() -> int:
        """Count what waits; pieces of the last one."""
        sizes = counter.count(pretokens)
        for size, run in zip(sizes, waiting, strict=True):
            for doc, _, n in run:
                docs.append(doc)
                pieces.append(size * n)
        pretokens.clear()
        waiting.clear()
        return sizes[-1] if sizes else 0

    for pretoken, run in groupby(rows, itemgetter(1)):
        pretokens.append(pretoken)
        waiting.append(list(islice(run, FEW)))
        if len(waiting[-1]) == FEW:  # of many documents: the others are joined as they come
            size = settle()
            for doc, _, n in run:
                docs.append(doc)
                pieces.append(size * n)
                if len(docs) >= ROWS:
                    yield docs, pieces
                    docs, pieces = [], []
        elif len(pretokens) >= AT_ONCE:
            settle()
        if len(docs) >= ROWS:
            yield docs, pieces
            docs, pieces = [], []
    settle()
    yield docs, pieces


def frequent_counts(texts: DataFrame, model: str) -> DataFrame:
    """(pretoken, n_pieces) of the frequent pre-tokens of a column of texts, a bounded number of rows."""

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        counter = PieceCounter(model)
        found = named((t or "" for batch in sliced(batches) for t in batch.column(0).to_pylist()), counter)
        yield {"pretoken": [p for p, _ in found], "n": [n for _, n in found]}

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        counter = PieceCounter(model)
        for batch in batches:
            pretokens = batch.column(0).to_pylist()
            yield {"pretoken": pretokens, "n_pieces": counter.count(pretokens)}

    found = map_rows(texts, "pretoken string, n long", names).groupBy("pretoken").agg(F.sum("n").alias("n")).checkpoint()
    size = F.octet_length("pretoken")
    order = F.desc("n"), "pretoken"
    short = found.where(size <= SHORT).orderBy(*order).limit(FREQUENT)
    long = found.where(size > SHORT).orderBy(*order).limit(FREQUENT_LONG)
    return map_rows(short.unionByName(long).select("pretoken"), "pretoken string, n_pieces long", counted)


def token_counts(docs: DataFrame, model: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: n_bytes in UTF-8, n_tokens, and whether these are over the limit.

    ``model`` is the file of a sentencepiece model on every machine. ``docs``
    should have its rows in places that a second reading keeps, as a stored table has.
    """
    spark = prepare(docs.sparkSession)
    texts = docs.select(F.col(text_col).alias("text"))
    # FREQUENT * SHORT + FREQUENT_LONG * LONG bytes at most.
    frequent = {r["pretoken"]: r["n_pieces"] for r in frequent_counts(texts, model).collect()}
    shared = spark.sparkContext.broadcast(frequent)
    sums_schema = "place long, doc_id long, n_bytes long, n_tokens long"

    def parted(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        """A row a document with the sum of its frequent pre-tokens, and a row for each of its other ones."""
        counter, known = PieceCounter(model), shared.value
        for batch in sliced(batches):
            sizes, sums, places, others, times = [], [], [], [], []
            for place, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                total = 0
                for pretoken, n in counter.frequencies(text or "").items():
                    pieces = known.get(pretoken)
                    if pieces is not None:
                        total += pieces * n
                    else:
                        places.append(place)
                        others.append(pretoken)
                        times.append(n)
                sizes.append(len((text or "").encode()))
                sums.append(total)
            none = [None] * len(sums)
            yield {"place": batch.column(0), "doc_id": batch.column(1), "n_bytes": sizes, "n_tokens": sums, "pretoken": none}
            none = [None] * len(places)
            yield {"place": places, "doc_id": none, "n_bytes": none, "n_tokens": times, "pretoken": others}

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        """Rows of documents, which come first, as they are; then the pieces of their others that are here."""
        counter = PieceCounter(model)
        slices = sliced(batches)
        rest = []
        for batch in slices:
            at = batch.column(4).null_count
            yield {f: batch.column(f).slice(0, at) for f in ("place", "doc_id", "n_bytes", "n_tokens")}
            if at < batch.num_rows:
                rest = [batch.slice(at)]
                break
        others = chain(rest, slices)
        rows = (r for b in others for r in zip(b.column(0).to_pylist(), b.column(4).to_pylist(), b.column(3).to_pylist()))
        for places, pieces in joined_counts(rows, counter):
            none = pa.nulls(len(places), pa.int64())
            yield {"place": places, "doc_id": none, "n_bytes": none, "n_tokens": pieces}

    chosen = docs.select(
        F.monotonically_increasing_id().alias("place"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")
    )
    where = F.when(F.col("pretoken").isNull(), F.col("place")).otherwise(F.xxhash64("pretoken"))
    dealt = map_rows(chosen, f"{sums_schema}, pretoken string", parted).repartition(where)
    found = map_rows(dealt.sortWithinPartitions("pretoken"), sums_schema, joined)
    whole = found.groupBy("place").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum("n_tokens").alias("n_tokens")
    )
    return whole.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
