"""Benchmark decontamination by a generalised suffix automaton of the test items.

The automaton is built over the words of all items: its states are the classes
of word sequences that end at the same places. A document's words run through
it, and at each word the longest match that ends there is known. A match as
long as the window means that the window occurs in an item; the states reached
by suffix links tell which items.

Words are runs of letters, digits and non-ASCII code points, A-Z in lower case.
A window is 10 consecutive words of an item; an item of fewer words is one
window. Null texts, and texts without words, match nothing. Items without an id
mark words but are not listed. Repeated items count once; repeated documents
come out as often as they come in, and a table of no items marks nothing. Texts
are read whole, however long. There are no ties: all items that occur are named.

Items are dealt over blocks of about ``block_bytes``. Tasks build the automata,
one for each block, and a table holds them packed. A block takes some 40 bytes
of a worker for each byte of its items (``tests/llm/test_pure.py`` bounds it),
so that the 8 MB of ``BLOCK_BYTES`` stay at a third of a gigabyte. An item is
never cut: one of more bytes makes a block as large as itself.
"""

from __future__ import annotations

import math
import pickle
import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paylens.llm.common import letter_words, map_rows, map_texts, prepare

WINDOW = 10
#: Share of a document's words beyond which all of it goes, not only its spans.
MAX_COVERAGE = 0.5
#: UTF-8 bytes of items in one automaton. More items make more automata, used one after the other.
BLOCK_BYTES = 8_000_000
#: Bytes of a packed automaton in a row.
_CHUNK = 4_000_000

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


_NO_ARC, _ARCS = -1, -2
_NO_ITEM, _SEVERAL = -1, -2


class Automaton:
    """Suffix automaton of several word sequences.

    Most states have one arc, which lies in two arrays; ``arcs`` holds the
    others'. ``told`` names the state, the same or up the suffix links, whose
    windows end here. A state's own window, as a rule one of one item, lies in
    ``width`` and ``item``; ``windows`` has those of states with several.
    """

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW):
        self.words: dict[bytes, int] = {}
        self.code, self.target = array("i", [_NO_ARC]), array("i", [0])
        self.arcs: dict[int, dict[int, int]] = {}
        self.link, self.length = array("i", [-1]), array("i", [0])
        coded = [(name, array("i", (self.words.setdefault(w, len(self.words)) for w in words))) for name, words in items]
        for _, codes in coded:
            last = 0
            for code in codes:
                last = self._extend(last, code)
        numbers: dict[str, int] = {}
        self.width, self.item = array("i", [0]) * len(self.code), array("i", [_NO_ITEM]) * len(self.code)
        self.windows: dict[int, dict[int, set[int]]] = {}
        for name, codes in coded:
            item = _NO_ITEM if name is None else numbers.setdefault(name, len(numbers))
            width = min(window, len(codes))
            state = 0
            for i, code in enumerate(codes):
                state = self.after(state, code)
                if i + 1 >= width:
                    s = state
                    while self.length[self.link[s]] >= width:
                        s = self.link[s]
                    self._ends(s, width, item)
        self.names = list(numbers)
        self.told = array("i", [-1]) * len(self.code)
        for s in sorted(range(1, len(self.code)), key=self.length.__getitem__):
            self.told[s] = s if self.width[s] else self.told[self.link[s]]

    def _ends(self, state: int, width: int, item: int) -> None:
        """A window of the item ends at the state."""
        own = self.width[state]
        if not own:
            self.width[state], self.item[state] = width, item
        elif own == _SEVERAL:
            self.windows[state].setdefault(width, set()).add(item)
        elif (own, self.item[state]) != (width, item):
            self.windows[state] = {own: {self.item[state]}}
            self.windows[state].setdefault(width, set()).add(item)
            self.width[state] = _SEVERAL

    def after(self, state: int, code: int) -> int | None:
        own = self.code[state]
        if own == code:
            return self.target[state]
        return self.arcs[state].get(code) if own == _ARCS else None

    def _set(self, state: int, code: int, target: int) -> None:
        own = self.code[state]
        if own == _NO_ARC or own == code:
            self.code[state], self.target[state] = code, target
        elif own == _ARCS:
            self.arcs[state][code] = target
        else:
            self.arcs[state] = {own: self.target[state], code: target}
            self.code[state] = _ARCS

    def _state(self, length: int, link: int, like: int | None = None) -> int:
        state = len(self.code)
        self.code.append(_NO_ARC if like is None else self.code[like])
        self.target.append(0 if like is None else self.target[like])
        if like in self.arcs:
            self.arcs[state] = dict(self.arcs[like])
        self.length.append(length)
        self.link.append(link)
        return state

    def _extend(self, last: int, code: int) -> int:
        link, length = self.link, self.length
        q = self.after(last, code)
        if q is not None:
            return q if length[q] == length[last] + 1 else self._split(last, code, q)
        new = self._state(length[last] + 1, 0)
        p = last
        while p >= 0 and (q := self.after(p, code)) is None:
            self._set(p, code, new)
            p = link[p]
        if p >= 0:
            link[new] = q if length[q] == length[p] + 1 else self._split(p, code, q)
        return new

    def _split(self, p: int, code: int, q: int) -> int:
        copy = self._state(self.length[p] + 1, self.link[q], like=q)
        self.link[q] = copy
        while p >= 0 and self.after(p, code) == q:
            self._set(p, code, copy)
            p = self.link[p]
        return copy

    def matches(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set, int]:
        """Hit ranges of words (merged, end exclusive), names of the items that occur, longest match."""
        codes, target, arcs, code_of = self.code, self.target, self.arcs, self.words.get
        link, length, told, widths = self.link, self.length, self.told, self.width
        state = matched = longest = 0
        hits: list[tuple[int, int]] = []
        named: set[int] = set()
        for i, word in enumerate(words):
            code = code_of(word)
            if code is None:
                state = matched = 0
                continue
            while True:
                own = codes[state]
                onward = target[state] if own == code else arcs[state].get(code) if own == _ARCS else None
                if onward is not None or not state:
                    break
                state = link[state]
                matched = length[state]
            if onward is None:
                continue
            state = onward
            matched += 1
            if matched > longest:
                longest = matched
            at = told[state]
            while at >= 0:
                own = widths[at]
                for width, items in self.windows[at].items() if own == _SEVERAL else ((own, (self.item[at],)),):
                    if width <= matched:
                        start = i + 1 - width
                        while hits and start <= hits[-1][0]:
                            hits.pop()
                        if hits and start <= hits[-1][1]:
                            hits[-1] = (hits[-1][0], i + 1)
                        else:
                            hits.append((start, i + 1))
                        named.update(items)
                at = told[link[at]]
        return hits, {self.names[k] for k in named if k != _NO_ITEM}, longest


class Packed:
    """A pickled automaton. What is broadcast of it is the automaton itself, so that only workers unpack it."""

    def __init__(self, data: bytes):
        self.data = data

    def __reduce__(self):
        return pickle.loads, (self.data,)


def automata(items: DataFrame, id_col: str, text_col: str, window: int, block_bytes: int) -> DataFrame:
    """The automata of all blocks of items as one table: (block, part, data). Tasks build them, a block each.

    The size of all distinct items is measured first, so a block holds about
    ``block_bytes`` of text.
    """
    items = items.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).where("text is not null").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_bytes))

    def build(key: tuple, rows: pa.Table) -> pa.Table:
        worded = [(i, words) for i, t in zip(rows["id"].to_pylist(), rows["text"].to_pylist()) if (words := letter_words(t))]
        data = pickle.dumps(Automaton(worded, window), pickle.HIGHEST_PROTOCOL)
        parts = [data[at : at + _CHUNK] for at in range(0, len(data), _CHUNK)]
        return pa.table(
            {"block": pa.array([key[0].as_py()] * len(parts), pa.int64()), "part": pa.array(range(len(parts)), pa.int64()), "data": pa.array(parts, pa.binary())}
        )

    dealt = items.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)))
    return dealt.groupBy("block").applyInArrow(build, "block long, part long, data binary").checkpoint()


def unpacked(built: DataFrame) -> Iterator[tuple[Packed, bool]]:
    """The automata one after the other, and whether another follows; of no items, one that knows no word."""
    blocks = sorted(r["block"] for r in built.select("block").distinct().collect())
    for k, block in enumerate(blocks):
        parts = sorted(built.where(F.col("block") == block).select("part", "data").collect())
        yield Packed(b"".join(bytes(p["data"]) for p in parts)), k + 1 < len(blocks)
    if not blocks:
        yield Packed(pickle.dumps(Automaton([]))), False


def contamination(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row a document: its number of words, its hit spans of words, the items that occur, the longest match.

    With items of one block, documents are read once and nothing is shuffled.
    Further blocks take a pass each over the checkpointed texts.
    """
    spark = prepare(docs.sparkSession)
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(text_col).alias("text"),
        F.expr("cast(array() as array<struct<start:long,end:long>>)").alias("spans"),
        F.expr("cast(array() as array<string>)").alias("items"),
        F.lit(0).cast("long").alias("longest"),
        F.lit(0).cast("long").alias("n_words"),
    )
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    for automaton, more in unpacked(automata(items, item_id_col, item_text_col, window, block_bytes)):
        rows = map_rows(rows, schema, _step(spark.sparkContext.broadcast(automaton)))
        if more:
            rows = rows.checkpoint()
    return rows.drop("text")


def _step(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        automaton = shared.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            spans, items, longest, n_words = [], [], [], []
            for text, old, named, most in zip(texts, *(batch.column(c).to_pylist() for c in ("spans", "items", "longest"))):
                words = letter_words(text or "")
                hits, names, matched = automaton.matches(words)
                if old:
                    hits = merged([(s["start"], s["end"]) for s in old] + hits)
                spans.append([{"start": a, "end": b} for a, b in hits])
                items.append(sorted(names.union(named)))
                longest.append(max(most, matched))
                n_words.append(len(words))
            yield {"doc_id": batch.column("doc_id"), "text": batch.column("text"), "spans": spans, "items": items, "longest": longest, "n_words": n_words}

    return run


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without these ranges of words; what stands between them stays."""
    places = [m.span() for m in _WORD.finditer(text)]
    kept, at = [], 0
    for a, b in spans:
        kept.append(text[at : places[a][0]])
        at = places[b - 1][1]
    return "".join([*kept, text[at:]])


def without_items(text: str, automaton: Automaton, max_coverage: float) -> tuple[str, bool]:
    """The text without its hit spans, and whether it stays. Cut ends that make a new match are cut again."""
    total = len(letter_words(text))
    gone = 0
    while True:
        hits, _, _ = automaton.matches(letter_words(text))
        if not hits:
            return text, True
        gone += sum(b - a for a, b in hits)
        if gone > max_coverage * total:
            return text, False
        text = without_spans(text, hits)


def decontaminated(
    docs: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    length_col: str | None = None,
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    max_coverage: float = MAX_COVERAGE,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Documents without the spans that occur in an item; those covered beyond the limit go as a whole.

    All columns and clean texts stay as they are. ``length_col`` is set anew
    where a text changed. The result does not depend on the number of blocks:
    with several, the spans of all are gathered on the same text before it is
    judged and cut, and texts that were cut go through all blocks again until
    nothing matches.
    """
    spark = prepare(docs.sparkSession)
    built = automata(items, item_id_col, item_text_col, window, block_bytes)
    blocks = unpacked(built)
    automaton, more = next(blocks)
    if not more:
        return map_texts(docs, text_col, _cut(spark.sparkContext.broadcast(automaton), max_coverage), length_col)

    def quoted(name: str) -> str:
        return f"`{name.replace('`', '``')}`"

    others = [c for c in docs.columns if c != text_col]
    rows = docs.select(
        F.struct(*(map(quoted, others) if others else [F.lit(0)])).alias("row"),
        F.col(quoted(text_col)).alias("text"),
        F.expr("cast(array() as array<struct<start:long,end:long>>)").alias("spans"),
        F.lit(None).cast("long").alias("total"),
        F.lit(0).cast("long").alias("gone"),
        F.lit(True).alias("stays"),
    )
    done: DataFrame | None = None
    while done is None or not rows.isEmpty():
        if done is not None:
            blocks = unpacked(built)
            automaton, more = next(blocks)
        while True:
            rows = rows.mapInArrow(_gather(spark.sparkContext.broadcast(automaton)), rows.schema).checkpoint()
            if not more:
                break
            automaton, more = next(blocks)
        clean = rows.where("size(spans) = 0")
        done = clean if done is None else done.unionByName(clean)
        rows = rows.where("size(spans) > 0")
        rows = rows.mapInArrow(_cut_spans(max_coverage), rows.schema).where("stays").checkpoint()

    def column(name: str):
        if name == text_col:
            return F.col("text").alias(name)
        old = F.col("row").getField(name)
        if name == length_col:
            old = F.when(F.col("gone") > 0, F.char_length("text").cast(docs.schema[name].dataType)).otherwise(old)
        return old.alias(name)

    return done.select(*map(column, docs.columns))


def _cut(shared, max_coverage: float):
    def change(texts: list) -> tuple[list, list]:
        done = [(None, True) if t is None else without_items(t, shared.value, max_coverage) for t in texts]
        return [t for t, _ in done], [stays for _, stays in done]

    return change


def _replaced(batch: pa.RecordBatch, **values: list) -> pa.RecordBatch:
    columns = [pa.array(values[f.name], f.type) if f.name in values else batch.column(f.name) for f in batch.schema]
    return pa.RecordBatch.from_arrays(columns, schema=batch.schema)


def _spans(batch: pa.RecordBatch) -> list[list[tuple[int, int]]]:
    return [[(s["start"], s["end"]) for s in spans] for spans in batch.column("spans").to_pylist()]


def _gather(shared):
    """Add the hits of one block to the spans of texts, which stay as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value
        for batch in batches:
            spans = []
            for text, old in zip(batch.column("text").to_pylist(), _spans(batch)):
                hits, _, _ = automaton.matches(letter_words(text or ""))
                spans.append([{"start": a, "end": b} for a, b in merged(old + hits)])
            yield _replaced(batch, spans=spans)

    return run


def _cut_spans(max_coverage: float):
    """Cut the spans of all blocks out of texts, or mark those covered beyond the limit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, totals, gone, stays = [], [], [], []
            columns = (batch.column(c).to_pylist() for c in ("text", "total", "gone"))
            for text, total, before, spans in zip(*columns, _spans(batch)):
                totals.append(len(letter_words(text)) if total is None else total)
                gone.append(before + sum(b - a for a, b in spans))
                stays.append(gone[-1] <= max_coverage * totals[-1])
                texts.append(without_spans(text, spans) if stays[-1] else text)
            yield _replaced(batch, text=texts, total=totals, gone=gone, stays=stays, spans=[[]] * len(texts))

    return run


def digest(found: DataFrame) -> DataFrame:
    """What the query returns of ``contamination``."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )
