"""BPE encoding and decoding by a tokenization automaton.

The automaton reads tokens: it accepts a sequence if byte-pair encoding makes
just that sequence of its text. It begins with one state in which every byte's
token loops, and is refined by one gadget for each merge (u, v) -> uv in order:

- if the state after u has no arc v, the gadget changes nothing: uv is never made;
- the state after u is copied, and the copy, where u now leads, loses its arc v;
- wherever u has an arc (after that), so has uv; it leads to the old state after v.

So the state after uv has lost what the state after v had lost when uv was made,
and an arc uv is lost where the arc u was lost when uv was made. Gadgets are kept
in this form: for each token the chain of its right parts and of its left parts,
each with the merge up to which it counts, and for each merge the arc that it
takes away. An arc of the table follows from both chains; arcs are filled in
when first asked for, and lead from state to state.

Encoding runs over the bytes of a pre-split word once. Of the tokens that end at
a byte exactly one has an arc from the token before it, for each beginning of a
word has one encoding: what is read so far determines the next step, and no byte
is gone back to. Decoding joins the bytes on the arcs.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paylens.llm.common import Recent, at_task_end, map_rows, prepare, sliced

#: The pre-split of byte-level encoding, a fixed value of the vocabulary's format: contractions, runs of
#: letters, of numbers and of other signs, each with a blank before it, and white space.
PRE_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: The same for texts of code points under 256, whose classes are short enough to list.
_LETTER, _NUMBER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
_BLANK = "\t-\r \x85\xa0"
PRE_SPLIT_LATIN = re.compile(
    rf" ?[{_LETTER}]+|'(?:s|t|re|ve|m|ll|d)| ?[^{_BLANK}{_LETTER}{_NUMBER}]+| ?[{_NUMBER}]+"
    rf"|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+"
)


def pre_split(text: str) -> list[str]:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return PRE_SPLIT.findall(text)
    return PRE_SPLIT_LATIN.findall(text)


#: Distinct words whose ids a task keeps; longer words (in bytes) are not kept. Arcs of the table that it keeps.
KEPT, KEPT_BYTES, ARCS = 160_000, 64, 300_000
#: Words that a round trip keeps, whose task does little else: about 250 bytes each.
ROUND_TRIP_KEPT = 320_000
#: Stands for the token before a word.
START = -1


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable ones for themselves, then from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class State(dict):
    """The state after a token: for each next token the state that its arc leads to, None without an arc."""

    __slots__ = ("token", "size", "arc")

    def __init__(self, token: int, size: int, arc: Callable[[State, int], State | None]):
        self.token, self.size, self.arc = token, size, arc

    def __missing__(self, token: int) -> State | None:
        return self.arc(self, token)


class TokenAutomaton:
    def __init__(
        self, labels: dict[int, bytes], merges: list[tuple[int, int, int]], special: dict[str, int] | None = None, kept: int = KEPT
    ):
        """labels: the bytes of each token; merges: (u, v, uv) in order; special: strings that are one token each; kept: words whose ids are kept."""
        self.labels = labels
        self.special = dict(special or {})
        self.split_special = re.compile("|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True))) if special else None
        self.by_bytes = by_bytes = {label: token for token, label in labels.items() if len(label) == 1}
        #: The merge at which the state after a token lost an arc, for both as they stand in the merge.
        self.lost_at: dict[tuple[int, int], int] = {}
        end = len(merges)
        #: (part, the merge up to which its losses count), from the whole token on.
        self.right = {token: ((token, end),) for token in by_bytes.values()}
        self.left = dict(self.right)
        #: The part of the table that was asked for: the states by token, and how many arcs they tell of.
        self.known_arcs: dict[int, State] = {}
        self.arcs = 0
        for i, (u, v, uv) in enumerate(merges):
            if uv in self.right:
                raise ValueError("two merges make one token")
            if u not in self.right or v not in self.right or self._lost(u, v):
                continue
            self.right[uv] = ((uv, end), (v, i), *self.right[v][1:])
            self.left[uv] = ((uv, end), (u, i), *self.left[u][1:])
            self.lost_at[u, v] = i
            by_bytes[labels[uv]] = uv
        #: Reads bytes by a table, and tells at each byte which tokens end there.
        self.endings = ahocorasick.Automaton()
        for label, token in by_bytes.items():
            self.endings.add_word(label.decode("latin-1"), (token, len(label)))
        self.endings.make_automaton()
        self.known = _words(self, kept)

    @classmethod
    def from_file(cls, path: str, kept: int = KEPT) -> TokenAutomaton:
        """Of a byte-level BPE vocabulary in the JSON format of public tokenizers."""
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        letters = byte_letters()
        vocab = data["model"]["vocab"]
        merges = [tuple(m if isinstance(m, list) else m.split(" ", 1)) for m in data["model"]["merges"]]
        labels = {i: bytes(letters[c] for c in token) for token, i in vocab.items() if all(c in letters for c in token)}
        special = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        automaton = cls(labels, [(vocab[a], vocab[b], vocab[a + b]) for a, b in merges], special, kept)
        automaton.labels = labels | {i: s.encode() for s, i in special.items()}
        return automaton

    def _lost(self, before: int, token: int) -> bool:
        at = self.lost_at.get
        for right, until in self.right[before]:
            for left, made in self.left[token]:
                merge = at((right, left))
                # A part's arc that was lost at the very merge that made the token was lost to it too.
                if merge is not None and merge < until and merge <= made:
                    return True
        return False

    def state(self, token: int) -> State:
        """The state after a token, or before a word."""
        state = self.known_arcs.get(token)
        if state is None:
            size = 0 if token == START else len(self.labels[token])
            state = self.known_arcs[token] = State(token, size, self._arc)
        return state

    def _arc(self, before: State, token: int) -> State | None:
        """Fills in an arc of the table; a full table is begun anew."""
        if self.arcs >= ARCS:
            for state in self.known_arcs.values():
                state.clear()
            self.known_arcs.clear()
            self.arcs = 0
        self.arcs += 1
        lost = before.token != START and self._lost(before.token, token)
        after = before[token] = None if lost else self.state(token)
        return after

    def has_arc(self, before: int, token: int) -> bool:
        """Whether the state after one token has an arc for another; the table keeps the answer."""
        return self.state(before)[token] is not None

    def encode_word(self, word: bytes) -> list[int]:
        """The ids of a pre-split word: the only path of arcs that spells it.

        Every beginning of a word has one encoding, so just one token that ends
        at a place continues the encoding of what is before it. The places are
        read once each, from left to right, and the state at each is kept; the
        path is read off from the end.
        """
        whole = self.by_bytes.get(word)
        if whole is not None:
            return [whole]
        n = len(word)
        # The last one stays, and is what comes before the first place.
        states = [self.state(START)] * (n + 1)
        at = 0
        for end, (token, size) in self.endings.iter(word.decode("latin-1")):
            if end != at:
                if end < at:  # this place has its token
                    continue
                break
            state = states[end - size][token]
            if state is not None:
                states[end] = state
                at = end + 1
        if at < n:
            raise ValueError("a byte has no token")
        ids, end = [], n - 1
        while end >= 0:
            state = states[end]
            ids.append(state.token)
            end -= state.size
        ids.reverse()
        return ids

    def decode(self, ids: list[int]) -> str:
        """The text on the arcs; ids of no token are skipped, bytes that are no UTF-8 replaced."""
        labels = self.labels
        return b"".join([labels.get(i, b"") for i in ids]).decode("utf-8", "replace")

    def parts(self, text: str) -> Iterator[tuple[str, bool]]:
        """The text around special strings, and these."""
        at = 0
        if self.split_special is not None:
            for m in self.split_special.finditer(text):
                if m.start() > at:
                    yield text[at : m.start()], False
                yield m[0], True
                at = m.end()
        if at < len(text):
            yield text[at:], False

    def encode(self, text: str) -> list[int]:
        return [int(i) for i in self.printed(text)[0].split(",") if i]

    def printed(self, text: str) -> tuple[str, str]:
        """The ids of a text joined by commas, and the text that their arcs spell."""
        ids: list[str] = []
        spelled: list[str] = []
        for part, special in self.parts(text):
            if special:
                ids.append(str(self.special[part]))
                spelled.append(self.decode([self.special[part]]))
            else:
                found = [self.known[word] for word in pre_split(part)]
                ids += [printed for printed, _ in found]
                spelled += [text_of_ids for _, text_of_ids in found]
        return ",".join(ids), "".join(spelled)

    def digests(self, text: str) -> tuple[int, str, str]:
        """Number of tokens, SHA-256 of the ids printed with commas, SHA-256 of the decoded text."""
        ids, spelled = self.printed(text)
        n = ids.count(",") + 1 if ids else 0
        return n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(spelled.encode()).hexdigest()


def _words(automaton: TokenAutomaton, kept: int) -> Recent:
    """Printed ids of words, and the text that their arcs spell, kept up to a bound.

    Each word is encoded and decoded once; ids that do not spell their word raise.
    """

    def make(word: str) -> tuple[str, str]:
        raw, labels = word.encode(), automaton.labels
        ids = automaton.encode_word(raw)
        if b"".join([labels[i] for i in ids]) != raw:
            raise ValueError("the ids of a word do not spell it")
        # What is spelled equals the word, whose text stands for both.
        return ",".join(map(str, ids)), word

    return Recent(make, kept, keep=lambda word: len(word) <= KEPT_BYTES // 4 or len(word.encode()) <= KEPT_BYTES)


_AUTOMATA: dict[str, TokenAutomaton] = {}
at_task_end(_AUTOMATA.clear)


def worker_automaton(path: str, kept: int = KEPT) -> TokenAutomaton:
    """One automaton a task and vocabulary."""
    if path not in _AUTOMATA:
        _AUTOMATA[path] = TokenAutomaton.from_file(path, kept)
    return _AUTOMATA[path]


def encoded(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_tokens and its ids. Null is an empty text, of no ids.

    ``vocabulary`` is a file on every machine. Special strings in a text are one
    token each. Nothing is shuffled.
    """
    prepare(docs.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        automaton = worker_automaton(vocabulary)
        for batch in sliced(batches):
            ids = [automaton.encode(t or "") for t in batch.column(1).to_pylist()]
            yield {"doc_id": batch.column(0), "n_tokens": [len(i) for i in ids], "ids": ids}

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_rows(chosen, "doc_id long, n_tokens long, ids array<int>", rows)


def decoded(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row a document: doc_id and the text of its ids. Null ids are an empty text."""
    prepare(docs.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        automaton = worker_automaton(vocabulary)
        for batch in sliced(batches):
            yield {"doc_id": batch.column(0), "text": [automaton.decode(i or []) for i in batch.column(1).to_pylist()]}

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids"))
    return map_rows(chosen, "doc_id long, text string", rows)


def round_trip(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: n_tokens and digests of its ids and of their decoded text."""
    prepare(docs.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        automaton = worker_automaton(vocabulary, ROUND_TRIP_KEPT)
        for batch in sliced(batches):
            found = [automaton.digests(t or "") for t in batch.column(1).to_pylist()]
            yield {
                "doc_id": batch.column(0),
                "n_tokens": [f[0] for f in found],
                "ids_sha256": [f[1] for f in found],
                "decoded_sha256": [f[2] for f in found],
            }

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_rows(chosen, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", rows)
