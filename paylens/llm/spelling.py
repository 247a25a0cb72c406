"""Spelling variants: words one edit apart, found in a trie of letter counts.

1. *Words.* Runs of letters are counted per document and task before they are
   shuffled.
2. *Trie.* A word is placed by how often it has each letter, one level for each
   letter a-z and one for all others, frequent letters first. An edit changes
   these counts by a surplus of one letter, a deficit of one letter, or one of
   each. So the search for the neighbours of a word goes down the trie depth
   first, and spends a budget of one surplus and one deficit on the way: at each
   level it follows the own count, or one more while the surplus is left, or one
   less while the deficit is left. Of two words that differ in their counts, one
   has the surplus at the first level where they do. Only the other one searches
   for it, so each pair is met once, and counts for both: a deficit is spent
   after the surplus.
3. *Leaves.* The words below a leaf have the same letters. They are verified:
   compared one by one, or, where they are many, looked up by the words that the
   edit can make, whose number does not depend on the leaf.
4. *Shards.* The top of the trie is cut at nodes of a bounded number of words,
   which are counted level by level. The cut has a node for some thousands of
   words and goes to all tasks. There each word takes the same search through
   it, and is sent to its own node, which keeps it, and to the other nodes that
   it reaches, which it only asks. A node of equal letters that is still too
   large is dealt over parts by a hash; whoever reaches it asks all parts. What
   a word finds in a shard comes back as one row: a count and the best word.
5. *Roots.* The table of words and their forms is joined with itself until no
   form leads on; each round doubles the steps.

Nulls and texts without letters have no words, a null id counts as empty text
in the hash, repeated rows count as often as they occur, and a run of any length
is one run. Ties of counts go to the first word by code points. An empty table
has no words. Other columns play no part, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paylens.llm.common import map_rows, prepare

#: Code points of a word, at least; distinct words that a task gathers before it gives counts.
LEAST, GATHERED = 7, 200_000
#: Words of a shard, at most but for a node of equal letters' part; shards for each shuffle partition, if words are few.
SHARD_WORDS, FEWEST, SHARDS = 50_000, 500, 2
#: Distinct vectors that a node of the trie lists instead of splitting them by the next letter.
BUCKET = 6
LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: The letters of the last level, a fixed range of the words: U+00C0 to U+00FF.
OTHERS = "".join(map(chr, range(0xC0, 0x100)))
LEVELS = len(LETTERS) + 1
#: What a search has spent.
_NONE, _SURPLUS, _BOTH = range(3)
RUN = re.compile(f"[a-z{OTHERS[0]}-{OTHERS[-1]}]{{{LEAST},}}")


def edited_run(doc_id: int | None, run: str, every: int) -> str:
    """The run without one code point if ``every`` divides the CRC-32 of id and run; else as it is."""
    h = zlib.crc32(run.encode(), zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode()))
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = 31) -> DataFrame:
    """(word, n) of the words that occur twice or more; one in ``every`` runs of a document has lost a code point."""
    prepare(docs.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        counts: dict[str, int] = {}
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not text:
                    continue
                # bytes.lower() changes A-Z only. Shorter runs make no word of enough code points.
                for run, n in Counter(RUN.findall(text.encode().lower().decode())).items():
                    word = edited_run(doc_id, run, every)
                    if len(word) >= LEAST:
                        counts[word] = counts.get(word, 0) + n
                if len(counts) > GATHERED:
                    yield {"word": list(counts), "n": list(counts.values())}
                    counts = {}
        yield {"word": list(counts), "n": list(counts.values())}

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_rows(chosen, "word string, n long", rows).groupBy("word").agg(F.sum("n").alias("n")).where("n >= 2")


def one_edit(a: str, b: str) -> bool:
    """Whether one inserted, deleted or replaced code point makes b of a."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    at = 0
    for x, y in zip(a, b):
        if x != y:
            break
        at += 1
    if len(a) == len(b):
        return at < len(a) and a[at + 1 :] == b[at + 1 :]
    return a[at:] == b[at + 1 :]


class Trie:
    """Words by their letter counts in the order of ``letters`` (a-z by frequency), the others last."""

    WIDE = 32  # bits of a count in a packed vector

    def __init__(self, letters: str, members: Iterable[str]):
        self.letters = letters
        unit = [1 << (self.WIDE * i) for i in range(LEVELS)]
        #: What an edit does to a packed vector: the letters in surplus and in deficit, if any.
        self.edits: dict[int, tuple[int | None, int | None]] = {0: (None, None)}
        for i in range(LEVELS):
            self.edits[unit[i]] = (i, None)
            self.edits |= {unit[i] - unit[j]: (i, j) for j in range(i + 1, LEVELS)}
        leaves: dict[tuple[int, ...], set[str]] = {}
        for word in members:
            leaves.setdefault(vector(word, letters), set()).add(word)
        self.root = self._node([(v, self.packed(v), leaf) for v, leaf in leaves.items()], 0)

    def packed(self, v: tuple[int, ...]) -> int:
        return sum(c << (self.WIDE * i) for i, c in enumerate(v) if c)

    def _node(self, leaves: list[tuple], level: int):
        """A list of few leaves, or nodes by the count of this level's letter."""
        if len(leaves) <= BUCKET or level == LEVELS:
            return [(p, leaf) for _, p, leaf in leaves]
        split: dict[int, list[tuple]] = {}
        for entry in leaves:
            split.setdefault(entry[0][level], []).append(entry)
        return {count: self._node(below, level + 1) for count, below in split.items()}

    def near(self, word: str) -> Iterator[tuple[str, bool]]:
        """The words one edit from a word that have the surplus at the first level of different counts, or the same counts.

        With each, whether it does not meet this word in its own search.
        """
        v = vector(word, self.letters)
        own, edits = self.packed(v), self.edits
        todo = [(self.root, 0, _NONE)]
        while todo:
            node, level, spent = todo.pop()
            if type(node) is list:
                for packed, leaf in node:
                    edit = edits.get(packed - own)
                    if edit is not None:
                        once = packed != own
                        yield from ((w, once) for w in self._verified(word, v, leaf, *edit))
                continue
            count = v[level]
            below = node.get(count)
            if below is not None:
                todo.append((below, level + 1, spent))
            if spent == _NONE and (below := node.get(count + 1)) is not None:
                todo.append((below, level + 1, _SURPLUS))
            elif spent == _SURPLUS and (below := node.get(count - 1)) is not None:
                todo.append((below, level + 1, _BOTH))

    def _group(self, level: int) -> str:
        return self.letters[level] if level < LEVELS - 1 else OTHERS

    def _verified(self, word: str, v: tuple[int, ...], leaf: set[str], surplus: int | None, deficit: int | None) -> Iterator[str]:
        if surplus is None and deficit is None:
            # The same letters: one of the others may stand for another one.
            surplus = deficit = LEVELS - 1
            if not v[deficit]:
                return
        places = len(word) + 1 if deficit is None else v[deficit]
        if len(leaf) <= places * (1 if surplus is None else len(self._group(surplus))):
            yield from (w for w in leaf if w != word and one_edit(word, w))
            return
        made: set[str] = set()
        lost = None if deficit is None else self._group(deficit)
        gained = [""] if surplus is None else self._group(surplus)
        for at in range(places if deficit is None else len(word)):
            if lost is None or word[at] in lost:
                rest = word[at:] if lost is None else word[at + 1 :]
                made.update(word[:at] + c + rest for c in gained)
        made.discard(word)
        yield from made & leaf


def vector(word: str, letters: str) -> tuple[int, ...]:
    counts = [word.count(c) for c in letters]
    return (*counts, len(word) - sum(counts))


def _by_frequency(vocabulary: DataFrame) -> str:
    """a-z by how often words have them, which decides how soon searches end, and nothing else."""
    counts = [F.sum(F.length("word") - F.length(F.translate("word", c, ""))).alias(c) for c in LETTERS]
    found = vocabulary.agg(*counts).first()
    return "".join(sorted(LETTERS, key=lambda c: (-(found[c] or 0), c)))


def _cut(vocabulary: DataFrame, letters: str, most: int) -> dict:
    """The top of the trie: nodes by counts, down to (first shard, shards) where a node has few enough words.

    Each level is counted in Spark; what comes to the driver is one row for each
    child of a node of more than ``most`` words.
    """
    spark = vocabulary.sparkSession
    levels = [F.length("word") - F.length(F.translate("word", c, "")) for c in letters]
    levels.append(F.length(F.translate("word", letters, "")))
    counted = vocabulary.select(*(c.alias(f"c{i}") for i, c in enumerate(levels)))
    top: dict = {}
    large: list[tuple[int, ...]] = [()]
    shards = 0
    for level in range(1, LEVELS + 1):
        names = [f"c{i}" for i in range(level)]
        rows = counted
        if level > 1:
            # A row for each node of more than `most` words.
            nodes = spark.createDataFrame(large, ", ".join(f"{c} int" for c in names[:-1]))
            rows = rows.join(F.broadcast(nodes), names[:-1], "left_semi")
        found = rows.groupBy(*names).agg(F.count("*").alias("n")).collect()
        large = []
        for row in sorted(tuple(r) for r in found):
            *path, n = row
            node = top
            for count in path[:-1]:
                node = node.setdefault(count, {})
            if n > most and level < LEVELS:
                large.append(tuple(path))
                continue
            parts = -(-n // most)
            node[path[-1]] = (shards, parts)
            shards += parts
        if not large:
            break
    return top


def reached(top: dict, v: tuple[int, ...]) -> Iterator[tuple[int, int, bool]]:
    """(first shard, shards, whether it is the own one) of the nodes of the cut within the budget of a vector."""
    todo = [(top, 0, _NONE)]
    while todo:
        node, level, spent = todo.pop()
        if type(node) is tuple:
            yield *node, spent == _NONE
            continue
        count = v[level]
        if count in node:
            todo.append((node[count], level + 1, spent))
        if spent == _NONE and count + 1 in node:
            todo.append((node[count + 1], level + 1, _SURPLUS))
        elif spent == _SURPLUS and count - 1 in node:
            todo.append((node[count - 1], level + 1, _BOTH))


def _sent(vocabulary: DataFrame, letters: str, top: dict) -> DataFrame:
    """(shard, asks, word, n): every word in its own shard (asks false), and in those that it asks."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        for batch in batches:
            out: dict[str, list] = {"shard": [], "asks": [], "word": [], "n": []}
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for first, parts, own in reached(top, vector(word, letters)):
                    kept = zlib.crc32(word.encode()) % parts if own else None
                    for part in range(parts):
                        out["shard"].append(first + part)
                        out["asks"].append(part != kept)
                        out["word"].append(word)
                        out["n"].append(n)
                if len(out["word"]) > 50_000:
                    yield out
                    out = {c: [] for c in out}
            yield out

    return map_rows(vocabulary.select("word", "n"), "shard int, asks boolean, word string, n long", rows)


def _found(sent: DataFrame, letters: str) -> DataFrame:
    """(word, n_near, best_n, best): what each word finds in each shard, and what finds it there."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        shard, kept, trie = None, {}, None
        #: Of a shard's own words: how many words are near, and the best of them as (-n, word).
        met: dict[str, tuple[int, tuple[int, str]]] = {}
        out: dict[str, list] = {"word": [], "n_near": [], "best_n": [], "best": []}

        def meets(word: str, key: tuple[int, str], times: int = 1) -> None:
            before = met.get(word)
            met[word] = (times, key) if before is None else (before[0] + times, min(key, before[1]))

        def tell(word: str, n: int, key: tuple[int, str]) -> None:
            for c, value in zip(out, (word, n, -key[0], key[1])):
                out[c].append(value)

        def ask(word: str, own_n: int) -> tuple[int, tuple[int, str]] | None:
            n, best = 0, None
            for near, once in trie.near(word):
                key = (-kept[near], near)
                n, best = n + 1, key if best is None else min(key, best)
                if once:
                    meets(near, (-own_n, word))
            return None if best is None else (n, best)

        def built() -> Trie:
            nonlocal trie
            trie = Trie(letters, kept)
            for word, n in kept.items():
                found = ask(word, n)
                if found is not None:
                    meets(word, found[1], found[0])
            return trie

        for batch in batches:
            for here, asks, word, n in zip(*(batch.column(c).to_pylist() for c in ("shard", "asks", "word", "n"))):
                if here != shard:
                    if kept and trie is None:
                        built()
                    for w, found in met.items():
                        tell(w, *found)
                    shard, kept, trie, met = here, {}, None, {}
                if not asks:
                    kept[word] = n
                elif kept:
                    if trie is None:
                        built()
                    found = ask(word, n)
                    if found is not None:
                        tell(word, *found)
            yield out
            out = {c: [] for c in out}
        if kept and trie is None:
            built()
        for w, found in met.items():
            tell(w, *found)
        yield out

    shards = sent.repartition("shard").sortWithinPartitions("shard", "asks")
    return map_rows(shards, "word string, n_near long, best_n long, best string", rows)


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): where the forms of words lead in the end. A form occurs more often than its word, so none comes back."""
    roots = forms.select("word", F.col("form").alias("root")).checkpoint()
    while True:
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        joined = roots.join(onward, "root", "left").checkpoint()
        if joined.where("onward is not null").isEmpty():
            return roots
        roots = joined.select("word", F.coalesce("onward", "root").alias("root"))


def variants(vocabulary: DataFrame, times: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each word of (word, n).

    n_near counts the words one edit apart. The form is the most frequent of
    them if it occurs at least ``times`` as often as the word; the root is where
    forms lead in the end, the word itself if it has none.
    """
    spark = prepare(vocabulary.sparkSession)
    vocabulary = vocabulary.checkpoint()
    letters = _by_frequency(vocabulary)
    wanted = SHARDS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    most = max(1, min(SHARD_WORDS, max(FEWEST, vocabulary.count() // wanted)))
    top = _cut(vocabulary, letters, most)
    found = _found(_sent(vocabulary, letters, top), letters)
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("best")))
    near = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b"))
    formed = F.coalesce(-F.col("b.less") >= times * F.col("n"), F.lit(False))
    rows = (
        vocabulary.join(near, "word", "left")
        .withColumn("form", F.when(formed, F.col("b.best")))
        .withColumn("form_n", F.when(formed, -F.col("b.less")))
        .select("word", "form", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
        .checkpoint()
    )
    roots = _roots(rows.where("form is not null"))
    return rows.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
