"""MinHash near-duplicates by an inverted join over signature coordinates.

1. *Signatures.* A document is its set of word shingles. Equal sets become one
   node, whose key is a 128-bit hash of the set. A signature has 48 least
   values under as many hash functions; two sets agree in each with a
   probability equal to their Jaccard similarity.
2. *Postings.* A node is posted under its coordinate-value pairs. Of pairs with
   at least T agreements, each must share one of its 48 - T + 1 rarest pairs,
   so only these are posted (prefix) and the frequent ones are skipped.
3. *Collisions.* Postings of one pair meet in a task, in blocks if there are
   many. There the agreements of two signatures are counted, and nodes with T
   or more are joined to groups; a group's tree is returned, not all its pairs.
   T lies five standard deviations below what a similarity of 0.8 gives: a link
   is missed with a probability of about 3e-8.
4. *Confirmation.* The full sets of each group meet in a task, again in blocks,
   and are linked by the sizes of their intersections. Here too, nodes that are
   already linked are not compared again, and a tree is returned.
5. *Components* of the confirmed links.

Words are runs between ASCII white space, A-Z in lower case. A document with
fewer words than a shingle has its whole sequence as its only one. Documents
without words (or null) have an empty set and are linked with nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from paylens.llm.common import Recent, at_task_end, by_place, map_rows, mixed, prepare, sliced, spaced_words, streams
from paylens.llm.components import components

COORDINATES, AGREEMENTS = 48, 22
#: Nodes of one posting list, and shingles of one group, that a block holds.
BLOCK_NODES, BLOCK_SHINGLES = 4096, 2_000_000
#: Bits of the filter that keeps sets of single documents out of the confirmation. It
#: only saves work: what it lets through is joined with the exact keys.
FILTER_BITS = 20
KEPT_WORDS = 150_000


_HASHES = Recent(xxhash.xxh64_intdigest, KEPT_WORDS)
at_task_end(_HASHES.forget)


def shingles(text: str, width: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles."""
    words = spaced_words(text)
    if not words:
        return np.empty(0, np.uint64)
    each = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    with np.errstate(over="ignore"):
        n = max(1, len(words) - width + 1)
        total = np.zeros(n, np.uint64)
        for i in range(min(width, len(words))):
            total = mixed(total + each[i : i + n])
    return np.unique(total)


def set_key(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


_A, _B = streams(COORDINATES, 11), streams(COORDINATES, 12)


def signature(hashes: np.ndarray) -> np.ndarray:
    """The least value of each coordinate, 32 bits."""
    least = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(hashes), 4096):
            np.minimum(least, (hashes[i : i + 4096, None] * _A + _B).min(0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def signatures(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """One row a document: n_shingles, the key of its set and the signature; no key if empty."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        for batch in sliced(batches):
            sizes, keys, found = [], [], []
            for text in batch.column(1).to_pylist():
                hashes = shingles(text or "", width)
                sizes.append(len(hashes))
                keys.append(set_key(hashes) if len(hashes) else None)
                found.append(signature(hashes).tobytes() if len(hashes) else None)
            yield {"doc_id": batch.column(0), "n_shingles": sizes, "node": keys, "signature": found}

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_rows(chosen, "doc_id long, n_shingles long, node binary, signature binary", rows)


def _short(keys: list[bytes]) -> np.ndarray:
    """The first 64 bits of keys. Two keys of one short are only compared together more often."""
    return np.frombuffer(b"".join(k[:8] for k in keys), np.int64)


def _short_of(column: str) -> Column:
    """The same of a column: 64 bits, the first byte lowest."""
    digits = F.hex(column)
    return F.conv(F.concat(*(F.substring(digits, k, 2) for k in range(15, 0, -2))), 16, -10).cast("long")


def _postings(nodes: DataFrame) -> DataFrame:
    """(token, n, node, signature): the rarest coordinate-value pairs of each node, of two nodes at least.

    From here to the groups, nodes go by short keys, and signatures by the lowest
    bytes of their values (two differing values share one in 256 times, so counts
    of agreements are a little too high, never too low): this is most of what is shuffled.
    """

    def parts(batches: Iterator[pa.RecordBatch], spread: bool) -> Iterator[dict[str, list]]:
        lanes = np.arange(COORDINATES, dtype=np.int64) << np.int64(32)
        for batch in batches:
            shorts = _short(batch.column(0).to_pylist())
            values = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, COORDINATES)
            if spread:
                tokens = (values.astype(np.int64) + lanes).ravel()
                yield {"token": pa.array(tokens), "node": pa.array(np.repeat(shorts, COORDINATES))}
            else:
                yield {"node": pa.array(shorts), "signature": [v.tobytes() for v in values.astype(np.uint8)]}

    chosen = nodes.select("node", "signature")
    tokens = map_rows(chosen, "token long, node long", lambda b: parts(b, True))
    compact = map_rows(chosen, "node long, signature binary", lambda b: parts(b, False))
    frequent = tokens.groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
    shared = tokens.join(frequent, "token").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("tokens"))
    # Pairs of one node only come first in the order; they use up the prefix.
    prefix = (
        shared.where(F.size("tokens") >= AGREEMENTS)
        .select("node", F.explode(F.slice("tokens", F.lit(1), F.size("tokens") - AGREEMENTS + 1)).alias("t"))
        .select("t.token", "node")
        .checkpoint()
    )
    sizes = prefix.groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
    return prefix.join(sizes, "token").join(compact, "node")


def _in_blocks(rows: DataFrame, key: str, blocks: str) -> DataFrame:
    """Rows with (i, j): those of a large key, dealt over blocks, meet block by block."""
    own = F.pmod(F.xxhash64("node"), F.col(blocks)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col(blocks).cast("int") - 1))
    dealt = rows.withColumn("own", own).withColumn("other", other)
    return dealt.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("own", "other")


def _groups(batches: Iterator[pa.RecordBatch], payload: str) -> Iterator[tuple[list, list[bytes]]]:
    """(nodes, payloads) of each run of equal (key, i, j) in sorted rows."""
    last, nodes, values = None, [], []
    for batch in batches:
        for key, i, j, node, value in zip(*(batch.column(c).to_pylist() for c in ("key", "i", "j", "node", payload))):
            if (key, i, j) != last:
                if len(nodes) > 1:
                    yield nodes, values
                last, nodes, values = (key, i, j), [], []
            nodes.append(node)
            values.append(value)
    if len(nodes) > 1:
        yield nodes, values


def _trees(nodes: list, linked) -> list[tuple]:
    """Edges to the least node of each group; ``linked(x, rest)`` tells which of the rest x is linked with."""
    order = sorted(range(len(nodes)), key=nodes.__getitem__)
    rest = np.array(order)
    edges = []
    while len(rest) > 1:
        root, rest = rest[0], rest[1:]
        frontier = [root]
        while frontier and len(rest):
            x = frontier.pop()
            near = linked(x, rest)
            if near.any():
                frontier.extend(rest[near].tolist())
                edges.extend((nodes[k], nodes[root]) for k in rest[near])
                rest = rest[~near]
    return edges


def agreeing(signatures: list[bytes]):
    table = np.array([np.frombuffer(s, np.uint8) for s in signatures])

    def linked(x: int, rest: np.ndarray) -> np.ndarray:
        return (table[rest] == table[x]).sum(1) >= AGREEMENTS

    return linked


def overlapping(sets: list[bytes], percent: int):
    """Links of sets with 100 * intersection >= percent * union."""
    arrays = [np.frombuffer(s, np.uint64) for s in sets]
    sizes = np.array([len(a) for a in arrays])
    _, codes = np.unique(np.concatenate(arrays), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    marks = np.zeros(codes.max() + 1, np.int32)
    state = {"rest": None}

    def linked(x: int, rest: np.ndarray) -> np.ndarray:
        # The codes of the rest lie together; they are gathered anew once the rest has halved.
        kept = state["rest"]
        if kept is None or len(rest) * 2 < len(kept) or not state["holds"][rest].all():
            state["rest"], state["holds"] = rest, np.zeros(len(sizes), bool)
            state["holds"][rest] = True
            state["place"] = np.zeros(len(sizes), np.int64)
            state["place"][rest] = np.arange(len(rest))
            state["flat"] = np.concatenate([codes[starts[k] : starts[k + 1]] for k in rest])
            state["begin"] = np.concatenate([[0], np.cumsum(sizes[rest])[:-1]])
        own = codes[starts[x] : starts[x + 1]]
        marks[own] = 1
        both = np.add.reduceat(marks[state["flat"]], state["begin"])[state["place"][rest]]
        marks[own] = 0
        return 100 * both >= percent * (sizes[x] + sizes[rest] - both)

    return linked


def _tree_rows(rows: DataFrame, payload: str, links, kind: str) -> DataFrame:
    """Edges of the groups of (key, i, j), each found in one task from its sorted rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        out: list[tuple] = []
        for nodes, values in _groups(batches, payload):
            out.extend(_trees(nodes, links(values)))
            if len(out) > 20_000:
                yield {"a": [e[0] for e in out], "b": [e[1] for e in out]}
                out = []
        yield {"a": [e[0] for e in out], "b": [e[1] for e in out]}

    dealt = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return map_rows(dealt.select("key", "i", "j", "node", payload), f"a {kind}, b {kind}", run)


def _filter_bits(keys: DataFrame) -> bytes:
    """A filter of fixed size: which leading bits occur among the keys."""
    place = F.col("node").bitwiseAND((1 << FILTER_BITS) - 1)
    words = keys.select(place.alias("p")).groupBy((F.col("p") / 32).cast("int").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(p % 32 as int))")).alias("bits")
    )
    table = np.zeros(1 << (FILTER_BITS - 5), np.uint32)
    for row in words.collect():  # 2 ** (FILTER_BITS - 5) rows at most
        table[row["word"]] = row["bits"]
    return table.tobytes()


def _sets(docs: DataFrame, text_col: str, width: int, wanted: DataFrame) -> DataFrame:
    """(node, short, shingles) of the nodes whose short keys are wanted, and of some others."""
    shared = docs.sparkSession.sparkContext.broadcast(_filter_bits(wanted))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        table = np.frombuffer(shared.value, np.uint32)
        seen: set[bytes] = set()
        for batch in sliced(batches):
            keys, sets = [], []
            for text in batch.column(0).to_pylist():
                hashes = shingles(text or "", width)
                if not len(hashes):
                    continue
                key = set_key(hashes)
                p = int.from_bytes(key[:8], "little") & ((1 << FILTER_BITS) - 1)
                if table[p // 32] >> np.uint32(p % 32) & 1 and key not in seen:
                    if len(seen) < 100_000:
                        seen.add(key)
                    keys.append(key)
                    sets.append(hashes.tobytes())
            yield {"node": keys, "short": _short(keys).tolist(), "shingles": sets}

    found = map_rows(docs.select(F.col(text_col).alias("text")), "node binary, short long, shingles binary", rows)
    # Copies have met in their task, which sends one of each; the others meet where they are joined by short key.
    return found.repartition("short").groupBy("node", "short").agg(F.first("shingles").alias("shingles"))


def links(docs: DataFrame, nodes: DataFrame, text_col: str, width: int, percent: int) -> DataFrame:
    """Confirmed links (a, b) between keys of sets: a tree of each component at least."""
    met = _postings(nodes).withColumn("blocks", F.ceil(F.col("n") / BLOCK_NODES))
    met = _in_blocks(met.withColumnRenamed("token", "key"), "key", "blocks")
    groups = components(_tree_rows(met, "signature", agreeing, "long").distinct(), "a", "b").checkpoint()
    # How large the sets of a group are together is known before they are made, so they are shuffled twice only.
    sized = nodes.select(_short_of("node").alias("node"), "n_shingles").join(groups, "node")
    sizes = sized.groupBy("root").agg(F.sum("n_shingles").alias("n"))
    known = groups.join(sizes, "root").select(F.col("node").alias("short"), F.col("root").alias("key"), "n")
    met = _sets(docs, text_col, width, groups).join(known, "short").withColumn("blocks", F.ceil(F.col("n") / BLOCK_SHINGLES))
    met = _in_blocks(met, "key", "blocks")
    return _tree_rows(met, "shingles", lambda values: overlapping(values, percent), "binary").distinct()


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80
) -> DataFrame:
    """One row a document: n_shingles, component_id and whether it is the one kept of its component.

    component_id is the least id reachable over links of documents whose sets
    have 100 * intersection >= percent * union. Rows that repeat an id with
    equal sets are all kept or not. A component without any id has none, and
    all its rows are kept. A column ``node`` holds the key of the set.
    """
    prepare(docs.sparkSession)
    found = signatures(docs, id_col, text_col, width).checkpoint()
    worded = found.where("node is not null")
    nodes = worded.groupBy("node").agg(F.first("signature").alias("signature"), F.first("n_shingles").alias("n_shingles"))
    roots = components(links(docs, nodes, text_col, width, percent), "a", "b")
    # Nodes without a link are their own roots.
    placed = worded.select("doc_id", "n_shingles", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = placed.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    labelled = placed.join(least, "root").select("doc_id", "n_shingles", "component_id", "node")
    empty = found.where("node is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "node")
    return labelled.unionByName(empty).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicated(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80
) -> DataFrame:
    """The documents without near-duplicates: of each component the one of the least id stays.

    All columns stay. Of rows that repeat an id with equal sets, one stays (the
    least by text); documents without words all stay. Copies meet by key and id
    together, so that a large group of copies spreads over tasks. Columns may
    have any names, with dots or those of columns that are made here.
    """
    text, own = (f"c{docs.columns.index(c)}" for c in (text_col, id_col))
    rows = by_place(docs)
    near = near_duplicates(rows, own, text, width, percent)
    keep = near.where("kept and node is not null").select("node", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("id"))
    keyed = _with_node(rows, text, width).withColumn("id", F.coalesce(F.col(own).cast("string"), F.lit("null")))
    order = Window.partitionBy("node", "id").orderBy(text)
    worded = (
        keyed.join(keep.distinct(), ["node", "id"], "left_semi")
        .withColumn("row", F.row_number().over(order))
        .where("row = 1")
        .select(*rows.columns)
    )
    empty = rows.where(F.col(text).isNull() | ~F.col(text).rlike(r"[^\x20\x09-\x0D]"))
    return worded.unionByName(empty).toDF(*docs.columns)


def _with_node(rows: DataFrame, text: str, width: int) -> DataFrame:
    schema = StructType([*rows.schema.fields, StructField("node", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            hashes = (shingles(t or "", width) for t in batch.column(batch.schema.get_field_index(text)).to_pylist())
            keys = pa.array([set_key(h) if len(h) else None for h in hashes], pa.binary())
            fields = [*batch.schema, pa.field("node", pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns, keys], schema=pa.schema(fields))

    return rows.mapInArrow(run, schema)
