"""Prefix tries of conversations by padded matrices of turn ids.

A conversation is a sequence of turns (role, text). Every distinct sequence of
first d turns is a node of depth d, from the textless root on.

1. *Turn ids.* A turn is known by 128 bits of its role and text, and by the
   number of words of its text; texts are not shuffled.
2. *Bands.* A sequence is cut after every 32 turns. A row holds one band of one
   conversation, under a digest of all that goes before it; so no row and no
   matrix is wider than 32 turns, however long a conversation is.
3. *Shards.* Rows are range-partitioned by band, digest, turn ids and id. A
   shard is a padded matrix of codes of turn ids, brought into order by
   ``numpy.lexsort``. A mask tells where a column differs from the row above;
   accumulated by OR along the columns, it marks the starts of the nodes of
   each depth, and ``reduceat`` aggregates each depth between its starts.
   Equal conversations are told apart by their ids and spread over shards.
4. *Boundaries.* A row's measures need no more than the number of leading turns
   that it shares with the rows beside it, so that sums over the rows of a node
   may be taken in parts. Nodes on the path of a shard's first or last row, and
   those where one band meets the next, are given as parts and summed by key.

What a row adds: a child to the node after which it goes on alone; a leaf if
nothing continues it; and the words of the turns that it shares with the row
above, for each of these occurs once more without a new node.

Turns are ordered by turn (null first), ties by the digest of role and text.
Null roles and texts are empty; rows without a conversation id are left out.
Repeated rows are turns of their own. A conversation without turns is a member
of the root. An empty table has no nodes, not even a root. A text of any length
counts as one turn, a conversation of any length as many bands. Other columns
play no part, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paylens.llm.common import map_rows, prepare
from paylens.llm.running import running

#: Turns of a band; rows (bands of conversations) of a shard, on the average.
BAND, SHARD_ROWS = 32, 50_000
#: Ids of one piece of the list of a node's ends.
PIECE = 4096
EMPTY = hashlib.sha256(b"").hexdigest()
WORDS = r"[^\x20\x09-\x0D]+"


def turns(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, pos, token, words) of every turn: its place from 0 on, its 128 bits, and the words of its text."""
    who, said = F.coalesce(F.col(role).cast("string"), F.lit("")), F.coalesce(F.col(text).cast("string"), F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.length(who).cast("string"), F.lit(":"), who, said).cast("binary")))
    known = conversations.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv_id"),
        F.col(turn).cast("long").alias("turn"),
        digest.alias("token"),
        F.regexp_count(said, F.lit(WORDS)).cast("long").alias("words"),
        F.lit(1).cast("long").alias("pos"),
    )
    placed = running(known, "conv_id", [F.col("turn").asc_nulls_first(), F.col("token")], {"pos": "sum"})
    return placed.select("conv_id", F.col("pos_before").alias("pos"), "token", "words")


def branched(placed: DataFrame, base: Column, shared: Column, most: int) -> DataFrame:
    """Every conversation begins with the first turns of another one, and goes on with its own after as many.

    ``base`` and ``shared`` tell of ``conv_id`` which one and how many turns (0
    to ``most``); all turns if it has fewer, none if it is absent. A conversation
    that is left without turns has one row, of null turns.
    """
    turn = F.struct("pos", "token", "words")
    heads = (
        placed.where((F.col("pos") < most) & (F.col("conv_id") == base))
        .groupBy(F.col("conv_id").alias("base"))
        .agg(F.array_sort(F.collect_list(turn)).alias("head"))
    )
    convs = (
        placed.where("pos = 0")
        .select("conv_id", base.alias("base"), shared.cast("int").alias("shared"))
        .join(heads, "base", "left")
        .select("conv_id", "shared", F.filter("head", lambda t: t["pos"] < F.col("shared")).alias("head"))
        .withColumn("taken", F.coalesce(F.size("head"), F.lit(0)))
    )
    own = placed.join(convs.select("conv_id", "shared", "taken"), "conv_id").where("pos >= shared")
    rest = own.select("conv_id", (F.col("pos") - F.col("shared") + F.col("taken")).alias("pos"), "token", "words")
    first = convs.select("conv_id", F.explode_outer("head").alias("t")).select("conv_id", "t.pos", "t.token", "t.words")
    return rest.unionByName(first)


def _bands(sequences: DataFrame) -> DataFrame:
    """(conv_id, band, tokens, words): up to 32 turns a row, in order."""
    turn = F.when(F.col("pos").isNotNull(), F.struct("pos", "token", "words"))
    return (
        sequences.withColumn("band", F.coalesce(F.floor(F.col("pos") / BAND), F.lit(0)).cast("long"))
        .groupBy("conv_id", "band")
        .agg(F.array_sort(F.collect_list(turn)).alias("t"))
        .select("conv_id", "band", F.col("t.token").alias("tokens"), F.col("t.words").alias("words"))
    )


def _digest(band: int, tokens: bytes) -> tuple[int, int]:
    """128 bits of a band's first turns, as two signed numbers."""
    found = hashlib.blake2b(tokens, digest_size=16, key=band.to_bytes(8, "big")).digest()
    return int.from_bytes(found[:8], "big", signed=True), int.from_bytes(found[8:], "big", signed=True)


def _flat(column: pa.Array) -> tuple[np.ndarray, bytes]:
    """Lengths of lists of 16-byte values, and all values."""
    lengths = np.diff(column.offsets.to_numpy())
    return lengths, b"".join(column.flatten().to_pylist())


def _long_bands(bands: DataFrame) -> DataFrame:
    """Rows of conversations that fill a band: with the digest of all earlier bands, and whether a band follows."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        for batch in batches:
            lengths, tokens = _flat(batch.column(2))
            ends = np.cumsum(lengths) * 16
            at = batch.column(1).to_pylist()
            found = [_digest(b, tokens[e - 16 * n : e]) for b, e, n in zip(at, ends.tolist(), lengths.tolist())]
            yield {
                "conv_id": batch.column(0), "band": batch.column(1), "tokens": batch.column(2), "words": batch.column(3),
                "p1": [f[0] for f in found], "p2": [f[1] for f in found],
            }

    filled = bands.where((F.col("band") > 0) | (F.size("tokens") == BAND))
    hashed = map_rows(filled, "conv_id long, band long, tokens array<binary>, words array<long>, p1 long, p2 long", rows)
    later = filled.where("band > 0").select("conv_id", (F.col("band") - 1).alias("band"), F.lit(True).alias("more"))
    known = running(hashed, "conv_id", [F.col("band")], {"p1": "xor", "p2": "xor"})
    return known.join(later, ["conv_id", "band"], "left").select(
        "conv_id", "band", "tokens", "words", F.col("p1_before").alias("p1"), F.col("p2_before").alias("p2"),
        F.coalesce("more", F.lit(False)).alias("more"),
    )


_SORT = ("band", "p1", "p2", "tokens", "more", "conv_id")


def _sharded(rows: DataFrame) -> tuple[DataFrame, dict[int, tuple[int, int]]]:
    """Rows in range shards, and by shard how many turns its first row shares with the row before it, and its last
    with the row after it (-1: not even the band or what goes before it).
    """
    spark = rows.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // SHARD_ROWS))
    dealt = rows.repartitionByRange(n, *_SORT).withColumn("shard", F.spark_partition_id()).checkpoint()
    ends = dealt.groupBy("shard").agg(F.min(F.struct(*_SORT)).alias("first"), F.max(F.struct(*_SORT)).alias("last")).checkpoint()
    # The numbers of the shards that have rows, and a few numbers for each, are all that the driver sees.
    used = sorted(r["shard"] for r in ends.select("shard").collect())
    pairs = spark.createDataFrame(list(zip(used[1:], used[:-1])), "shard int, previous int")
    joined = (
        ends.select("shard", "first").join(pairs, "shard")
        .join(ends.select(F.col("shard").alias("previous"), F.col("last").alias("above")), "previous")
    )
    same = F.zip_with("first.tokens", "above.tokens", lambda a, b: a.eqNullSafe(b))
    place = F.array_position(same, False)
    likeness = F.when(
        (F.col("first.band") == F.col("above.band")) & (F.col("first.p1") == F.col("above.p1")) & (F.col("first.p2") == F.col("above.p2")),
        F.when(place == 0, F.size("first.tokens")).otherwise(place - 1),
    ).otherwise(-1)
    shares = {r["shard"]: r["n"] for r in joined.select("shard", likeness.cast("int").alias("n")).collect()}
    after = dict(zip(used[:-1], used[1:]))
    return dealt, {s: (shares.get(s, -1), shares.get(after.get(s), -1)) for s in used}


class _Shard:
    """A shard in order: the matrix of its turns, and what each row shares with its neighbours."""

    def __init__(self, batches: list[pa.RecordBatch], edges: dict[int, tuple[int, int]]):
        table = pa.Table.from_batches(batches).combine_chunks()
        self.n = n = table.num_rows
        numbers = {c: table.column(c).to_numpy() for c in ("conv_id", "band", "p1", "p2", "more", "after_saved", "after_leaves")}
        lengths, tokens = _flat(table.column("tokens").combine_chunks())
        said = table.column("words").combine_chunks().flatten().to_numpy()
        lengths = lengths.astype(np.int64)
        width = int(lengths.max())
        row_of = np.repeat(np.arange(n), lengths)
        column_of = np.arange(len(row_of)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        halves = np.frombuffer(tokens, ">u8").reshape(-1, 2).astype(np.uint64)
        matrix = np.zeros((n, width), np.int32)
        if len(row_of):
            # Codes in the order of the turn ids; 0 is the padding, so that a beginning comes before what continues it.
            by_id = np.lexsort((halves[:, 1], halves[:, 0]))
            steps = (halves[by_id[1:]] != halves[by_id[:-1]]).any(1)
            codes = np.empty(len(by_id), np.int32)
            codes[by_id] = np.concatenate([[1], 1 + np.cumsum(steps)])
            matrix[row_of, column_of] = codes
        heard = np.zeros((n, width + 1), np.int64)
        heard[row_of, column_of + 1] = said
        order = np.lexsort((numbers["conv_id"], numbers["more"], *matrix.T[::-1], numbers["p2"], numbers["p1"], numbers["band"]))
        self.matrix, self.lengths = matrix[order], lengths[order]
        #: Words of a row's first turns: column d has those of d turns.
        self.words = np.cumsum(heard[order], 1)
        for name, values in numbers.items():
            setattr(self, name, values[order])
        starts = np.cumsum(lengths) - lengths
        self.tokens, self.token_at = tokens, starts[order]
        first, last = edges[table.column("shard")[0].as_py()]
        apart = (self.band[1:] != self.band[:-1]) | (self.p1[1:] != self.p1[:-1]) | (self.p2[1:] != self.p2[:-1])
        changed = np.logical_or.accumulate((self.matrix[1:] != self.matrix[:-1]) | apart[:, None], axis=1)
        shared = np.minimum((~changed).sum(1), self.lengths[1:])
        shared[apart] = -1
        #: Turns shared with the row above and the row below.
        self.above = np.concatenate([[first], shared])
        self.below = np.concatenate([shared, [last]])
        self.leaf = ~self.more & (self.below < self.lengths)
        self.saved = self.words[np.arange(n), np.maximum(self.above, 0)]

    def key(self, row: int, depth: int) -> bytes:
        """Key of the node of a row's first turns."""
        a, b = int(self.p1[row]), int(self.p2[row])
        if depth:
            at = int(self.token_at[row]) * 16
            c, d = _digest(int(self.band[row]), self.tokens[at : at + 16 * depth])
            a, b = a ^ c, b ^ d
        return a.to_bytes(8, "big", signed=True) + b.to_bytes(8, "big", signed=True)

    def nodes(self) -> Iterator[dict[str, list]]:
        """Node rows of each depth: whole ones, parts, and pieces of the lists of ends of parts."""
        above_starts, above_least, above_open, above_keys = None, None, None, {}
        for depth in range(self.matrix.shape[1] + 1):
            rows = np.flatnonzero(self.lengths >= depth)
            if not len(rows):
                break
            begins = self.above[rows] < depth
            begins[0] = True
            # A row that is too short for this depth ends a node too, but then the next one shares less with it.
            at = np.flatnonzero(begins)
            starts, counts = rows[at], np.diff(np.concatenate([at, [len(rows)]]))
            lasts = rows[at + counts - 1]
            total = lambda values: np.add.reduceat(values[rows], at)
            least = np.minimum.reduceat(self.conv_id[rows], at)
            children = total((self.above <= depth) & (self.lengths > depth))
            leaves = total(self.leaf + self.after_leaves)
            before = self.words[:, max(depth - 1, 0)]
            saved = total(np.maximum(self.saved - before, 0) + self.after_saved)
            ends = total((self.lengths == depth) & ~self.more)
            goes_on = total(self.more.astype(np.int64)) > 0
            part = ((starts == 0) & (self.above[0] >= depth)) | ((lasts == self.n - 1) & (self.below[-1] >= depth))
            if depth == 0:
                part[:] = True
            elif depth == BAND:
                part |= goes_on
            keys: dict[int, bytes] = {i: self.key(int(starts[i]), depth) for i in np.flatnonzero(part).tolist()}
            # The top of a later band is the bottom of the one before, which has all but its children.
            top = (self.band[starts] > 0) if depth == 0 else np.zeros(len(starts), bool)
            out: dict[str, list] = {c: [] for c in _NODE_COLUMNS}
            parents = np.searchsorted(above_starts, starts, "right") - 1 if depth else np.zeros(len(starts), np.int64)
            for i, start in enumerate(starts.tolist()):
                here = int(self.band[start]) * BAND + depth
                parent = int(parents[i])
                listed = int(ends[i])
                names = self.conv_id[start : start + listed].tolist() if listed and not top[i] else []
                pieces = part[i] and bool(names)
                row = {
                    "kind": int(part[i]), "depth": here, "key": keys.get(i), "conv_id": int(least[i]), "parent_conv_id": None,
                    "parent_key": None, "n_convs": int(counts[i]), "n_children": int(children[i]), "n_leaves": int(leaves[i]),
                    "saved_tokens": int(saved[i]), "ends": None, "shard": None, "piece": None,
                }
                if top[i]:
                    row |= {"conv_id": None, "n_convs": 0, "n_leaves": 0, "saved_tokens": 0}
                if depth and above_open[parent]:
                    row["parent_key"] = above_keys[parent]
                elif depth:
                    row["parent_conv_id"] = int(above_least[parent])
                if not pieces:
                    row["ends"] = hashlib.sha256(",".join(map(str, names)).encode()).hexdigest() if names else EMPTY
                for c in _NODE_COLUMNS:
                    out[c].append(row[c])
                for k in range(0, len(names) if pieces else 0, PIECE):
                    piece = dict.fromkeys(_NODE_COLUMNS) | {"kind": 2, "depth": here, "key": keys[i]}
                    piece |= {"shard": int(names[k]), "piece": ",".join(map(str, names[k : k + PIECE]))}
                    for c in _NODE_COLUMNS:
                        out[c].append(piece[c])
                if len(out["kind"]) >= 20_000:
                    yield out
                    out = {c: [] for c in _NODE_COLUMNS}
            yield out
            above_starts, above_least, above_open, above_keys = starts, least, part, keys


_NODE_COLUMNS = (
    "kind", "depth", "key", "conv_id", "parent_conv_id", "parent_key", "n_convs", "n_children", "n_leaves", "saved_tokens",
    "ends", "shard", "piece",
)
_NODE_SCHEMA = (
    "kind int, depth long, key binary, conv_id long, parent_conv_id long, parent_key binary, n_convs long, n_children long,"
    " n_leaves long, saved_tokens long, ends string, shard long, piece string"
)


def _own_parts(rows: DataFrame) -> DataFrame:
    """(conv_id, band, saved, leaf) of rows of later bands: the words shared with the row above, whether a leaf."""
    dealt, edges = _sharded(rows.withColumn("after_saved", F.lit(0).cast("long")).withColumn("after_leaves", F.lit(0).cast("long")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        held = [b for b in batches if b.num_rows]
        if held:
            shard = _Shard(held, edges)
            yield {"conv_id": pa.array(shard.conv_id), "band": pa.array(shard.band), "saved": pa.array(shard.saved), "leaf": pa.array(shard.leaf.astype(np.int64))}

    return map_rows(dealt, "conv_id long, band long, saved long, leaf long", run)


def _ends(pieces: DataFrame) -> DataFrame:
    """(depth, key, digest) of the joined pieces of each list, hashed as they come: a digest takes its text in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        now, digest = None, None
        for batch in batches:
            out = {"depth": [], "key": [], "digest": []}
            for depth, key, piece in zip(*(batch.column(c).to_pylist() for c in ("depth", "key", "piece"))):
                if (depth, key) == now:
                    digest.update(b",")
                else:
                    if now is not None:
                        out["depth"].append(now[0])
                        out["key"].append(now[1])
                        out["digest"].append(digest.hexdigest())
                    now, digest = (depth, key), hashlib.sha256()
                digest.update(piece.encode())
            yield out
        if now is not None:
            yield {"depth": [now[0]], "key": [now[1]], "digest": [digest.hexdigest()]}

    dealt = pieces.repartition("depth", "key").sortWithinPartitions("depth", "key", "shard")
    return map_rows(dealt.select("depth", "key", "piece"), "depth long, key binary, digest string", run)


def prefix_trie(sequences: DataFrame) -> DataFrame:
    """One row a node of the trie of sequences (conv_id, pos, token, words).

    conv_id is the smallest member (a conversation that starts with the node's
    turns), parent_conv_id that of the parent (null for the root). n_convs counts
    members, n_children children, n_leaves the childless nodes of the subtree,
    and saved_tokens is the sum over the subtree of (members - 1) times the words
    of a node's last turn. ends_sha256 is of the ids of the members that end
    here, ascending, joined by commas.
    """
    prepare(sequences.sparkSession)
    bands = _bands(sequences).checkpoint()
    no = F.lit(0).cast("long")
    short = bands.where((F.col("band") == 0) & (F.size("tokens") < BAND)).select(
        "conv_id", "band", "tokens", "words", no.alias("p1"), no.alias("p2"), F.lit(False).alias("more"), no.alias("after_saved"), no.alias("after_leaves")
    )
    filled = _long_bands(bands).checkpoint()
    later = _own_parts(filled.where("band > 0"))
    # What the later bands of a conversation add belongs to all nodes of its earlier ones.
    parts = later.unionByName(filled.where("band = 0").select("conv_id", "band", no.alias("saved"), no.alias("leaf")))
    sums = running(parts, "conv_id", [F.col("band").desc()], {"saved": "sum", "leaf": "sum"})
    after = sums.select("conv_id", "band", F.col("saved_before").alias("after_saved"), F.col("leaf_before").alias("after_leaves"))
    rows = short.unionByName(filled.join(after, ["conv_id", "band"]).select(*short.columns))
    dealt, edges = _sharded(rows.checkpoint())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        held = [b for b in batches if b.num_rows]
        if held:
            yield from _Shard(held, edges).nodes()

    found = map_rows(dealt, _NODE_SCHEMA, run).checkpoint()
    kept = ["depth", "conv_id", "parent_conv_id", "parent_key", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"]
    parts = (
        found.where("kind = 1")
        .groupBy("depth", "key")
        .agg(
            F.min("conv_id").alias("conv_id"),
            F.min("parent_conv_id").alias("parent_conv_id"),
            F.max("parent_key").alias("parent_key"),
            *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")),
        )
        .join(_ends(found.where("kind = 2")), ["depth", "key"], "left")
        .withColumn("ends", F.coalesce("digest", F.lit(EMPTY)))
        .checkpoint()
    )
    nodes = found.where("kind = 0").select(*kept).unionByName(parts.select(*kept))
    above = parts.select((F.col("depth") + 1).alias("depth"), F.col("key").alias("parent_key"), F.col("conv_id").alias("above"))
    looked_up = nodes.where("parent_key is not null").join(above, ["depth", "parent_key"]).withColumn("parent_conv_id", F.col("above"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.col("ends").alias("ends_sha256")]
    return nodes.where("parent_key is null").select(*columns).unionByName(looked_up.select(*columns))
