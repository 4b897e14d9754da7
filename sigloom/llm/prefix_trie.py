"""Prefix trie of conversations: ternary search trees per range shard, joined along the shards' borders.

* Distinct turns (role, text) get ids in their sort order; a conversation is the array of its turns' ids.  Turns that make up a large share of
  all turns are few by definition, so their ids are broadcast; the others are joined by digest, where no key is hot.
* Conversations are sorted by range.  A task reads its range in blocks; each block's distinct sequences go into a ternary search
  tree, the middle one first, so that the tree is balanced.  An iterative walk gives the block's nodes in order with members, leaves and savings.
* A node of a block can also lie in another one only if it is on the path of the block's first or last sequence.  All others are complete and leave
  at once.  What is left of a block, and then of a task, is two paths; these meet in rounds of ``FAN_IN`` neighbours until the whole
  trie is closed.  No step holds more than a block, or ``FAN_IN`` pairs of paths.
* The ids of conversations that end in one node are hashed as they pass.  A sequence that reaches over a block's border hands its ids on as
  pieces of text, which one ordered pass per sequence hashes without holding them.

A conversation is one row (eight bytes per turn): its length is bounded by what a task can hold.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigloom.llm.common import Written, pick

#: A turn with more than one in so many of all turns counts as frequent: there are at most so many of those.
FREQUENT = 1000
#: Turns (and conversations) of one block, turns per task, tasks that meet in one round, characters of a piece of ids.
BLOCK, TASK, FAN_IN, PIECE = 100_000, 400_000, 16, 1 << 20
NO_ENDS = hashlib.sha256(b"").digest()
ROOT = 0


# ---------------------------------------------------------------------------------------------------------------- sequences
def turn_rows(table: DataFrame, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text") -> DataFrame:
    """``conv_id, turn, role, text``: a null role or text is empty, rows without a conversation are left out."""
    rows = pick(table, conv_id=conv_col, turn=turn_col, role=role_col, text=text_col).filter("conv_id is not null")
    return rows.select(F.col("conv_id").cast("long"), "turn", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")])


def _digest() -> Column:
    return F.unhex(F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text").cast("binary"), 256))


def dictionary(rows: DataFrame, written: Written) -> DataFrame:
    """``digest, turn_id, chars, n`` of every distinct (role, text); ids follow the order of role and text, and leave gaps."""
    distinct = rows.groupBy("role", "text").agg(F.count("*").alias("n"))
    ordered = distinct.repartitionByRange("role", "text").sortWithinPartitions("role", "text")
    return written.table(ordered.select(_digest().alias("digest"), (F.monotonically_increasing_id() + 1).alias("turn_id"), F.length("text").alias("chars"), "n"))


def encoded(rows: DataFrame, written: Written) -> DataFrame:
    """``conv_id, seq`` with ``seq`` an array of (turn_id, chars) in the order of turn (null first), role and text."""
    ids = dictionary(rows, written)
    total = ids.agg(F.sum("n")).first()[0] or 0
    keyed = rows.select("conv_id", "turn", _digest().alias("digest"))
    names = [F.col(c).alias(f"frequent_{c}") for c in ("digest", "turn_id", "chars")]
    frequent = ids.filter(F.col("n") > total // FREQUENT).select(*names)  # fewer than FREQUENT rows
    marked = keyed.join(F.broadcast(frequent), F.col("digest") == F.col("frequent_digest"), "left").drop("frequent_digest")
    common = marked.filter("frequent_turn_id is not null").select("conv_id", "turn", F.col("frequent_turn_id").alias("turn_id"), F.col("frequent_chars").alias("chars"))
    others = marked.filter("frequent_turn_id is null").select("conv_id", "turn", "digest")
    rare = others.join(ids.filter(F.col("n") <= total // FREQUENT).select("digest", "turn_id", "chars"), "digest").select("conv_id", "turn", "turn_id", "chars")
    listed = common.unionAll(rare).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "turn_id", "chars"))).alias("turns"))
    # array_sort puts a null field first within structs, as the order asks
    return listed.select("conv_id", F.transform("turns", lambda t: F.struct(t["turn_id"].alias("id"), t["chars"].alias("chars"))).alias("seq"))


def rebuilt(sequences: DataFrame, written: Written, group=100, heads=6) -> DataFrame:
    """Each conversation with the first ``h`` turns of its group's first one in place of its own, ``h = crc32(decimal id) % heads``.

    The group's first conversation of ``c`` is ``c - c % group`` (the remainder has the sign of ``c``); where it is missing, nothing stands in its place.
    """
    sequences = written.table(sequences)
    lead = sequences.filter(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("base"), F.slice("seq", 1, heads - 1).alias("head"))
    own = sequences.withColumns({"base": F.col("conv_id") - F.col("conv_id") % group, "h": (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")})
    head = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.slice("seq", 1, 0))
    rest = F.when(F.size("seq") > F.col("h"), F.slice("seq", F.col("h") + 1, F.size("seq"))).otherwise(F.slice("seq", 1, 0))
    return own.join(lead, "base", "left").select("conv_id", F.concat(head, rest).alias("seq"))


# ---------------------------------------------------------------------------------------------------------------- ternary search tree
class SearchTree:
    """Ternary search tree over arrays of turn ids; slot 0 means none."""

    def __init__(self):
        self.key, self.low, self.equal, self.high, self.ends = [0], [0], [0], [0], [-1]
        self.top = 0

    def _new(self, key):
        for column, value in ((self.key, key), (self.low, 0), (self.equal, 0), (self.high, 0), (self.ends, -1)):
            column.append(value)
        return len(self.key) - 1

    def insert(self, word: list[int], number: int):
        """Put in a word that is not empty; ``number`` marks its last node."""
        at, column, place = self.top, None, 0
        for i, key in enumerate(word):
            while at and self.key[at] != key:
                column, place = (self.low if key < self.key[at] else self.high), at
                at = column[at]
            if not at:
                at = self._new(key)
                if column is None:
                    self.top = at
                else:
                    column[place] = at
            if i + 1 < len(word):
                column, place, at = self.equal, at, self.equal[at]
        self.ends[at] = number

    def walk(self):
        """``depth, key, ends`` of every node, parents before children and siblings in order; a stack takes the place of recursion."""
        stack = [(self.top, 1, False)]
        while stack:
            at, depth, turned = stack.pop()
            if not at:
                continue
            if not turned:
                stack += [(self.high[at], depth, False), (at, depth, True), (self.low[at], depth, False)]
            else:
                yield depth, self.key[at], self.ends[at]
                stack.append((self.equal[at], depth + 1, False))


def median_order(n: int):
    """0 to n - 1, the middle of every range before its halves."""
    stack = [(0, n)]
    while stack:
        a, b = stack.pop()
        if a < b:
            middle = (a + b) // 2
            yield middle
            stack += [(middle + 1, b), (a, middle)]


# ---------------------------------------------------------------------------------------------------------------- nodes
class Node:
    """``children, leaves, saved`` count what is closed below; ``end`` is the hash of the ids that end here, ``part`` names a sequence whose ids
    are still in pieces; ``name`` is the prefix's own name once it has been on a path; ``kids`` are rows of closed children."""
    __slots__ = ("depth", "turn_id", "chars", "members", "conv_id", "children", "leaves", "saved", "end", "part", "name", "kids", "first")

    def __init__(self, depth, turn_id, chars, members, conv_id, children, leaves, saved, end, part, name):
        self.depth, self.turn_id, self.chars, self.members, self.conv_id = depth, turn_id, chars, members, conv_id
        self.children, self.leaves, self.saved, self.end, self.part, self.name = children, leaves, saved, end, part, name
        self.kids, self.first = [], False

    def record(self):
        return (self.depth, self.turn_id, self.chars, self.members, self.conv_id, self.children, self.leaves, self.saved, self.end, self.part, self.name)

    def absorb(self, other):
        self.members += other.members
        self.conv_id = min(self.conv_id, other.conv_id)
        self.children, self.leaves, self.saved = self.children + other.children, self.leaves + other.leaves, self.saved + other.saved
        self.end, self.part = self.end or other.end, self.part or other.part
        self.kids += other.kids


class Border:
    """Joins the nodes of neighbouring shards, given in order, on the path that is open to the right.

    A node that leaves the path is closed: it completes its counts, adds them to its parent's, and its children's rows go out with its smallest
    member.  Nodes of the first path are kept for the neighbour on the left, unless there is none (``last_round``).
    """

    def __init__(self, out, last_round=False):
        self.out, self.path, self.kept, self.first_open, self.last_round = out, [], [], not last_round, last_round

    def add(self, node: Node):
        d = node.depth
        if d < len(self.path):
            if self.path[d].turn_id == node.turn_id:
                self.path[d].absorb(node)
                return
            self._cut(d)
        node.first = self.first_open
        self.path.append(node)
        if node.first:
            self.kept.append(node)

    def _cut(self, depth):
        self.first_open = False
        while len(self.path) > depth:
            node = self.path.pop()
            if not node.first:
                self._close(node, self.path[-1] if self.path else None)

    def _close(self, node, parent):
        if not node.children:
            node.leaves = 1
        node.saved += (node.members - 1) * node.chars
        for row in node.kids:
            self.out.node(row, node.conv_id, None)
        if parent is None:
            self.out.node(node.record(), None, None)
        else:
            parent.children, parent.leaves, parent.saved = parent.children + 1, parent.leaves + node.leaves, parent.saved + node.saved
            parent.kids.append(node.record())

    def finish(self):
        if self.last_round:
            self._cut(0)
        for at, node in enumerate(self.kept + [node for node in self.path if not node.first]):
            for row in node.kids:
                self.out.node(row, None, node.name)
            self.out.path(at, node.record())


class Rows:
    """Rows on their way out of a task: closed nodes, nodes of the two paths, and pieces of ids."""
    NODE, PATH, IDS = 0, 1, 2
    COLUMNS = {"kind": pa.int32(), "shard": pa.int64(), "at": pa.int64(), **dict.fromkeys(("depth", "turn_id", "chars", "members", "conv_id", "children", "leaves", "saved"), pa.int64()),
               "end": pa.binary(), "part": pa.binary(), "name": pa.binary(), "parent_conv_id": pa.int64(), "parent_name": pa.binary(), "ids": pa.string()}
    SCHEMA = "kind int, shard long, at long, depth long, turn_id long, chars long, members long, conv_id long, children long, leaves long, saved long, end binary, part binary, " \
             "name binary, parent_conv_id long, parent_name binary, ids string"

    def __init__(self, shard):
        self.shard, self.rows, self.pieces = shard, [], 0

    def node(self, record, parent_conv_id, parent_name):
        self.rows.append((self.NODE, self.shard, 0, *record, parent_conv_id, parent_name, None))

    def path(self, at, record):
        self.rows.append((self.PATH, self.shard, at, *record, None, None, None))

    def ids(self, part, text):
        self.rows.append((self.IDS, self.shard, self.pieces, *[None] * 9, part, None, None, None, text))
        self.pieces += 1

    def batches(self, at_least=1):
        if len(self.rows) >= at_least:
            for at in range(0, len(self.rows), 50_000):
                columns = zip(*self.rows[at:at + 50_000])
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, self.COLUMNS.values())], names=list(self.COLUMNS))
            self.rows = []


def _names(ids):
    """The names of all prefixes of a sequence, from the empty one on."""
    running = hashlib.sha256(b"prefix")
    out = [running.digest()]
    for i in ids:
        running.update(i.to_bytes(8, "little"))
        out.append(running.digest())
    return out


def block_trie(block: list[tuple[int, list[int], list[int]]], border: Border, out: Rows) -> None:
    """The trie of ``(conv_id, turn ids, chars)`` in the order of ids and conversation: complete nodes as rows, the two paths to ``border``."""
    groups = []  # sequence, members' ids
    chars_of = {ROOT: 0}
    for conv_id, ids, chars in block:
        if groups and groups[-1][0] == ids:
            groups[-1][1].append(conv_id)
        else:
            groups.append((ids, [conv_id]))
            chars_of.update(zip(ids, chars))
    tree, at_root = SearchTree(), -1
    for g in median_order(len(groups)):
        if groups[g][0]:
            tree.insert(groups[g][0], g)
        else:
            at_root = g
    depths, keys, ends, parents, open_at = [0], [ROOT], [at_root], [-1], [0]
    for depth, key, end in tree.walk():
        del open_at[depth:]
        parents.append(open_at[-1])
        open_at.append(len(depths))
        depths.append(depth)
        keys.append(key)
        ends.append(end)
    n, first, last = len(depths), groups[0][0], groups[-1][0]
    name = dict(zip(open_at, _names(last)))
    name.update(zip(range(len(first) + 1), _names(first)))
    members = [len(groups[e][1]) if e >= 0 else 0 for e in ends]
    low = [groups[e][1][0] if e >= 0 else None for e in ends]
    children, leaves, saved = [0] * n, [0] * n, [0] * n
    for i in range(n - 1, 0, -1):
        p = parents[i]
        members[p] += members[i]
        low[p] = low[i] if low[p] is None else min(low[p], low[i])
        if i not in name:
            if not children[i]:
                leaves[i] = 1
            saved[i] += (members[i] - 1) * chars_of[keys[i]]
            children[p], leaves[p], saved[p] = children[p] + 1, leaves[p] + leaves[i], saved[p] + saved[i]
    kids = {i: [] for i in name}
    for i in range(n):
        e, end, part = ends[i], None, None
        if e >= 0:
            ids_of = ",".join(map(str, groups[e][1]))
            if e in (0, len(groups) - 1):  # its neighbours may have more of these conversations
                part = name[i]
                for at in range(0, len(groups[e][1]), PIECE // 8):
                    out.ids(part, ",".join(map(str, groups[e][1][at:at + PIECE // 8])))
            else:
                end = hashlib.sha256(ids_of.encode()).digest()
        row = (depths[i], keys[i], chars_of[keys[i]], members[i], low[i], children[i], leaves[i], saved[i], end, part, name.get(i))
        if i in name:
            node = Node(*row)
            node.kids = kids[i]
            border.add(node)
        elif parents[i] in name:
            kids[parents[i]].append(row)
        else:
            out.node(row, low[parents[i]], None)


def _shards(batches):
    out = Rows(TaskContext.get().partitionId())
    border, block, size, empty = Border(out), [], 0, True
    for batch in batches:
        column, conv_ids = batch.column("seq"), batch.column("conv_id").to_pylist()
        ends = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False)).tolist()
        ids, chars = (column.flatten().field(i).to_pylist() for i in (0, 1))
        start = 0
        for conv_id, end in zip(conv_ids, ends):
            block.append((conv_id, ids[start:end], chars[start:end]))
            size, start, empty = size + 1 + end - start, end, False
            if size >= BLOCK:
                block_trie(block, border, out)
                block, size = [], 0
                yield from out.batches(50_000)
    if block:
        block_trie(block, border, out)
    if not empty:
        border.finish()
    yield from out.batches()


def _joined(last_round):
    """One round: the paths of ``FAN_IN`` neighbours, sorted by group, shard and place, become two paths each."""
    def run(batches):
        out, border, group = None, None, None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("group", *list(Rows.COLUMNS)[3:14])]
            for row in zip(*columns):
                if row[0] != group:
                    if border:
                        border.finish()
                        yield from out.batches()
                    group, out = row[0], Rows(row[0])
                    border = Border(out, last_round)
                border.add(Node(*row[1:]))
        if border:
            border.finish()
            yield from out.batches()
    return run


def _hashes(batches):
    """``part, sha`` from pieces of ids that come in order."""
    part, running = None, None
    for batch in batches:
        done = []
        for p, text in zip(batch.column("part").to_pylist(), batch.column("ids").to_pylist()):
            if p != part:
                if running:
                    done.append((part, running.digest()))
                part, running = p, hashlib.sha256(text.encode())
            else:
                running.update(("," + text).encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], pa.binary()) for i in (0, 1)], names=["part", "sha"])
    if running:
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.binary()), pa.array([running.digest()], pa.binary())], names=["part", "sha"])


# ---------------------------------------------------------------------------------------------------------------- whole trie
def trie(sequences: DataFrame, written: Written) -> DataFrame:
    """All nodes of ``conv_id, seq``: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``."""
    turns = sequences.agg(F.sum(F.size("seq") + 1)).first()[0] or 0
    shards = max(-(-turns // TASK), min(sequences.sparkSession.sparkContext.defaultParallelism, -(-turns // 5_000)), 1)
    ordered = sequences.repartitionByRange(shards, "seq", "conv_id").sortWithinPartitions("seq", "conv_id")
    rows = written.table(ordered.mapInArrow(_shards, Rows.SCHEMA))
    top = rows.filter(F.col("kind") == Rows.PATH).agg(F.max("shard")).first()[0]
    paths, closed = rows, []
    while top is not None:
        last_round = top < FAN_IN
        grouped = paths.filter(F.col("kind") == Rows.PATH).withColumn("group", F.floor(F.col("shard") / FAN_IN))
        paths = written.table(grouped.repartition("group").sortWithinPartitions("group", "shard", "at").mapInArrow(_joined(last_round), Rows.SCHEMA))
        closed.append(paths.filter(F.col("kind") == Rows.NODE))
        top = None if last_round else top // FAN_IN
    late = rows.limit(0)
    for part in closed:
        late = late.unionAll(part)
    late = written.table(late)
    smallest = late.select("name", F.col("conv_id").alias("parent_is"))  # one row per prefix that was on a path
    # every shard knows its paths, so the children of one node, however many, are spread over the shards they come from
    known = rows.filter(F.col("kind") == Rows.PATH).select("shard", F.col("name").alias("parent_name")).join(smallest.withColumnRenamed("name", "parent_name"), "parent_name")
    early = rows.filter(F.col("kind") == Rows.NODE)
    waiting = early.filter("parent_name is not null").join(known, ["shard", "parent_name"])
    waiting_late = late.filter("parent_name is not null").join(smallest.withColumnRenamed("name", "parent_name"), "parent_name")
    fields = ["conv_id", "depth", "members", "children", "leaves", "saved", "end", "part"]
    nodes = early.filter("parent_name is null").select(*fields, "parent_conv_id")
    nodes = nodes.unionAll(late.filter("parent_name is null").select(*fields, "parent_conv_id"))
    nodes = nodes.unionAll(waiting.select(*fields, "parent_is")).unionAll(waiting_late.select(*fields, "parent_is"))
    pieces = rows.filter(F.col("kind") == Rows.IDS).select("part", "shard", "at", "ids")
    hashes = pieces.repartition("part").sortWithinPartitions("part", "shard", "at").mapInArrow(_hashes, "part binary, sha binary")
    whole, parts = nodes.filter("part is null"), nodes.filter("part is not null").join(hashes, "part")
    out = ("conv_id", "depth", "parent_conv_id", F.col("members").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"),
           F.col("saved").alias("saved_tokens"))
    sha = F.coalesce("end", F.lit(NO_ENDS))
    return whole.select(*out, F.lower(F.hex(sha)).alias("ends_sha256")).unionAll(parts.select(*out, F.lower(F.hex("sha")).alias("ends_sha256")))


def conversation_trie(table: DataFrame, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text", rebuild=False) -> DataFrame:
    """The prefix trie of a table of turns; with ``rebuild`` each conversation first gets the head of its group (see ``rebuilt``).

    Turns are ordered by number, null first, then by role and text; repeated rows are turns of their own.  A null role or text is empty.
    Rows without a conversation are left out.  An empty table has no node; a conversation without turns is a member of the root.
    """
    written = Written(table.sparkSession)
    sequences = encoded(turn_rows(table, conv_col, turn_col, role_col, text_col), written)
    return trie(written.table(rebuilt(sequences, written) if rebuild else sequences), written)
