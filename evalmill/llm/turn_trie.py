"""Conversation prefix trie: adaptive radix trees over fixed-width turn ids, merged into one trie by Spark.

A turn's id has ``WIDTH`` bytes, big-endian: 16 of a hash of role and text, and the text's length in bytes. A conversation is the bytes of its turns end to end, cut into
segments of ``SEGMENT`` turns, so that no row grows with a conversation. What a segment hangs on, its root, is known by a hash of the segments before it.

Equal segments of one root are one entry with a count. Entries are dealt by ranges of (root, bytes) and each task puts them, a bounded block at a time, into adaptive radix trees
(``Tree``: nodes of 4, 16, 48 or 256 children that grow, compressed paths). Byte depths that are whole turns give nodes of the trie with the sums of what lies below them; parts of a
node from several blocks or tasks are added up by the node's hash. A node that a third of all conversations share is one row for each block.

Sums over subtrees need no walk over the trie either. Each node belongs to its smallest member, and a conversation's nodes are the end of its path. So the bytes of a subtree's nodes
are the sum of the bytes that its members own, but for what its smallest member owns above; a first pass finds the owners, a second one adds up. The text is read once, and shuffled never.

Edge cases: null roles and texts are empty; rows without conv_id belong to no conversation; equal turn numbers are put in order of their ids, null turns come first; an empty table has
no nodes; further columns are not read. A conversation may have any number of turns: turns are numbered in ranges, segments are put together apart from each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalmill.llm._tables import Store
from evalmill.llm._text import released

WIDTH, SEGMENT = 20, 256
#: Conversations of one family of so many take their head from the first; a head has fewer turns than ``HEADS``.
FAMILY, HEADS = 5, 9
#: Entries, and bytes of them, that one block of trees holds.
BLOCK_ENTRIES, BLOCK_BYTES = 1 << 13, 1 << 23
#: Ids of conversations whose decimals are joined in one row.
IDS = 256
ROOT = bytes(16)


class Node4:
    """Up to four children, found by looking at each label."""

    __slots__ = ("below", "labels", "path", "value")
    ROOM = 4

    def __init__(self, path: bytes = b""):
        self.path, self.value, self.labels, self.below = path, None, bytearray(), []

    def get(self, label: int):
        at = self.labels.find(label)
        return None if at < 0 else self.below[at]

    def put(self, label: int, node) -> bool:
        """False if there is no room for a further child."""
        at = self.labels.find(label)
        if at >= 0:
            self.below[at] = node
        elif len(self.labels) == self.ROOM:
            return False
        else:
            at = sum(x < label for x in self.labels)
            self.labels.insert(at, label)
            self.below.insert(at, node)
        return True

    def children(self) -> Iterator[tuple[int, object]]:
        return zip(self.labels, self.below, strict=True)


class Node16(Node4):
    __slots__ = ()
    ROOM = 16


class Node48:
    """Up to 48 children behind a table of all labels."""

    __slots__ = ("below", "path", "place", "value")
    ROOM = 48

    def __init__(self, path: bytes = b""):
        self.path, self.value, self.place, self.below = path, None, bytearray(256), []

    def get(self, label: int):
        at = self.place[label]
        return self.below[at - 1] if at else None

    def put(self, label: int, node) -> bool:
        at = self.place[label]
        if at:
            self.below[at - 1] = node
        elif len(self.below) == self.ROOM:
            return False
        else:
            self.below.append(node)
            self.place[label] = len(self.below)
        return True

    def children(self) -> Iterator[tuple[int, object]]:
        return ((label, self.below[at - 1]) for label, at in enumerate(self.place) if at)


class Node256:
    """A place for every label."""

    __slots__ = ("below", "path", "value")

    def __init__(self, path: bytes = b""):
        self.path, self.value, self.below = path, None, [None] * 256

    def get(self, label: int):
        return self.below[label]

    def put(self, label: int, node) -> bool:
        self.below[label] = node
        return True

    def children(self) -> Iterator[tuple[int, object]]:
        return ((label, node) for label, node in enumerate(self.below) if node is not None)


LARGER = {Node4: Node16, Node16: Node48, Node48: Node256}


def grown(node):
    """The same node in the next larger layout."""
    out = LARGER[type(node)](node.path)
    out.value = node.value
    for label, child in node.children():
        out.put(label, child)
    return out


def shared(a: bytes, b: bytes) -> int:
    """How many bytes two strings have in common from the left."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo = 0
    while n - lo > 1:
        half = (lo + n) // 2
        lo, n = (half, n) if a[lo:half] == b[lo:half] else (lo, half)
    return lo


class Tree:
    """Byte strings, also ones that begin others, with a value each."""

    def __init__(self):
        self.top = Node4()

    def insert(self, key: bytes, value) -> None:
        above, label, node, at = None, 0, self.top, 0
        while True:
            n = shared(node.path, key[at:])
            if n < len(node.path):  # the path is cut in two
                upper = Node4(node.path[:n])
                upper.put(node.path[n], node)
                node.path = node.path[n + 1 :]
                self._hang(above, label, upper)
                node = upper
            at += n
            if at == len(key):
                node.value = value
                return
            following = node.get(key[at])
            if following is None:
                leaf = Node4(key[at + 1 :])
                leaf.value = value
                if not node.put(key[at], leaf):
                    node = grown(node)
                    self._hang(above, label, node)
                    node.put(key[at], leaf)
                return
            above, label, node, at = node, key[at], following, at + 1

    def _hang(self, above, label: int, node) -> None:
        if above is None:
            self.top = node
        else:
            above.put(label, node)

    def walk(self) -> Iterator[tuple[bytes, int, list]]:
        """(bytes from the top, the depth its parent ends at, values below) of every node, children first; values below: those ``added`` made of them."""
        stack = [(self.top, self.top.path, -1, None)]
        done: dict[int, tuple] = {}
        while stack:
            node, key, above, listed = stack.pop()
            if listed is None:
                listed = [(child, key + bytes((label,)) + child.path) for label, child in node.children()]
                stack.append((node, key, above, listed))
                stack.extend((child, path, len(key), None) for child, path in listed)
                continue
            values = [done.pop(id(child)) for child, _ in listed]
            if node.value is not None:
                values.append(node.value)
            if not values:
                continue
            total = values[0] if len(values) == 1 else added(values)
            done[id(node)] = total
            yield key, above, total


def added(values: list[tuple]) -> tuple:
    """(n, total, own, leaves, (smallest member, its own, its total)) of several."""
    n, total, own, leaves, least = zip(*values, strict=True)
    return sum(n), sum(total), sum(own), sum(leaves), min(least)


def joint(root: bytes, seg: int, key: bytes) -> bytes:
    """The id of the node a whole segment ends at, which is the root of those behind it."""
    own = hashlib.sha256(b"%d:" % seg + key).digest()[:16]
    return (int.from_bytes(root, "big") ^ int.from_bytes(own, "big")).to_bytes(16, "big")


NODE = "id binary, parent binary, depth long, bytes long, before long, n long, total long, own long, leaves long, least struct<conv_id:long,own:long,total:long>"
_LEAST = pa.struct([("conv_id", pa.int64()), ("own", pa.int64()), ("total", pa.int64())])
_ARROW = pa.schema([("id", pa.binary()), ("parent", pa.binary()), *((c, pa.int64()) for c in ("depth", "bytes", "before", "n", "total", "own", "leaves")), ("least", _LEAST)])


def nodes_of(root: bytes, seg: int, before: int, tree: Tree) -> Iterator[tuple]:
    """Rows of ``NODE``: the trie's nodes in one tree, at depths of whole turns; the root of all is one of them."""
    for key, above, (n, total, own, leaves, least) in tree.walk():
        first, last = (above // WIDTH + 1 if above >= 0 else 0), len(key) // WIDTH
        sizes = [int.from_bytes(key[t * WIDTH - 4 : t * WIDTH], "big") for t in range(1, last + 1)]
        ids = {t: root if t == 0 else joint(root, seg, key[: SEGMENT * WIDTH]) if t == SEGMENT else hashlib.sha256(root + key[: t * WIDTH]).digest()[:16] for t in range(max(0, first - 1), last + 1)}
        so_far = before + sum(sizes[: max(0, first - 1)])
        for t in range(first, last + 1):
            if t == 0:
                if seg == 0:
                    yield root, None, 0, 0, 0, n, total, own, leaves, least
                continue
            yield ids[t], ids[t - 1], seg * SEGMENT + t, sizes[t - 1], so_far, n, total, own, leaves, least
            so_far += sizes[t - 1]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    least = [{"conv_id": c, "own": o, "total": t} for c, o, t in columns[-1]]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([*columns[:-1], least], _ARROW, strict=True)], schema=_ARROW)


def _in_trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries in order of (seg, root, bytes) to their nodes; a block of entries at a time."""
    place, tree, entries, size, out = None, None, 0, 0, []
    for batch in batches:
        for r in batch.to_pylist():
            here = (r["seg"], r["root"], r["before"])
            if tree is not None and (here != place or entries >= BLOCK_ENTRIES or size >= BLOCK_BYTES):
                out += nodes_of(place[1], place[0], place[2], tree)
                tree = None
            if len(out) >= BLOCK_ENTRIES:
                yield _rows(out)
                out = []
            if tree is None:
                place, tree, entries, size = here, Tree(), 0, 0
            least = r["least"]
            tree.insert(r["key"], (r["n"], r["total"], r["own"], r["leaves"], (least["conv_id"], least["own"], least["total"])))
            entries, size = entries + 1, size + len(r["key"])
    if tree is not None:
        out += nodes_of(place[1], place[0], place[2], tree)
    if out:
        yield _rows(out)


_in_trees = released(_in_trees)


def _half(digest: Column, which: int) -> Column:
    """Eight bytes of a hexadecimal digest as a long."""
    return F.conv(F.substring(digest, 1 + 16 * which, 16), 16, -10).cast("long")


def _binary(a: Column, b: Column) -> Column:
    return F.unhex(F.concat(F.lpad(F.hex(a), 16, "0"), F.lpad(F.hex(b), 16, "0")))


def numbered_turns(conversations: DataFrame, store: Store) -> tuple[DataFrame, DataFrame]:
    """(turns, places): turns (conv_id, part, at, tid, size) dealt by ranges of (conv_id, turn), and for each (conv_id, part) the number of turns before it.

    A turn's number in its conversation is ``at - first + before + 1``: no task counts a whole conversation.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    size = F.octet_length(text)
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    tid = F.unhex(F.concat(F.substring(digest, 1, 32), F.lpad(F.hex(size.cast("long")), 8, "0")))
    keyed = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", tid.alias("tid"), size.alias("size"), F.monotonically_increasing_id().alias("row"))
    order = ["conv_id", "turn", "tid", "row"]
    ranged = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    turns = store.keep(ranged.select("conv_id", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"), "tid", "size"), "turns")
    places = turns.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # one row for each part of a conversation
    return turns, store.keep(places.withColumn("before", F.coalesce(before, F.lit(0))), "places")


def rebuilt_paths(turns: DataFrame, places: DataFrame, store: Store) -> DataFrame:
    """Each conversation with the head of its family's first one, in segments: (conv_id, seg, root, before, key, total, end_id); end_id in the last segment alone."""
    counted = places.groupBy("conv_id").agg(F.sum("n").alias("n"))
    first = counted.select(F.col("conv_id").alias("family"), F.col("n").alias("n_first"))
    head = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")
    convs = counted.withColumns({"family": F.col("conv_id") - F.pmod("conv_id", F.lit(FAMILY)), "head": head}).join(first, "family", "left")
    given = F.least("head", F.coalesce("n_first", F.lit(0))).cast("long")
    convs = store.keep(convs.select("conv_id", "head", given.alias("given"), (given + F.greatest(F.col("n") - F.col("head"), F.lit(0))).alias("length")), "convs")
    at = turns.join(places.join(convs, "conv_id"), ["conv_id", "part"]).withColumn("pos", F.col("at") - F.col("first") + F.col("before") + 1)
    own = at.where("pos > head").select("conv_id", (F.col("given") + F.col("pos") - F.col("head")).alias("pos"), "tid", "size", "length")
    heads = at.where((F.pmod("conv_id", F.lit(FAMILY)) == 0) & (F.col("pos") < HEADS)).select(F.explode(F.sequence(F.col("conv_id"), F.col("conv_id") + FAMILY - 1)).alias("conv_id"), "pos", "tid", "size")
    taken = heads.join(convs, "conv_id").where("pos <= head").select("conv_id", "pos", "tid", "size", "length")
    seg = F.floor((F.col("pos") - 1) / SEGMENT).cast("int")
    pieces = own.union(taken).groupBy("conv_id", seg.alias("seg"), "length").agg(F.array_sort(F.collect_list(F.struct("pos", "tid"))).alias("t"), F.sum("size").cast("long").alias("size"))  # a segment's turns
    pieces = pieces.select("conv_id", "seg", "length", F.unhex(F.array_join(F.transform("t", lambda x: F.hex(x["tid"])), "")).alias("key"), "size")
    without = convs.where("length = 0").select("conv_id", F.lit(0).alias("seg"), "length", F.lit(b"").alias("key"), F.lit(0).cast("long").alias("size"))
    digest = F.sha2(F.concat(F.concat(F.col("seg").cast("string"), F.lit(":")).cast("binary"), F.col("key")), 256)
    pieces = pieces.union(without).withColumns({"a": _half(digest, 0), "b": _half(digest, 1)})
    zero = F.lit(0).cast("long")
    short = pieces.where(F.col("length") <= SEGMENT).withColumns({"ra": zero, "rb": zero, "before": zero, "total": F.col("size")})
    w = Window.partitionBy("conv_id").orderBy("seg")
    earlier, all_of = w.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("conv_id")
    long = pieces.where(F.col("length") > SEGMENT).withColumns({"ra": F.coalesce(F.bit_xor("a").over(earlier), zero), "rb": F.coalesce(F.bit_xor("b").over(earlier), zero), "before": F.coalesce(F.sum("size").over(earlier), zero), "total": F.sum("size").over(all_of)})
    root = _binary(F.col("ra"), F.col("rb"))
    inner = F.unhex(F.substring(F.sha2(F.concat(root, F.col("key")), 256), 1, 32))
    last = F.col("length") <= (F.col("seg") + 1) * SEGMENT
    whole = F.length("key") == SEGMENT * WIDTH
    end = F.when(last, F.when(whole, _binary(F.col("ra").bitwiseXOR(F.col("a")), F.col("rb").bitwiseXOR(F.col("b")))).when(F.length("key") == 0, root).otherwise(inner))
    return short.unionByName(long).select("conv_id", "seg", root.alias("root"), "before", "key", "total", end.alias("end_id"))


def _nodes(paths: DataFrame) -> DataFrame:
    """Parts of nodes of weighted paths (n, total, own, leaves, least)."""
    sums = [F.sum(c).alias(c) for c in ("n", "total", "own", "leaves")]
    entries = paths.groupBy("seg", "root", "before", "key").agg(*sums, F.min("least").alias("least"))
    order = ["seg", "root", "key"]
    return entries.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_in_trees, NODE)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (end_id, block, ids) in order to one row for each end_id, hashed as they come."""
    schema = pa.schema([("id", pa.binary()), ("ends_sha256", pa.string())])
    here, state, out = None, None, []
    for batch in batches:
        for end, ids in zip(batch.column("end_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if end == here:
                state.update(b"," + ids.encode())
                continue
            if here is not None:
                out.append((here, state.hexdigest()))
            here, state = end, hashlib.sha256(ids.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
            out = []
    if here is not None:
        yield pa.RecordBatch.from_arrays([pa.array([here], pa.binary()), pa.array([state.hexdigest()])], schema=schema)


def ended(paths: DataFrame) -> DataFrame:
    """(id, ends_sha256): SHA-256 of the ids, in order, of the conversations that end at a node. A hash takes its input in order; rows of up to ``IDS`` ids come sorted by Spark and none is kept."""
    block = F.floor(F.col("conv_id") / IDS)
    listed = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    parts = paths.where("end_id IS NOT NULL").groupBy("end_id", block.alias("block")).agg(listed.alias("ids"))
    return parts.repartition("end_id").sortWithinPartitions("end_id", "block").mapInArrow(_digests, "id binary, ends_sha256 string")


def prefix_trie(conversations: DataFrame, store: Store | None = None) -> DataFrame:
    """The nodes of the trie of all rebuilt conversations: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)."""
    store = store or Store(conversations.sparkSession, "turn-trie")
    turns, places = numbered_turns(conversations, store)
    paths = store.keep(rebuilt_paths(turns, places, store), "paths")
    zero = F.lit(0).cast("long")
    plain = paths.withColumns({"n": F.lit(1).cast("long"), "own": zero, "leaves": zero, "least": F.struct("conv_id", zero.alias("own"), zero.alias("total"))})
    owners = store.keep(_nodes(plain).groupBy("id").agg(F.max("parent").alias("parent"), F.max("bytes").alias("bytes"), F.min("least.conv_id").alias("conv_id")), "owners")
    kids = owners.where("parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("n_children"))
    own = owners.join(kids, "id", "left").groupBy("conv_id").agg(F.sum("bytes").alias("own"), F.count_if(F.col("n_children").isNull()).alias("leaves"))
    held = paths.join(own, "conv_id", "left").withColumns({"n": F.lit(1).cast("long"), "own": F.coalesce("own", zero), "leaves": F.coalesce("leaves", zero)})
    parts = _nodes(held.withColumn("least", F.struct("conv_id", "own", "total")))
    nodes = parts.groupBy("id").agg(*(F.max(c).alias(c) for c in ("parent", "depth", "before")), *(F.sum(c).alias(c) for c in ("n", "total", "own", "leaves")), F.min("least").alias("least"))
    nodes = nodes.join(kids, "id", "left").join(ended(paths), "id", "left")
    least = F.col("least")
    below = F.col("own") - (F.col("before") - (least["total"] - least["own"]))
    saved = F.col("total") - F.col("n") * F.col("before") - below
    out = store.keep(nodes.select(
        "id", "parent", least["conv_id"].alias("conv_id"), "depth", F.col("n").alias("n_convs"), F.coalesce("n_children", zero).alias("n_children"), F.col("leaves").alias("n_leaves"),
        saved.alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256)).alias("ends_sha256"),
    ), "nodes")
    above = out.select(F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return out.join(above, "parent", "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op11_turn_trie(spark, sf_dir: str) -> DataFrame:
    """The prefix trie of all conversations."""
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


_CRC = "xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST({c} AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))), lambda s, b: " + "{step}" + "))"


def _crc_step() -> str:
    x = "xor(s, b)"
    return f"list_reduce(list_prepend({x}, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda v, i: xor(v >> 1, 3988292384 * (v & 1)))"


ORACLE_SQL = f"""WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(CAST(strlen(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos,
  coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, ((conv_id % 5) + 5) % 5 AS place, {_CRC.format(c="conv_id", step=_crc_step())} % 9 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, 0 AS part, t.pos, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id - c.place AND t.pos <= c.h UNION ALL SELECT c.conv_id, 1, t.pos, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos > c.h),
o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS depth, sha256(CAST(strlen(role) AS VARCHAR) || ':' || role || text) AS turn, strlen(text) AS bytes FROM r),
p AS (SELECT conv_id, depth, string_agg(turn, ',') OVER (PARTITION BY conv_id ORDER BY depth ROWS UNBOUNDED PRECEDING) AS path, bytes FROM o UNION ALL SELECT conv_id, 0, '', 0 FROM c),
q AS (SELECT conv_id, depth, sha256(path) AS node, bytes, max(depth) OVER (PARTITION BY conv_id) AS length FROM p),
n AS (SELECT depth, node, min(conv_id) AS conv_id, count(*) AS n_convs, max(bytes) AS bytes, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (depth = length), '')) AS ends_sha256 FROM q GROUP BY 1, 2),
a AS (SELECT n.depth, n.node, q.node AS above, q.depth AS above_depth, n.n_convs, n.bytes FROM n JOIN q ON q.conv_id = n.conv_id AND q.depth <= n.depth),
k AS (SELECT above AS node, above_depth AS depth, count(*) AS n_children FROM a WHERE above_depth = depth - 1 GROUP BY 1, 2),
l AS (SELECT a.above AS node, a.above_depth AS depth, count(*) FILTER (k.node IS NULL) AS n_leaves, CAST(sum((a.n_convs - 1) * a.bytes) AS BIGINT) AS saved_tokens FROM a LEFT JOIN k ON k.node = a.node AND k.depth = a.depth GROUP BY 1, 2)
SELECT n.conv_id, n.depth, m.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, l.n_leaves, l.saved_tokens, n.ends_sha256
FROM n JOIN l ON l.node = n.node AND l.depth = n.depth LEFT JOIN k ON k.node = n.node AND k.depth = n.depth LEFT JOIN a ON a.node = n.node AND a.depth = n.depth AND a.above_depth = n.depth - 1 LEFT JOIN n m ON m.node = a.above AND m.depth = a.above_depth"""
