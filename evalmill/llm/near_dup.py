"""Near duplicates: MinHash bands propose, odd sketches screen, full shingle sets confirm.

A document's set is its distinct ``SHINGLE``-word shingles. ``SAMPLES`` MinHash values are taken of it; the
first ``BANDS * ROWS`` make band keys, and all of them are folded into an odd sketch: a bitmap of ``BITS``
bits in which each (sample number, value) flips one bit. The XOR of two sketches is the sketch of the samples
in which they differ, so its population count estimates the Jaccard similarity, and most precisely where it is high.
At similarity 0.75 a pair shares no band with probability 5e-6, and the screen (about 4 deviations below the
threshold) drops a true link with probability 3e-5.

Work that grows with the square of a group is avoided without a cap:

1. documents of one set become one class (a third of all rows may be copies of one text); classes, not ids, are compared, so
   an id that stands for several texts has a class for each;
2. in each band bucket all members are paired with one centre only, another for each band; the best pair of each
   class is confirmed, then the best pair between each two components;
3. what may still join two components lies in buckets that hold several. Of the classes there, each takes the shingles that are rarest
   among them all, as many as ``PERCENT`` asks for: two sets that are similar enough have one of those in common whatever the order
   (prefix filtering), so this loses no pair of a bucket. Texts that are alike in frequent passages only share none, and never meet. Rarity is read
   from counts in ``2 ** CELL_BITS`` cells of the hash space, a table of fixed size. A pair of different components that shares one meets if
   so many shingles are left in both sets from there on, in the order of rarity, as it must have in common; it passes the sketch screen, and what passes is confirmed.

Documents travel as signatures (about 0.3 KB); texts move only for classes that share a bucket.

Edge cases: null or empty texts and texts without words have an empty set, are linked with nothing and are kept.
Rows with a null id take part in no link and are kept. Rows that repeat an id and a text fall in one class; rows with one id and several texts
are each linked by their own text. An empty table gives an empty one. Columns of the input other than the two named are not looked at.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalmill.llm._tables import Store
from evalmill.llm._text import U64, mix, released, shingle_sets, slices, utf8

SHINGLE, PERCENT = 5, 75
BANDS, ROWS = 32, 4
SAMPLES, BITS = 1024, 2048
#: XOR population count up to which a pair is confirmed: similarity of about 0.68.
SCREEN = 485

_A = (mix(np.arange(1, SAMPLES + 1, dtype=U64)) >> U64(32)).astype(np.uint32) | np.uint32(1)
_B = (mix(np.arange(1001, SAMPLES + 1001, dtype=U64)) >> U64(32)).astype(np.uint32)
_TURN = 1 << 16
#: Shingles of texts that a task remembers while it confirms pairs.
_KNOWN = 1 << 21
CELL_BITS = 20
#: Sizes of sets are told apart by powers of this.
SIZE_STEP = 1.2
#: So many members of a component at one shingle are kept from meeting each other.
CROWD = 64


def minhash(sets: list[np.ndarray]) -> np.ndarray:
    """SAMPLES x len(sets) smallest hash values; no set may be empty."""
    out = np.empty((SAMPLES, len(sets)), dtype=np.uint32)
    lo = 0
    while lo < len(sets):
        hi, n = lo, 0
        while hi < len(sets) and (hi == lo or n + len(sets[hi]) <= _TURN):
            n += len(sets[hi])
            hi += 1
        x = (np.concatenate(sets[lo:hi]) >> U64(32)).astype(np.uint32)
        first = np.cumsum([0, *(len(s) for s in sets[lo : hi - 1])])
        v = np.empty_like(x)
        for j in range(SAMPLES):
            np.multiply(x, _A[j], out=v)
            np.add(v, _B[j], out=v)
            out[j, lo:hi] = np.minimum.reduceat(v, first)
        lo = hi
    return out


def band_keys(samples: np.ndarray) -> np.ndarray:
    """len x BANDS keys."""
    rows = samples[: BANDS * ROWS].astype(U64).reshape(BANDS, ROWS, -1)
    key = np.repeat(mix(np.arange(77, 77 + BANDS, dtype=U64))[:, None], rows.shape[2], axis=1)
    for r in range(ROWS):
        key = mix(key + rows[:, r, :])
    return key.T.astype(np.int64)


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """len x (BITS / 64) words: each (sample number, value) flips a bit."""
    number = mix(np.arange(5001, 5001 + SAMPLES, dtype=U64))[:, None]
    bit = mix(samples.astype(U64) + number) % U64(BITS)
    out = np.zeros((samples.shape[1], BITS // 64), dtype=U64)
    for j in range(SAMPLES):
        out[np.arange(samples.shape[1]), (bit[j] >> U64(6)).astype(np.int64)] ^= U64(1) << (bit[j] & U64(63))
    return out.view(np.int64)


_SIGNATURE = "doc_id long, text_hash long, n_shingles long, set_hash binary, bands array<long>, sketch array<long>"


def _signatures(batches):
    for batch in batches:
        for rows, data, at in slices(batch, "text"):
            sets = shingle_sets(data, at, SHINGLE)
            some = [i for i, s in enumerate(sets) if len(s)]
            bands, sketch = [None] * len(sets), [None] * len(sets)
            if some:
                samples = minhash([sets[i] for i in some])
                for i, b, s in zip(some, band_keys(samples).tolist(), odd_sketch(samples).tolist(), strict=True):
                    bands[i], sketch[i] = b, s
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("doc_id"), rows.column("text_hash"), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                    pa.array(bands, pa.list_(pa.int64())), pa.array(sketch, pa.list_(pa.int64())),
                ],
                ["doc_id", "text_hash", "n_shingles", "set_hash", "bands", "sketch"],
            )


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(docs["text"]).alias("text_hash"), docs["text"])


def signatures(docs: DataFrame) -> DataFrame:
    return _rows(docs).mapInArrow(released(_signatures), _SIGNATURE)


def _confirm(batches):
    known: dict[int, np.ndarray] = {}
    for batch in batches:
        a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
        sides = [utf8(batch.column(c)) for c in ("text_a", "text_b")]

        def of(side: int, key: int, i: int, sides=sides) -> np.ndarray:
            if key not in known:
                if len(known) % 64 == 63 and sum(map(len, known.values())) > _KNOWN:
                    known.clear()
                data, at = sides[side]
                part = data[at[i] : at[i + 1]]
                known[key] = shingle_sets(part, np.array([0, len(part)]), SHINGLE)[0]
            return known[key]

        linked = np.zeros(len(a), dtype=bool)
        for i in range(len(a)):
            x, y = of(0, a[i], i), of(1, b[i], i)
            common = len(np.intersect1d(x, y, assume_unique=True))
            linked[i] = 100 * common >= PERCENT * (len(x) + len(y) - common)
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked)], ["a", "b", "linked"])


def confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) of texts (id, text), an id for each text, whose full sets are similar enough."""
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(released(_confirm), "a long, b long, linked boolean").where("linked").select("a", "b")


def _count_cells(batches):
    total = np.zeros(1 << CELL_BITS, dtype=np.int64)
    for batch in batches:
        for _, data, at in slices(batch, "text"):
            for s in shingle_sets(data, at, SHINGLE):
                np.add.at(total, (s >> U64(64 - CELL_BITS)).astype(np.int64), 1)
    met = np.flatnonzero(total)
    for i in range(0, len(met), 1 << 16):
        part = met[i : i + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(total[part])], ["cell", "n"])


def _pack_cells(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([b.column(c).to_numpy(zero_copy_only=False).astype(kind).tobytes()], pa.binary()) for c, kind in (("cell", "<i4"), ("level", "u1"))], ["cell", "level"])


def prefix_size(n: int) -> int:
    """How many of n shingles must be looked at so that a set similar enough has one of them."""
    return n + (-PERCENT * n) // 100 + 1


def _rarest(sent):
    def rarest(batches):
        for batch in batches:
            for rows, data, at in slices(batch, "text"):
                picked = []
                for s in shingle_sets(data, at, SHINGLE):
                    # sets are sorted, so a stable sort by level orders by (level, shingle): the same order for all sets
                    picked.append(s[np.argsort(sent.value[(s >> U64(64 - CELL_BITS)).astype(np.int64)], kind="stable")[: prefix_size(len(s))]] if len(s) else s)
                n = np.array([len(p) for p in picked])
                ids, homes = (np.repeat(rows.column(c).to_numpy(), n) for c in ("id", "component"))
                sizes = np.repeat(rows.column("n_shingles").to_numpy(), n)
                left = sizes - (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))  # what stands here and behind in the order
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(picked).view(np.int64)), pa.array(ids), pa.array(homes), pa.array(sizes), pa.array(left)], ["shingle", "id", "component", "n_shingles", "left"])

    return rarest


def _by_partner(rare: DataFrame) -> DataFrame:
    """Rows of ``rare`` once for each class of sizes (``partner``; ``own`` is the row's) that a set may have with which what is left here can suffice; none for most shingles that stand late."""
    n, left = F.col("n_shingles"), F.col("left")
    size = lambda c: F.floor(F.log(c.cast("double")) / math.log(SIZE_STEP)).cast("int")
    least = F.ceil(n * PERCENT / 100)
    most = F.least(F.floor(n * 100 / PERCENT), F.floor(left * (100 + PERCENT) / PERCENT) - n)
    fit = rare.withColumns({"least": least, "most": most}).where("most >= least")
    return fit.select("shingle", "id", "component", "n_shingles", F.col("most").cast("long").alias("most"), size(n).alias("own"), F.explode(F.sequence(size(F.col("least")), size(F.col("most")))).alias("partner"))


def rare_pairs(texts: DataFrame, store: Store) -> DataFrame:
    """Pairs (a, b) of texts (id, component, n_shingles, text) of different components that share one of the shingles each must have in common with what is similar enough.

    Members of a component with more than ``CROWD`` of them at a shingle, with sizes that go together, don't meet each other: they meet the members of smaller components there, and of other crowds
    by components first. So the work on a shingle is the pairs it has to offer across components: a large component and one outsider meet in as many rows as the component has members.
    """
    level = F.least(F.floor(F.log2("n") * 8), F.lit(255)).cast("int").alias("level")
    cells = texts.select("text").mapInArrow(released(_count_cells), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).select("cell", level)
    levels = np.zeros(1 << CELL_BITS, dtype=np.uint8)
    for r in cells.mapInArrow(_pack_cells, "cell binary, level binary").collect():  # at most 2 ** CELL_BITS cells of 5 bytes
        levels[np.frombuffer(bytes(r.cell), "<i4")] = np.frombuffer(bytes(r.level), "u1")
    sent = texts.sparkSession.sparkContext.broadcast(levels)
    rare = store.keep(texts.mapInArrow(released(_rarest(sent)), "shingle long, id long, component long, n_shingles long, left long"), "rare")
    several = rare.groupBy("shingle").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("shingle")
    key = ["shingle", "own", "partner"]
    dealt = store.keep(_by_partner(rare.join(several, "shingle")), "shared")
    crowds = dealt.groupBy(*key, "component").agg(F.count("*").alias("members"), F.min("n_shingles").alias("fewest"), F.max("most").alias("highest")).where(F.col("members") > CROWD)
    crowds = store.keep(crowds, "crowds")
    told = dealt.join(crowds.select(*key, "component", F.lit(True).alias("crowd")), [*key, "component"], "left").fillna(False, ["crowd"])
    # the first shingle two sets share, in the common order, has all others they share behind it in both: sizes must suit what is left on either side
    one, two = (told.select("shingle", F.col("own").alias(own), F.col("partner").alias(partner), F.col("id").alias(i), F.col("component").alias(f"c{i}"), F.col("n_shingles").alias(f"n{i}"), F.col("most").alias(f"most{i}"), F.col("crowd").alias(f"crowd{i}")) for i, own, partner in (("a", "x", "y"), ("b", "y", "x")))
    fits = (F.col("nb") <= F.col("mosta")) & (F.col("na") <= F.col("mostb"))
    apart = (F.col("ca") < F.col("cb")) | ((F.col("ca") > F.col("cb")) & F.col("crowdb"))
    met = one.where("NOT crowda").join(two, ["shingle", "x", "y"]).where(apart & fits).select("a", "b")
    # large crowds meet by their components first
    p, q = (crowds.select("shingle", F.col("own").alias(own), F.col("partner").alias(partner), F.col("component").alias(f"c{i}"), F.col("fewest").alias(f"fewest{i}"), F.col("highest").alias(f"highest{i}")) for i, own, partner in (("a", "x", "y"), ("b", "y", "x")))
    pairs = p.join(q, ["shingle", "x", "y"]).where("ca < cb AND fewestb <= highesta AND fewesta <= highestb")
    crowded = pairs.join(one.where("crowda"), ["shingle", "x", "y", "ca"]).where("fewestb <= mosta AND na <= highestb").join(two.where("crowdb"), ["shingle", "x", "y", "cb"]).where(fits).select("a", "b")
    return store.keep(met.union(crowded).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "met")


def components(edges: DataFrame, store: Store, name: str) -> DataFrame:
    """(id, component): the smallest id each node of the edges reaches. Labels spread and jump until none changes."""
    both = edges.select(F.col("a").alias("id"), F.col("b").alias("to")).union(edges.select("b", "a"))
    both = store.keep(both.union(edges.select("a", "a")).union(edges.select("b", "b")).distinct(), f"{name}-edges")
    labels = both.groupBy("id").agg(F.min("to").alias("component"))
    turn = 0
    while True:
        turn += 1
        own = F.max(F.when(F.col("to") == F.col("id"), F.col("component")))  # each node is its own neighbour
        near = store.keep(both.join(labels.withColumnRenamed("id", "to"), "to").groupBy("id").agg(F.min("component").alias("component"), own.alias("was")), f"{name}-{turn}-near")
        onward = near.select(F.col("id").alias("component"), F.col("component").alias("onward"))
        labels = store.keep(near.join(onward, "component").select("id", F.col("onward").alias("component"), (F.col("onward") != F.col("was")).alias("moved")), f"{name}-{turn}")
        if labels.where("moved").limit(1).count() == 0:
            return labels.select("id", "component")
        labels = labels.select("id", "component")


def merged(labels: DataFrame, links: DataFrame, store: Store, name: str) -> DataFrame:
    """Labels after more links (a, b): only the components that these join are looked at, as nodes."""
    met = _with_component(_with_component(links, labels, "a", "ca"), labels, "b", "cb").where("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    over = components(met, store, name)
    known = labels.select("id", F.col("component").alias("c")).join(over.select(F.col("id").alias("c"), F.col("component").alias("o")), "c", "left").select("id", F.coalesce("o", "c").alias("component"))
    fresh = over.join(labels.select("id"), "id", "left_anti").select("id", "component")  # nodes that had no link before
    return store.keep(known.union(fresh), f"{name}-all")


def _distance(x: str, y: str) -> Column:
    return sum((F.bit_count(F.get(x, F.lit(i)).bitwiseXOR(F.get(y, F.lit(i)))) for i in range(BITS // 64)), F.lit(0))


def _with_component(df: DataFrame, labels: DataFrame, column: str, out: str) -> DataFrame:
    found = df.join(labels.select(F.col("id").alias(column), F.col("component").alias("__c")), column, "left")
    return found.withColumn(out, F.coalesce("__c", column)).drop("__c")


def near_duplicates(docs: DataFrame, store: Store | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, text_hash, group_id) for each row of ``docs`` (doc_id, text).

    text_hash is ``xxhash64`` of the text. group_id numbers the linked groups in this run, null for rows that are in none by an empty set or a null id; with
    one id on several texts it tells apart what component_id, an id, cannot.
    """
    store = store or Store(docs.sparkSession, "near-dup")
    marks = store.keep(signatures(docs), "signatures")
    one = marks.where("set_hash is not null and doc_id is not null").groupBy("set_hash").agg(F.min(F.struct("doc_id", "text_hash", "n_shingles", "bands", "sketch")).alias("m"))
    classes = store.keep(one.select(F.monotonically_increasing_id().alias("id"), "set_hash", "m.*"), "classes")  # the numbers are fixed by being written
    spread = classes.select("id", F.explode("bands").alias("key"))
    centre = F.min_by("id", F.xxhash64("id", "key"))
    stars = store.keep(spread.groupBy("key").agg(F.count("*").alias("n"), centre.alias("centre")).where("n > 1").select("key", "centre"), "stars")
    members = store.keep(spread.join(stars, "key"), "members")
    ids = members.select("id").distinct()
    shown = classes.select("id", "doc_id", "text_hash").join(ids, "id", "left_semi")
    texts = _rows(docs).join(shown, ["doc_id", "text_hash"]).groupBy("doc_id", "text_hash").agg(F.first("id").alias("id"), F.first("text").alias("text"))  # repeated rows count once
    texts = store.keep(texts.select("id", "text"), "texts")
    sketches = store.keep(classes.select("id", "sketch", "n_shingles").join(ids, "id", "left_semi"), "sketches")

    def screened(pairs: DataFrame) -> DataFrame:
        both = pairs.join(sketches.select(F.col("id").alias("a"), F.col("sketch").alias("x")), "a").join(sketches.select(F.col("id").alias("b"), F.col("sketch").alias("y")), "b")
        return both.withColumn("d", _distance("x", "y")).where(F.col("d") <= SCREEN).select("a", "b", "d")

    pairs = members.where("id <> centre").select(F.col("id").alias("a"), F.col("centre").alias("b")).distinct()
    pairs = store.keep(screened(pairs), "pairs")
    tried = store.keep(pairs.groupBy("a").agg(F.min(F.struct("d", "b")).alias("m")).select("a", "m.b"), "best")
    labels = components(store.keep(confirm(tried, texts), "links-1"), store, "components-1")

    apart = _with_component(_with_component(pairs, labels, "a", "ca"), labels, "b", "cb").where("ca <> cb")
    between = apart.groupBy(F.least("ca", "cb"), F.greatest("ca", "cb")).agg(F.min(F.struct("d", "a", "b")).alias("m")).select("m.a", "m.b")
    between = store.keep(between.join(tried, ["a", "b"], "left_anti"), "between")
    labels = merged(labels, store.keep(confirm(between, texts), "links-2"), store, "components-2")

    placed = store.keep(_with_component(members.select("id", "key"), labels, "id", "component"), "placed")
    mixed = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    inside = store.keep(placed.join(mixed, "key").groupBy("id").agg(F.min("component").alias("component")), "inside")
    met = rare_pairs(store.keep(inside.join(sketches.select("id", "n_shingles"), "id").join(texts, "id"), "apart"), store)
    seen = tried.union(between.select("a", "b"))
    seen = seen.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = screened(met).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = store.keep(rest.join(seen, ["a", "b"], "left_anti"), "rest")
    labels = merged(labels, store.keep(confirm(rest, texts), "links-3"), store, "components-3")

    home = store.keep(_with_component(classes.select("id", "set_hash", "doc_id"), labels, "id", "component"), "placed-all")
    first = home.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    home = store.keep(home.join(first, "component").select("set_hash", "component_id", F.col("component").alias("group_id")), "home")
    out = marks.select("doc_id", "n_shingles", "text_hash", "set_hash").join(home, "set_hash", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    kept = F.col("doc_id").isNull() | (F.col("doc_id") == component)
    group = F.when(F.col("doc_id").isNotNull(), F.col("group_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"), "text_hash", group.alias("group_id"))


def op10_near_dup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id", "kept")
