"""Prediction by partial matching over bytes, pretrained on a corpus, and a word-frequency score beside it.

The trie holds how often each byte (or the end of the text, symbol 256) follows each context of up to ``order``
bytes; before a text stand start symbols. A symbol's probability is read in the longest context seen in training:
count / (n + d), where n is the context's total and d its number of distinct symbols. A symbol unseen there
escapes with d / (n + d) to the context one byte shorter, where symbols already offered are excluded from the totals;
below the empty context all symbols left are equally likely. So the probabilities of all symbols sum to one.

Scale: counts of (context, symbol) codes are made per partition by sorting, then added by key. The trie is a distributed
table of any size, one row per distinct code, and the order is the same at every size. Sent to all tasks are the contexts of
up to ``LOW`` bytes and, of the longer ones, the most frequent with all their symbols: those met at least as often as the least power of
two that leaves at most ``MAX_NODES`` codes (those of up to ``LOW`` bytes are at most 257^3, whatever the corpus). A suffix of a context is met as often at least, so a symbol whose longest
context was sent has all it can escape to there too. All other codes leave the tasks counted by row and meet the whole table by
the last bytes of their contexts, groups that are too large by one byte more; the probabilities are the same either way. Word counts are a distributed table too,
keyed by 64-bit word hashes; only the most frequent ``HEAD`` words are sent to the tasks, all other words of a text meet the
table in a join.

Edge cases: a null text counts as empty and has one token, its end. A null id counts as a training row. Repeated
rows each get a result. With no training rows all symbols are equally likely, no token is known.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalmill.llm._tables import Store
from evalmill.llm._text import U64, released, slices, word_bounds, word_hashes

ORDER = 5
MAX_NODES = 1 << 22
HEAD = 1 << 17
LOW = 2
GROUP_NODES = 1 << 18
END, SYMBOLS, SHIFT = 256, 257, 9
_BUFFER = 1 << 21


def mask(k: int) -> np.uint64:
    return U64((1 << (SHIFT * k)) - 1)


def codes_of(data: np.ndarray, at: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The code (context and symbol) of every symbol of every text, and len + 1 offsets by text."""
    lens = np.diff(at)
    stream = np.full(len(data) + len(lens) * (order + 1), END, dtype=np.uint16)
    row = np.repeat(np.arange(len(lens)), lens)
    stream[np.arange(len(data)) + (row + 1) * order + row] = data
    n = len(stream) - order
    code = stream[:n].astype(U64)
    for j in range(1, order + 1):
        code = (code << U64(SHIFT)) | stream[j : n + j]
    first = at[:-1] + np.arange(len(lens)) * (order + 1)
    out = np.concatenate([[0], np.cumsum(lens + 1)])
    keep = np.repeat(first - out[:-1], lens + 1) + np.arange(out[-1])
    return code[keep], out


def add_up(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sums of n."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n[order], first) if len(keys) else n


class _Counter:
    """Counts of keys, merged now and then; hands over what it holds when that is large."""

    def __init__(self):
        self.parts, self.held = [], 0

    def add(self, keys: np.ndarray):
        k, n = np.unique(keys, return_counts=True)
        self.parts.append((k, n))
        self.held += len(k)
        if self.held > _BUFFER:
            k, n = self.merged()
            if len(k) > _BUFFER // 2:
                self.parts, self.held = [], 0
                return k, n
            self.parts, self.held = [(k, n)], len(k)
        return None

    def merged(self):
        if not self.parts:
            return np.zeros(0, U64), np.zeros(0, np.int64)
        return add_up(np.concatenate([p[0] for p in self.parts]), np.concatenate([p[1] for p in self.parts]))


def _rows(pair, kind: int):
    keys, n = pair
    for i in range(0, len(keys), 1 << 16):
        k = keys[i : i + (1 << 16)].view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int32)), pa.array(k), pa.array(n[i : i + (1 << 16)].astype(np.int64))], ["kind", "key", "n"])


def _counting(order: int):
    def count(batches):
        trie, words, docs = _Counter(), _Counter(), 0
        for batch in batches:
            docs += batch.num_rows
            for _, data, at in slices(batch, "text"):
                starts, ends, _by = word_bounds(data, at)
                for kind, counter, keys in ((0, trie, codes_of(data, at, order)[0]), (1, words, word_hashes(data, starts, ends))):
                    if full := counter.add(keys):
                        yield from _rows(full, kind)
        yield from _rows(trie.merged(), 0)
        yield from _rows(words.merged(), 1)
        yield from _rows((np.zeros(1, U64), np.array([docs])), 2)

    return count


class Lookup:
    """Open addressing: positions of keys in a sorted array, many at once."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(2 * len(keys)).bit_length())
        size = 1 << self.bits
        self.keys, self.slots, self.at = keys, np.zeros(size, U64), np.full(size, -1, np.int32)
        left, step, home = np.arange(len(keys)), 0, self._home(keys)
        while len(left):
            slot = (home[left] + step) & (size - 1)
            free = np.flatnonzero(self.at[slot] < 0)
            _, first = np.unique(slot[free], return_index=True)
            won = free[first]
            self.slots[slot[won]], self.at[slot[won]] = keys[left[won]], left[won]
            left = np.delete(left, won)
            step += 1
        self.steps = step

    def _home(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys * U64(0x9E3779B97F4A7C15)) >> U64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Positions, -1 where there is none."""
        slot = self._home(keys)
        out = self.at[slot]
        left = np.flatnonzero((self.slots[slot] != keys) & (out >= 0))
        out[left] = -1
        for step in range(1, self.steps):
            if not len(left):
                break
            s = (slot[left] + step) & (len(self.at) - 1)
            hit = (self.at[s] >= 0) & (self.slots[s] == keys[left])
            out[left[hit]] = self.at[s[hit]]
            left = left[~hit & (self.at[s] >= 0)]
        return out


def find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Positions of keys in a sorted table, -1 where there is none; quick for sorted keys."""
    if not len(table):
        return np.full(len(keys), -1)
    at = np.searchsorted(table, keys)
    at[at == len(table)] = 0
    at[table[at] != keys] = -1
    return at


class Model:
    """The trie of sorted (codes, counts) as sorted arrays by order; ``given`` are the codes and counts of some orders, where they don't follow from the longest.

    An order has 16 bytes for each code (the longest keeps the arrays it was given) and 28 for each context, so 2^22 codes stay below 300 MB.
    """

    def __init__(self, codes: np.ndarray, counts: np.ndarray, order: int, given: dict[int, tuple[np.ndarray, np.ndarray]] | None = None):
        self.order = order
        nodes = {order: (codes, counts)}
        for k in range(order - 1, -1, -1):
            nodes[k] = given[k] if given and k in given else add_up(nodes[k + 1][0] & mask(k + 1), nodes[k + 1][1])
        self.levels: list[dict] = []
        for k in range(order + 1):
            code, n = nodes.pop(k)
            ctx = code >> U64(SHIFT)
            first = np.flatnonzero(np.concatenate([[True], ctx[1:] != ctx[:-1]])) if len(ctx) else np.zeros(0, np.int64)
            ctx = ctx[first]
            level = {"code": code, "c": n, "ctx": ctx, "n": np.add.reduceat(n, first) if len(n) else n, "d": np.diff(np.append(first, len(code))).astype(np.int16)}
            if k and len(ctx):
                below = self.levels[-1]
                offered = below["c"][find(below["code"], code & mask(k))]
                up = find(below["ctx"], ctx & mask(k - 1) if k > 1 else np.zeros(len(ctx), U64))
                level["n_left"] = below["n"][up] - np.add.reduceat(offered, first)
                level["d_left"] = below["d"][up] - level["d"]
            self.levels.append(level)
        self.unseen = -np.log10(max(1.0, SYMBOLS - (len(self.levels[0]["c"]))))

    def holds(self, codes: np.ndarray) -> np.ndarray:
        """Whether each code's longest context is here, with all its symbols."""
        return find(self.levels[self.order]["ctx"], codes >> U64(SHIFT)) >= 0

    def log10(self, code: np.ndarray) -> np.ndarray:
        """log10 of the probability of each code's symbol after its context; quickest for sorted codes."""
        value = np.zeros(len(code))
        child = np.full(len(code), -1)
        todo = np.arange(len(code))
        for k in range(self.order, -1, -1):
            level = self.levels[k]
            ctx = find(level["ctx"], (code[todo] & mask(k + 1)) >> U64(SHIFT))
            seen = ctx >= 0
            t, c = todo[seen], ctx[seen]
            if len(t):
                n, d, ch = level["n"][c].astype(float), level["d"][c].astype(float), child[t]
                after = ch >= 0
                if after.any():
                    n[after], d[after] = self.levels[k + 1]["n_left"][ch[after]], self.levels[k + 1]["d_left"][ch[after]]
                node = find(level["code"], code[t] & mask(k + 1))
                hit = node >= 0
                value[t[hit]] += np.log10(level["c"][node[hit]] / (n[hit] + d[hit]))
                esc = ~hit & (d > 0)
                value[t[esc]] += np.log10(d[esc] / (n[esc] + d[esc]))
                child[t] = c
                gone = np.zeros(len(todo), bool)
                gone[np.flatnonzero(seen)[hit]] = True
                todo = todo[~gone]
        value[todo] += self.unseen
        return value


_models: dict[str, tuple] = {}


def _scoring(sent):
    def score(batches):
        if sent.value["id"] not in _models:
            _models.clear()
            v = sent.value
            _models[v["id"]] = Model(v["codes"], v["counts"], v["order"], v["given"]), Lookup(v["head"]), np.log10(v["head_n"] + 1.0)
        model, head, head_log = _models[sent.value["id"]]
        key = TaskContext.get().partitionId() << 40
        for batch in batches:
            for rows, data, at in slices(batch, "text"):
                codes, by = codes_of(data, at, model.order)
                once, of = np.unique(codes, return_inverse=True)  # each code of a slice is looked up once
                value = model.log10(once)
                if sent.value["given"] is None:
                    away = np.zeros(0, np.int64)
                else:
                    here = model.holds(once)
                    value[~here] = 0.0
                    away = np.flatnonzero(~here[of])
                value = value[of]
                asked, times, asked_by = _by_row(codes[away], np.searchsorted(by, away, side="right") - 1, rows.num_rows)
                starts, ends, words = word_bounds(data, at)
                h = word_hashes(data, starts, ends)
                pos = head.find(h)
                known = pos >= 0
                logs = np.where(known, head_log[pos] if len(head_log) else 0.0, 0.0)
                sums = np.concatenate([[0.0], np.cumsum(logs)])
                n_known = np.concatenate([[0], np.cumsum(known)])
                rest = h[~known].view(np.int64)
                tail = (words - n_known[words]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(key, key + rows.num_rows)), rows.column("doc_id").cast(pa.int64()), rows.column("held_out"), pa.array(np.diff(words) + 1),
                        pa.array(np.diff(n_known[words])), pa.array(np.diff(sums[words])), pa.array(np.add.reduceat(value, by[:-1])), pa.ListArray.from_arrays(pa.array(tail), pa.array(rest)),
                        pa.ListArray.from_arrays(asked_by, asked), pa.ListArray.from_arrays(asked_by, times),
                    ],
                    ["row", "doc_id", "held_out", "n_tokens", "head_known", "head_log", "score", "tail", "asked", "times"],
                )
                key += rows.num_rows

    return score


_SCORED = "row long, doc_id long, held_out boolean, n_tokens long, head_known long, head_log double, score double, tail array<long>, asked array<long>, times array<long>"


def _by_row(codes: np.ndarray, row: np.ndarray, n_rows: int) -> tuple[pa.Array, pa.Array, pa.Array]:
    """The distinct codes of each row and how often each stands there, and n_rows + 1 offsets."""
    order = np.lexsort((codes, row))
    codes, row = codes[order], row[order]
    first = np.flatnonzero(np.concatenate([[True], (codes[1:] != codes[:-1]) | (row[1:] != row[:-1])])) if len(codes) else np.zeros(0, np.int64)
    offsets = np.searchsorted(row[first], np.arange(n_rows + 1)).astype(np.int32)
    return pa.array(codes[first].view(np.int64)), pa.array(np.diff(np.append(first, len(codes))).astype(np.int64)), pa.array(offsets)


def _pack(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([b.column(c).to_numpy(zero_copy_only=False).astype("<i8").tobytes()], pa.binary()) for c in ("key", "n")], ["key", "n"])


def _gather(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of a table of bounded size, sent as bytes."""
    got = counts.select("key", "n").mapInArrow(_pack, "key binary, n binary").collect()
    keys = np.frombuffer(b"".join(bytes(r.key) for r in got), "<i8")
    order = np.argsort(keys)
    return keys[order].view(U64), np.frombuffer(b"".join(bytes(r.n) for r in got), "<i8")[order]


def _folded(trie: DataFrame, k: int) -> DataFrame:
    """The codes of order k and their counts."""
    return trie.groupBy(F.col("key").bitwiseAND(F.lit(int(mask(k + 1)))).alias("key")).agg(F.sum("n").alias("n"))


def _frequent(trie: DataFrame, order: int, store: Store) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Codes and counts by order: all up to ``LOW``, above it those of the contexts met often enough to be sent."""
    given = {k: _gather(_folded(trie, k)) for k in range(LOW + 1)}
    size = F.floor(F.log2("total"))
    contexts, codes = {}, {}
    for k in range(LOW + 1, order + 1):
        nodes = F.collect_list(F.struct("key", "n")).alias("nodes")  # at most SYMBOLS of them
        contexts[k] = store.keep(_folded(trie, k).groupBy(F.shiftrightunsigned("key", SHIFT).alias("ctx")).agg(F.sum("n").alias("total"), nodes), f"contexts{k}")
        for r in contexts[k].groupBy(size.alias("size")).agg(F.sum(F.size("nodes")).alias("codes")).collect():
            codes[r["size"]] = codes.get(r["size"], 0) + r["codes"]
    least, taken = max(codes, default=0) + 1, 0
    for s in sorted(codes, reverse=True):
        taken += codes[s]
        if taken > MAX_NODES:
            break
        least = s
    for k, own in contexts.items():
        given[k] = _gather(own.where(size >= least).select(F.explode("nodes").alias("x")).select("x.*"))
    return given


def _answering(sent, order: int):
    """Log probabilities of the asked codes of one group, which holds all codes of the trie that end in the same contexts; of contexts that were split, with the codes one byte shorter (``low``)."""

    def answer(nodes: pa.Table, asked: pa.Table) -> pa.Table:
        key, n, low = (nodes.column(c).to_numpy() for c in ("key", "n", "low"))
        key, n, given = key.astype(np.int64).view(U64), n.astype(np.int64), sent.value
        if low.any():
            given = given | {LOW + 1: add_up(key[low], n[low])}
        model = Model(*add_up(key[~low], n[~low]), order, given)
        codes = np.sort(asked.column("key").to_numpy().astype(np.int64).view(U64)).view(np.int64)
        values = [model.log10(codes[i : i + (1 << 18)].view(U64)) for i in range(0, len(codes), 1 << 18)]
        return pa.table({"key": pa.array(codes), "value": pa.array(np.concatenate([np.zeros(0), *values]))})

    return answer


def _asked(rows: DataFrame, model: dict, trie: DataFrame, store: Store) -> DataFrame:
    """For each row the log probabilities of the codes that what was sent can't tell: (row, asked_log).

    Codes meet the trie in groups by a hash of the last ``LOW`` + 1 bytes of their contexts. Where so many codes end alike that they would be more than a group's, they are dealt by one byte more,
    which leaves at most 257 x 257 codes together; what their contexts escape to, codes one byte shorter, at most 257 for each such ending, goes along to each of its groups.
    """
    groups = max(1, -(-trie.count() // GROUP_NODES))
    ends = lambda k: F.shiftrightunsigned("key", SHIFT).bitwiseAND(F.lit(int(mask(k))))
    crowded = trie.groupBy(ends(LOW + 1).alias("end")).agg(F.count("*").alias("codes")).where(F.col("codes") > GROUP_NODES).select("end", F.lit(True).alias("split"))
    crowded = store.keep(crowded, "crowded")
    few = F.broadcast(crowded) if crowded.count() <= MAX_NODES >> 2 else crowded  # one for each GROUP_NODES codes at most
    own = F.when(F.col("split"), groups + F.pmod(F.xxhash64(ends(LOW + 2)), F.lit(groups))).otherwise(F.pmod(F.xxhash64("end"), F.lit(groups))).alias("own")
    dealt = lambda df: df.withColumn("end", ends(LOW + 1)).join(few, "end", "left")
    sent = rows.sparkSession.sparkContext.broadcast({k: model["given"][k] for k in range(LOW + 1)})
    asked = rows.select("row", F.explode(F.arrays_zip("asked", "times")).alias("x")).select("row", F.col("x.asked").alias("key"), F.col("x.times").alias("times"))
    once = dealt(asked.select("key").distinct()).select("key", "end", "split", own)
    if model["order"] > LOW + 1:
        codes = dealt(trie).select("key", "n", "end", "split", own)
        shorter = codes.where("split").groupBy("end", F.col("key").bitwiseAND(F.lit(int(mask(LOW + 2)))).alias("key")).agg(F.sum("n").alias("n"))
        along = codes.select("end", "own", "split").union(once.select("end", "own", "split")).where("split").select("end", "own").distinct().join(shorter, "end").select("key", "n", "own", F.lit(True).alias("low"))
        nodes = codes.select("key", "n", "own", F.lit(False).alias("low")).union(along)
    else:
        nodes = dealt(trie).select("key", "n", own, F.lit(False).alias("low"))
    values = nodes.groupBy("own").cogroup(once.select("key", "own").groupBy("own")).applyInArrow(_answering(sent, model["order"]), "key long, value double")
    return asked.join(store.keep(values, "asked"), "key").groupBy("row").agg(F.sum(F.col("times") * F.col("value")).alias("asked_log"))


def train(docs: DataFrame, store: Store, order: int = ORDER) -> tuple[dict, DataFrame, DataFrame]:
    """The codes and counts to be sent to tasks, with the head of the words; the tables of all word counts and of all codes of the trie (key, n)."""
    partial = docs.select("text").mapInArrow(released(_counting(order)), "kind int, key long, n long")
    counts = store.keep(partial.groupBy("kind", "key").agg(F.sum("n").alias("n")), "counts")
    trie = counts.where("kind = 0").select("key", "n")
    given = _frequent(trie, order, store) if order > LOW and trie.count() > MAX_NODES else None
    words = counts.where("kind = 1").select("key", "n")
    size = F.floor(F.log2("n") * 16)
    by_size = sorted(((r.size, r.words, r.n) for r in words.groupBy(size.alias("size")).agg(F.count("*").alias("words"), F.sum("n").alias("n")).collect()), reverse=True)
    least, taken = None, 0
    for s, w, _ in by_size:
        if taken + w > HEAD:
            break
        least, taken = s, taken + w
    n_docs = sum(r.n for r in counts.where("kind = 2").collect())
    codes, code_n = _gather(trie) if given is None else given[order]
    head, head_n = _gather(words.where(size >= least) if least is not None else words.limit(0))
    return {
        "order": order, "codes": codes, "counts": code_n, "given": given, "head": head, "head_n": head_n,
        "tokens": sum(n for *_, n in by_size) + n_docs, "distinct": sum(w for _, w, _ in by_size) + (n_docs > 0), "docs": n_docs,
    }, words, trie


def score(docs: DataFrame, model: dict, words: DataFrame, trie: DataFrame, store: Store) -> DataFrame:
    """Scores of each row of docs (doc_id, text, held_out)."""
    sent = docs.sparkSession.sparkContext.broadcast(model | {"id": store.folder})
    rows = store.keep(docs.select("doc_id", "text", "held_out").mapInArrow(released(_scoring(sent)), _SCORED), "scored")
    tail = rows.select("row", F.explode("tail").alias("key")).join(words.withColumnRenamed("n", "c"), "key", "left")
    tail = tail.groupBy("row").agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + 1.0)).alias("tail_log"), F.count("c").alias("tail_known"))
    if model["given"] is not None:
        tail = tail.join(_asked(rows, model, trie, store), "row", "full")
    else:
        tail = tail.withColumn("asked_log", F.lit(0.0))
    end = float(np.log10(model["docs"] + 1.0))
    floor = float(np.log10(model["tokens"] + model["distinct"] + 1.0))
    return rows.join(tail, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("head_known") + F.coalesce("tail_known", F.lit(0)) + F.lit(int(model["docs"] > 0))).alias("n_known"),
        F.lit(int(model["tokens"])).cast("long").alias("train_tokens"),
        (F.col("head_log") + F.coalesce("tail_log", F.lit(0.0)) + F.lit(end) - F.col("n_tokens") * F.lit(floor)).alias("base_score"),
        (F.col("score") + F.coalesce("asked_log", F.lit(0.0))).alias("score"),
    )


def op1_lm_ppm(spark, sf_dir: str) -> DataFrame:
    store = Store(spark, "ppm")
    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(7)) == 2
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", held.alias("held_out"))
    model, words, trie = train(docs.where("not held_out"), store)
    return score(docs, model, words, trie, store)
