"""Benchmark decontamination: every training passage is a BM25 query against the test items.

Items are grouped by length (up to 2^k words). A text is cut into windows of twice that many words, each beginning in the middle of the
one before, so any stretch as long as an item stands whole in a window. A window's score for an item is BM25 with the item as
the document and each distinct word of the window as a query term, divided by the item's score for itself: the weighted share of
the item that the window holds. All items with a share of ``SHARE`` or more are retrieved, exactly: block-max WAND walks the
postings of the window's words and skips items, and whole blocks of ``BLOCK`` items, whose bounds stay below it. Before that, the same
bounds are added up for all windows of a batch at once, over all items and then by block, so that few windows are walked.

What is retrieved is verified on word order: of the three-word shingles of the item's question (all but its last sentence)
and of its answer (the last sentence, or that with words before it up to ``ANSWER_WORDS`` where it is shorter) at least ``QUESTION`` and ``ANSWER``
must stand in the window, or ``WHOLE`` of those of the whole item.

The index is made by Spark from the items: postings once, document frequencies over all items, then the arrays of each shard of about ``SHARD_BYTES`` of item
text in a task of its own, written as a row of a table. The driver holds one shard at a time, to broadcast it: with one shard texts are
searched in the query itself; with more, the texts pass once for each shard, the matches of a pass are written before the
next begins and its broadcast is dropped, and at the end they are joined to the rows. Training texts are shuffled in that last join only.

Edge cases: null, empty and wordless items match nothing; null or empty texts hold nothing. Repeated rows and rows with a null id each get their
matches, repeated items count once, and an item_id with several texts has each of them looked for. No items: no matches. No documents: no rows.
"""

from __future__ import annotations

import pickle
import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalmill.llm._tables import Store
from evalmill.llm._text import U64, released, slices, word_bounds, word_hashes
from evalmill.llm.ppm import Lookup

K1, B = 1.2, 0.75
SHARE, QUESTION, ANSWER, WHOLE = 0.6, 0.5, 0.5, 0.6
ANSWER_WORDS = 8
BLOCK, SHINGLE = 4, 3
_CELLS = 1 << 22
SHARD_BYTES = 16 << 20
_NEAR = 1e-9

_NOT_WORD = np.ones(256, dtype=bool)
_NOT_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def words_of(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word (letters and digits, A-Z lower-cased), and len + 1 offsets by text."""
    starts, ends, by = word_bounds(data, at, _NOT_WORD)
    return word_hashes(data, starts, ends), by


def words_of_text(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    return words_of(raw, np.array([0, len(raw)]))[0]


def question_and_answer(text: str) -> tuple[str, str]:
    """All but the last sentence, and that; one sentence is both."""
    parts = [p for p in re.split(r"(?<=[.?!])\s+", text.strip()) if p]
    return (" ".join(parts[:-1]), parts[-1]) if len(parts) > 1 else (text, text)


def shingles(words: np.ndarray) -> set:
    w = words.tolist()
    n = min(SHINGLE, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()


def overlap(own: np.ndarray, window: np.ndarray) -> float:
    """Share of the shingles of a part's words that stand in the window; 1 for a part without words."""
    want = shingles(own)
    if not want:
        return 1.0
    n, w = min(SHINGLE, len(own)), window.tolist()
    return len(want & {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}) / len(want)


class Index:
    """Postings of the items of one length class; weights are shares of an item's score for itself."""

    def __init__(self, size: int, items: list[tuple[int, str, np.ndarray, np.ndarray]], df: dict[int, int], n_items: int, mean_len: float):
        self.size = size
        self.ids, self.texts = [i[0] for i in items], [i[1] for i in items]
        term, item, weight = [], [], []
        for k, (_, _, terms, tf) in enumerate(items):
            idf = np.log(1 + (n_items - np.array([df[int(t)] for t in terms]) + 0.5) / (np.array([df[int(t)] for t in terms]) + 0.5))
            w = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * tf.sum() / mean_len))
            term.append(terms)
            item.append(np.full(len(terms), k))
            weight.append(w / w.sum())
        term, item, weight = np.concatenate(term), np.concatenate(item), np.concatenate(weight)
        order = np.lexsort((item, term))
        term, self.item, self.weight = term[order], item[order], weight[order]
        self.terms, first = np.unique(term, return_index=True)
        self.first = np.append(first, len(term))
        self.most = np.maximum.reduceat(self.weight, first)
        self.lookup = Lookup(self.terms)
        self.blocks = -(-len(items) // BLOCK)
        spot = np.repeat(np.arange(len(self.terms)), np.diff(self.first)) * self.blocks + self.item // BLOCK
        begin = np.flatnonzero(np.concatenate([[True], spot[1:] != spot[:-1]]))
        self.block_spot, self.block_most = spot[begin], np.maximum.reduceat(self.weight, begin)
        self.block_first = np.searchsorted(self.block_spot // self.blocks, np.arange(len(self.terms) + 1))
        self._parts: dict[int, tuple] = {}

    def parts(self, item: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words of an item's question, answer and whole text."""
        if item not in self._parts:
            question, answer = (words_of_text(part) for part in question_and_answer(self.texts[item]))
            self._parts[item] = question, answer, words_of_text(self.texts[item])
        return self._parts[item]

    def block_bound(self, term: int, block: int) -> float:
        i = np.searchsorted(self.block_spot, term * self.blocks + block)
        return float(self.block_most[i]) if i < len(self.block_spot) and self.block_spot[i] == term * self.blocks + block else 0.0

    def search(self, terms: np.ndarray, share: float = SHARE) -> list[tuple[int, float]]:
        """Block-max WAND: all (item, score) with a score of at least ``share`` for the distinct terms."""
        share -= _NEAR
        lists = [self.item[self.first[t] : self.first[t + 1]].tolist() for t in terms]
        at = [0] * len(lists)
        live = list(range(len(lists)))
        found = []
        while True:
            live = sorted((c for c in live if at[c] < len(lists[c])), key=lambda c: lists[c][at[c]])
            bound, pivot = 0.0, None
            for n, c in enumerate(live):
                bound += float(self.most[terms[c]])
                if bound >= share:
                    pivot = n
                    break
            if pivot is None:
                return found
            item = lists[live[pivot]][at[live[pivot]]]
            while pivot + 1 < len(live) and lists[live[pivot + 1]][at[live[pivot + 1]]] == item:
                pivot += 1
            block = item // BLOCK
            if sum(self.block_bound(terms[c], block) for c in live[: pivot + 1]) < share:
                onward = (block + 1) * BLOCK  # nothing from here to the block's end, or to the next list's item
                if pivot + 1 < len(live):
                    onward = min(onward, lists[live[pivot + 1]][at[live[pivot + 1]]])
                for c in live[: pivot + 1]:
                    at[c] = bisect_left(lists[c], onward, at[c])
            elif lists[live[0]][at[live[0]]] == item:
                score = 0.0
                for c in live[: pivot + 1]:
                    score += float(self.weight[self.first[terms[c]] + at[c]])
                    at[c] += 1
                if score >= share:
                    found.append((item, score))
            else:
                for c in live[:pivot]:
                    at[c] = bisect_left(lists[c], item, at[c])

    def windows(self, words: np.ndarray, by: np.ndarray):
        """(text, begin, end, distinct known terms) of each window that may hold an item."""
        pos = self.lookup.find(words)
        known = np.flatnonzero(pos >= 0)
        if not len(known):
            return
        text = np.searchsorted(by, known, side="right") - 1
        place = (known - by[text]) // self.size  # half window in which a word stands
        lens = np.diff(by)
        halves = np.maximum(1, -(-lens // self.size))
        base = np.concatenate([[0], np.cumsum(halves)])
        # window j of a text has halves j and j + 1
        half = base[text] + place
        own, before = half, np.where(place > 0, half - 1, -1)
        window = np.concatenate([own, before[before >= 0]])
        term = np.concatenate([pos[known], pos[known][before >= 0]]).astype(np.int64)
        rough = np.bincount(window, weights=self.most[term], minlength=base[-1])
        keep = rough[window] >= SHARE - _NEAR
        pair = np.unique(window[keep] * len(self.terms) + term[keep])
        window, term = pair // len(self.terms), pair % len(self.terms)
        if not len(window):
            return
        exact = np.bincount(window, weights=self.most[term], minlength=base[-1])
        keep = exact[window] >= SHARE - _NEAR
        window, term = window[keep], term[keep]
        if not len(window):
            return
        local, w_of = np.unique(window, return_inverse=True)
        cut = np.concatenate([np.searchsorted(w_of, np.arange(len(local))), [len(w_of)]])
        step = max(1, _CELLS // self.blocks)
        for lo in range(0, len(local), step):
            hi = min(len(local), lo + step)
            part = term[cut[lo] : cut[hi]]
            n = self.block_first[part + 1] - self.block_first[part]
            spot = np.repeat(self.block_first[part] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            cell = np.repeat(w_of[cut[lo] : cut[hi]] - lo, n) * self.blocks + self.block_spot[spot] % self.blocks
            sums = np.bincount(cell, weights=self.block_most[spot], minlength=(hi - lo) * self.blocks)
            for k in lo + np.flatnonzero((sums.reshape(hi - lo, self.blocks) >= SHARE - _NEAR).any(axis=1)):
                t = int(np.searchsorted(base, local[k], side="right")) - 1
                begin = int(by[t]) + (int(local[k]) - int(base[t])) * self.size
                yield t, begin, min(begin + 2 * self.size, int(by[t + 1])), term[cut[k] : cut[k + 1]]


def find(indexes: list[Index], data: np.ndarray, at: np.ndarray) -> list[dict]:
    """For each text its verified matches: item_id -> (score, question and answer overlap, first word); the best window of each."""
    words, by = words_of(data, at)
    out: list[dict] = [{} for _ in range(len(at) - 1)]
    for index in indexes:
        for t, begin, end, terms in index.windows(words, by):
            for item, score in index.search(terms):
                question, answer, whole = index.parts(item)
                q, a = overlap(question, words[begin:end]), max(overlap(part, words[begin:end]) for part in (answer, whole[-max(len(answer), ANSWER_WORDS) :]))
                if (q >= QUESTION and a >= ANSWER) or overlap(whole, words[begin:end]) >= WHOLE:
                    match = (round(score, 6), round(q, 6), round(a, 6), begin - int(by[t]))
                    out[t][index.ids[item]] = max(out[t].get(index.ids[item], match), match)
    return out


def _postings(batches):
    for batch in batches:
        rows = []
        for number, text in zip(batch.column("number").to_pylist(), batch.column("text").to_pylist(), strict=True):
            terms, tf = np.unique(words_of_text(text), return_counts=True)
            rows += [(number, int(t), int(n)) for t, n in zip(terms.view(np.int64), tf, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], ["number", "term", "tf"])


def _indexing(n_items: int, mean_len: float):
    """The indexes by length class of one shard, pickled, from its items and their postings."""

    def index(items: pa.Table, posts: pa.Table) -> pa.Table:
        number, term, tf, df = (posts.column(c).to_numpy() for c in ("number", "term", "tf", "df"))
        order = np.lexsort((term.view(U64), number))
        number, term, tf = number[order], term[order].view(U64), tf[order].astype(float)
        freq = dict(zip(term.tolist(), df[order].tolist(), strict=True))
        by_size: dict[int, list] = {}
        for n, item_id, text in sorted(zip(*(items.column(c).to_pylist() for c in ("number", "item_id", "text")), strict=True), key=lambda r: (r[1], r[2])):
            lo, hi = np.searchsorted(number, (n, n + 1))
            if hi > lo:
                by_size.setdefault(1 << max(3, int(tf[lo:hi].sum() - 1).bit_length()), []).append((item_id, text, term[lo:hi], tf[lo:hi]))
        made = [Index(s, members, freq, n_items, mean_len) for s, members in sorted(by_size.items())]
        return pa.table({"shard": pa.array([items.column("shard")[0].as_py() if items.num_rows else 0], pa.int64()), "payload": pa.array([pickle.dumps(made)], pa.binary())})

    return index


class Shards:
    """The written indexes, a row for each shard."""

    def __init__(self, table: DataFrame, n: int, store: Store):
        self.table, self.n, self.store = table, n, store

    def __len__(self) -> int:
        return self.n

    def load(self, shard: int) -> list[Index]:
        rows = self.table.where(F.col("shard") == shard).select("payload").collect()  # one row, of bounded size
        return pickle.loads(bytes(rows[0].payload)) if rows else []


def build(items: DataFrame, store: Store | None = None) -> Shards:
    """The indexes of the items (item_id, text)."""
    store = store or Store(items.sparkSession, "decontam")
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null and item_id is not null").distinct()
    items = store.keep(items.select(F.monotonically_increasing_id().alias("number"), "*"), "items")  # the numbers are fixed by being written
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-size // SHARD_BYTES))
    posts = store.keep(items.select("number", "text").mapInArrow(_postings, "number long, term long, tf long"), "postings")
    stats = posts.groupBy("number").agg(F.sum("tf").alias("n")).agg(F.count("*").alias("items"), F.coalesce(F.avg("n"), F.lit(1.0)).alias("mean")).first()
    posts = posts.join(posts.groupBy("term").agg(F.count("*").alias("df")), "term")
    shard = F.pmod(F.xxhash64("number"), F.lit(n)).alias("shard")
    both = items.select("*", shard).groupBy("shard").cogroup(posts.select("*", shard).groupBy("shard"))  # about SHARD_BYTES of text in a group
    return Shards(store.keep(both.applyInArrow(_indexing(stats["items"], stats["mean"]), "shard long, payload binary"), "indexes"), n, store)


_MATCH = pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64()), ("first_word", pa.int64())])
_MATCHES = "array<struct<item_id:long,score:double,question_overlap:double,answer_overlap:double,first_word:long>>"


def _searching(sent, names: list[str], result_col: str, all_rows: bool):
    def search(batches):
        for batch in batches:
            for rows, data, at in slices(batch, "text"):
                found = [[{"item_id": i, "score": m[0], "question_overlap": m[1], "answer_overlap": m[2], "first_word": m[3]} for i, m in sorted(new.items())] for new in find(sent.value, data, at)]
                out = pa.RecordBatch.from_arrays([*(rows.column(n) for n in names), pa.array(found, pa.list_(_MATCH))], [*names, result_col])
                yield out if all_rows else out.filter(pa.array([bool(f) for f in found], pa.bool_()))

    return search


def with_matches(docs: DataFrame, shards: Shards, result_col: str = "matches") -> DataFrame:
    """docs with the items each text holds, an array of (item_id, score, question_overlap, answer_overlap, first_word)."""
    context = docs.sparkSession.sparkContext
    docs = docs.drop(result_col)
    if shards.n == 1:
        out = docs.withColumn(result_col, F.array().cast(_MATCHES)).schema
        return docs.mapInArrow(released(_searching(context.broadcast(shards.load(0)), docs.columns, result_col, True)), out)
    key = lambda c, name: docs[c].alias(name) if c == "doc_id" else F.xxhash64(docs[c]).alias(name)
    keyed = docs.select(key("doc_id", "__id"), key("text", "__text"), "text")
    names, schema = ["__id", "__text"], keyed.drop("text").withColumn("__m", F.array().cast(_MATCHES)).schema
    store = Store(docs.sparkSession, "matches")
    parts = []
    for shard in range(shards.n):
        sent = context.broadcast(shards.load(shard))
        parts.append(store.keep(keyed.mapInArrow(released(_searching(sent, names, "__m", False)), schema).dropDuplicates(names), f"shard-{shard}"))
        sent.unpersist()
    found = parts[0]
    for part in parts[1:]:
        found = found.union(part)
    found = found.groupBy(*names).agg(F.array_sort(F.flatten(F.collect_list("__m"))).alias("__m"))  # at most one row for each shard in a group
    here = F.col("__id").eqNullSafe(docs["doc_id"]) & (F.col("__text") == F.xxhash64(docs["text"]))
    out = docs.join(found, here, "left")
    return out.select(*(docs[c] for c in docs.columns), F.coalesce("__m", F.array().cast(_MATCHES)).alias(result_col))


def op2_decontam(spark, sf_dir: str) -> DataFrame:
    shards = build(spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    found = with_matches(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), shards)
    return found.select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.*")
