"""Contamination of training rows by evaluation rows: exact, by id, by output, by n-gram, by embedding, by structure.

The evaluation side is read from a table like the training side; joins are equi-joins on hashes or keys, and Spark broadcasts
a side only below its own size limit.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalmill.functions.grams import gram_hashes
from evalmill.functions.jsonx import fold, keys_at_any_depth
from evalmill.functions.text import stripped
from evalmill.sources.kept import kept


def normalised(text: Column) -> Column:
    """Case-folded, without white space at either end."""
    return stripped(fold(text))


def key_classes(rows: DataFrame, row_id: str, key: Column) -> DataFrame:
    """Membership: (row_id, class), where the class of a key is its smallest id; for looking up what a class holds."""
    own = rows.select(row_id, F.sha2(key, 256).alias("h")).where("h IS NOT NULL")
    return own.join(_classes(own, row_id), "h").select(row_id, "class")


def _classes(hashed: DataFrame, row_id: str) -> DataFrame:
    return hashed.where("h IS NOT NULL").groupBy("h").agg(F.min(row_id).alias("class"), F.count("*").alias("members"))


def exact_leaks(train: DataFrame, train_id: str, evals: DataFrame, eval_id: str, text: str = "text", key=normalised) -> DataFrame:
    """(train_id, class, members): training rows with the normalised text of evaluation rows, joined by its hash.

    Evaluation rows of one text are a class, named by its smallest id, with the number of its members, so copies on both sides don't multiply;
    ``key_classes`` of the evaluation rows has the members.
    """
    a = train.select(F.col(train_id), F.sha2(key(F.col(text)), 256).alias("h"))
    b = evals.select(F.col(eval_id), F.sha2(key(F.col(text)), 256).alias("h"))
    return a.join(_classes(b, eval_id), "h").select(train_id, "class", "members")


def id_leaks(train: DataFrame, train_id: str, evals: DataFrame, eval_id: str) -> DataFrame:
    """Training ids that hold an evaluation id, of any number of parts, as a run of their parts."""
    parts = F.split(F.col(train_id).cast("string"), r"[^A-Za-z0-9]+")
    # the outer transform binds the parts to a variable: as an expression they would be split again for every run
    runs = lambda p: F.flatten(F.transform(
        F.sequence(F.lit(1), F.size(p)),
        lambda n: F.transform(F.sequence(F.lit(1), F.size(p) - n + 1), lambda i: F.array_join(F.slice(p, i, n), "_"))
    ))
    a = train.select(train_id).distinct().select(
        train_id, F.explode(F.array_distinct(F.get(F.transform(F.array(parts), runs), F.lit(0)))).alias("key")
    )
    b = evals.select(eval_id, F.array_join(F.split(F.col(eval_id).cast("string"), r"[^A-Za-z0-9]+"), "_").alias("key")).distinct()
    return a.join(b, "key").select(train_id, eval_id).distinct()


def output_leaks(train: DataFrame, train_id: str, payload: str, responses: DataFrame, response_id: str, response_payload: str) -> DataFrame:
    """(train_id, class, members): training targets equal to evaluation responses, by classes as ``exact_leaks`` has them; payloads are canonical JSON."""
    a = train.select(train_id, F.sha2(payload, 256).alias("h"))
    return a.join(
        _classes(responses.select(response_id, F.sha2(response_payload, 256).alias("h")), response_id), "h"
    ).select(train_id, "class", "members")


def _runs_of_words(text: Column, n: int, of) -> Column:
    """Distinct values of ``of`` over the runs of n lower-cased words; none for shorter texts."""
    words = F.filter(F.split(F.lower(text), r"[\x20\t\n\r\f\x0b]+"), lambda w: w != "")
    runs = lambda w: F.transform(
        F.sequence(F.lit(0), F.greatest(F.size(w) - n, F.lit(0))), lambda i: F.when(F.size(w) >= n, of(F.slice(w, i + 1, n)))
    )
    return F.array_compact(F.array_distinct(F.get(F.transform(F.array(words), runs), F.lit(0))))


def word_ngrams(text: Column, n: int) -> Column:
    """Distinct runs of n lower-cased words, joined by a space; none for shorter texts."""
    return _runs_of_words(text, n, lambda run: F.array_join(run, " "))


#: Hashes of evaluation grams that a task looks up at a time; with more, training texts are read once for each such part.
GRAMS = 1 << 22
_KEY = "array<bigint>"


def _hashed_grams(row_id: str, n: int):
    def work(batches):
        for batch in batches:
            rows, grams = [], []
            for row, h in gram_hashes(batch.column("text"), n):
                rows.append(row)
                grams.append(pa.array(h.view(np.int64)))
            out = pa.ListArray.from_arrays(
                np.cumsum([0, *map(len, grams)]).astype(np.int32), pa.concat_arrays(grams)
            ) if grams else pa.array([], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(row_id).take(pa.array(rows, pa.int64())), out], [row_id, "grams"])

    return work


def _met_grams(row_id: str, n: int, sent, least: int):
    """Texts that have at least ``least`` of the grams sent, with those they have."""

    def work(batches):
        known = sent.value
        for batch in batches:
            rows, grams = [], []
            for row, h in gram_hashes(batch.column("folded"), n):
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                own = h[known[at] == h]
                if len(own) >= least:
                    rows.append(row)
                    grams.append(pa.array(own.view(np.int64)))
            if rows:
                out = pa.ListArray.from_arrays(np.cumsum([0, *map(len, grams)]).astype(np.int32), pa.concat_arrays(grams))
                part = batch.take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(row_id), part.column("text"), out], [row_id, "text", "grams"])

    return work


def _all_hashes(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([batch.column("h").to_numpy().tobytes()], pa.binary())], ["h"])


def ngram_leaks(train: DataFrame, train_id: str, evals: DataFrame, eval_id: str, n: int = 8, least: float = 0.5, text: str = "text") -> DataFrame:
    """Pairs of which at least ``least`` of the evaluation text's n-grams stand in the training text: (train_id, eval_id, common, share).

    Training texts are read once: each is looked up, by hashes of its grams, among the evaluation grams, and only texts that have as many of them as the least demanding evaluation text asks for
    are kept, with those they have; no other gram leaves its task. Then grams are put in order by how many of these texts have them. A pair that counts shares one of the evaluation text's rarest grams, of as many as it
    may lack and one more: on these alone they meet. As equal grams have equal hashes, nothing is lost; what met is compared by the grams themselves.
    """
    spark = train.sparkSession
    id_type = evals.schema[eval_id].dataType.simpleString()
    listed = evals.select(eval_id, F.lower(text).alias("text")).mapInArrow(_hashed_grams(eval_id, n), f"`{eval_id}` {id_type}, grams {_KEY}")
    total = F.size("grams").cast("long")
    marked = kept(
        listed.select(
            eval_id, total.alias("total"), F.greatest(F.lit(1).cast("long"), F.ceil(F.lit(float(least)) * total - 1e-9)).alias("needed"),
            F.explode("grams").alias("h")
        ),
        "eval-grams"
    )
    size, fewest = marked.agg(F.count_distinct("h"), F.coalesce(F.min("needed"), F.lit(1))).first()
    parts = max(1, -(-size // GRAMS))
    found = None
    for k in range(parts):
        own = marked.select("h").distinct() if parts == 1 else marked.where(F.pmod(F.xxhash64("h"), F.lit(parts)) == k).select("h").distinct()
        packed = [np.frombuffer(bytes(r.h), "<i8") for r in own.coalesce(8).mapInArrow(_all_hashes, "h binary").collect()]  # at most about GRAMS hashes
        sent = spark.sparkContext.broadcast(np.sort(np.concatenate([np.zeros(0, np.int64), *packed]).view(np.uint64)) if size else np.zeros(1, np.uint64))
        rows = train.select(train_id, F.col(text).alias("text"), F.lower(text).alias("folded"))
        hits = rows.mapInArrow(
            _met_grams(train_id, n, sent, fewest if parts == 1 else 1),
            f"`{train_id}` {train.schema[train_id].dataType.simpleString()}, text string, grams {_KEY}"
        )
        found = hits if found is None else found.unionByName(hits)
    if parts > 1:
        found = found.groupBy(train_id, "text").agg(F.flatten(F.collect_list("grams")).alias("grams")).where(F.size("grams") >= fewest)  # one text's grams
    found = kept(found.withColumn("row", F.monotonically_increasing_id()), "met-grams")
    one = found.select("row", F.explode("grams").alias("h"))
    often = one.groupBy("h").agg(F.count("*").alias("often"))
    met = marked.join(often, "h")
    order = Window.partitionBy(eval_id).orderBy("often", "h")  # the grams of one evaluation text
    rare = met.withColumns({
        "place": F.row_number().over(order), "there": F.count("*").over(Window.partitionBy(eval_id))
    }).where("place <= there - needed + 1")
    pairs = one.join(rare.select(eval_id, "h"), "h").select("row", eval_id).distinct()
    texts = evals.join(rare.select(eval_id).distinct(), eval_id, "left_semi").select(eval_id, word_ngrams(F.col(text), n).alias("__b"))
    both = pairs.join(found.select("row", train_id, F.col("text")), "row").join(texts, eval_id)
    out = both.withColumn(
        "common", F.size(F.array_intersect(word_ngrams(F.col("text"), n), "__b")).cast("long")
    ).withColumn("share", F.col("common") / F.size("__b"))
    return out.where(F.col("share") >= least).select(train_id, eval_id, "common", "share")


BLOCK_ROWS = 2048


#: Centres, and vectors they are fitted to: a bounded sample, the first by a hash of their ids. More centres make smaller cells.
CENTRES, SAMPLE, TURNS = 64, 4096, 8


def _units(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fitted_centres(sample: list[np.ndarray], n: int = CENTRES) -> dict[int, np.ndarray]:
    """Directions that stand for the sample's, by width: each the mean of those next to it, found in a few turns. They decide what is skipped, never what is found."""
    out = {}
    for width in sorted({len(v) for v in sample}):
        x = _units(np.array([v for v in sample if len(v) == width]))
        rng = np.random.default_rng(width)
        centres = x[rng.choice(len(x), min(n, len(x)), replace=False)]
        for _ in range(TURNS):
            near = (x @ centres.T).argmax(axis=1)
            sums = np.zeros_like(centres)
            np.add.at(sums, near, x)
            some = np.linalg.norm(sums, axis=1) > 1e-9
            centres[some] = _units(sums[some])
        out[width] = centres
    return out


_BLOCK = "cell int, ids binary, data binary, width int, reach double"


def _packed(row_id: str, vector: str, centres: dict[int, np.ndarray]):
    """Vectors to blocks of at most ``BLOCK_ROWS`` about one centre: (cell, ids, values, width, the largest angle to the centre). Zero vectors and nulls are left out; widths without centres have one cell."""
    first = dict(zip(centres, np.cumsum([0, *(len(c) for c in centres.values())]), strict=False))

    def block(cell: int, ids: np.ndarray, x: np.ndarray, reach: float) -> pa.RecordBatch:
        columns = [
            pa.array([cell], pa.int32()), pa.array([ids.astype("<i8").tobytes()]), pa.array([x.astype("<f8").tobytes()]),
            pa.array([x.shape[1]], pa.int32()), pa.array([reach])
        ]
        return pa.RecordBatch.from_arrays(columns, ["cell", "ids", "data", "width", "reach"])

    def pack(batches):
        held: dict[tuple[int, int], list] = {}

        def let_go(key, everything: bool):
            ids, x, angle = (np.concatenate(c) for c in zip(*held.pop(key), strict=True))
            order = np.argsort(angle)  # near ones together: blocks of small reach
            ids, x, angle = ids[order], x[order], angle[order]
            last = len(ids) if everything else len(ids) // BLOCK_ROWS * BLOCK_ROWS
            for lo in range(0, last, BLOCK_ROWS):
                hi = min(lo + BLOCK_ROWS, last)
                yield block(key[1], ids[lo:hi], x[lo:hi], float(angle[hi - 1]))
            if last < len(ids):
                held[key] = [(ids[last:], x[last:], angle[last:])]

        for batch in batches:
            batch = batch.filter(pc.and_(batch.column(row_id).is_valid(), batch.column(vector).is_valid()))
            widths = pc.list_value_length(batch.column(vector)).to_numpy(zero_copy_only=False)
            for width in np.unique(widths[widths > 0]).tolist():
                part = batch.filter(pa.array(widths == width))
                ids, x = part.column(row_id).to_numpy(), part.column(vector).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)
                good = np.isfinite(x).all(axis=1) & x.any(axis=1)
                ids, x = ids[good], x[good]
                if not len(ids):
                    continue
                if width in centres:
                    cos = _units(x) @ centres[width].T
                    near = cos.argmax(axis=1)
                    cells, angle = near + first[width], np.arccos(np.clip(cos[np.arange(len(x)), near], -1, 1))
                else:
                    cells, angle = np.full(len(x), -width), np.full(len(x), np.pi)
                for cell in np.unique(cells).tolist():
                    own = cells == cell
                    held.setdefault((width, cell), []).append((ids[own], x[own], angle[own]))
            for key in [k for k, v in held.items() if sum(len(i) for i, *_ in v) >= 4 * BLOCK_ROWS]:
                yield from let_go(key, False)
        for key in list(held):
            yield from let_go(key, True)

    return pack


def _compared(train_id: str, eval_id: str, least: float):
    """Pairs of two blocks: those near the bound by float32 products, then exactly."""

    def unit(x: np.ndarray) -> np.ndarray:
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    def compare(batches):
        for b in batches:
            for r in b.itertuples():
                if r.width != r.eval_width:
                    continue
                x, y = (unit(np.frombuffer(d, "<f8").reshape(-1, r.width)) for d in (r.data, r.eval_data))
                i, j = np.nonzero(x.astype(np.float32) @ y.astype(np.float32).T >= least - 1e-4)
                cos = np.einsum("ij,ij->i", x[i], y[j])
                keep = cos >= least
                yield pd.DataFrame({
                    train_id: np.frombuffer(r.ids, "<i8")[i[keep]], eval_id: np.frombuffer(r.eval_ids, "<i8")[j[keep]], "cosine": cos[keep]
                })

    return compare


def _blocks_met(train: DataFrame, train_id: str, evals: DataFrame, eval_id: str, vector: str, least: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(training blocks, evaluation blocks, pairs of blocks that may hold a pair near enough), numbered and written."""
    spark = train.sparkSession
    chosen = evals.where(F.col(eval_id).isNotNull() & F.col(vector).isNotNull()).orderBy(F.xxhash64(F.col(eval_id).cast("long")), F.col(eval_id)).limit(SAMPLE).select(F.col(vector).cast("array<double>"))
    sample = [np.array(r[0], dtype=float) for r in chosen.collect() if r[0] and None not in r[0]]
    centres = fitted_centres([v for v in sample if np.isfinite(v).all() and v.any()])
    pack = lambda df, key: df.select(F.col(key).cast("long").alias(key), vector).mapInArrow(_packed(key, vector, centres), _BLOCK)
    blocks = [
        kept(pack(df, key).withColumn("block", F.monotonically_increasing_id()), name) for df, key,
        name in ((train, train_id, "train-blocks"), (evals, eval_id, "eval-blocks"))
    ]
    bound = float(np.arccos(np.clip(least - 1e-9, -1, 1))) + 1e-6
    apart = []  # of each two cells the angle between their centres: CENTRES squared rows for a width
    start = 0
    for c in centres.values():
        angles = np.arccos(np.clip(c @ c.T, -1, 1))
        apart += [(start + i, start + j, float(angles[i, j])) for i in range(len(c)) for j in range(len(c))]
        start += len(c)
    known = spark.createDataFrame(apart, "cell int, other int, angle double") if apart else spark.createDataFrame([], "cell int, other int, angle double")
    a = blocks[0].select("block", "cell", "reach")
    b = blocks[1].select(F.col("block").alias("eval_block"), F.col("cell").alias("other"), F.col("reach").alias("eval_reach"))
    near = a.join(F.broadcast(known), "cell").join(b, "other").where(F.col("angle") - F.col("reach") - F.col("eval_reach") <= bound).select("block", "eval_block")
    odd = a.where("cell < 0").join(b.where("other < 0"), F.col("cell") == F.col("other")).select("block", "eval_block")  # widths that no sampled vector has
    return blocks[0], blocks[1], near.union(odd)


def embedding_leaks(train: DataFrame, train_id: str, evals: DataFrame, eval_id: str, vector: str = "embedding", least: float = 0.9) -> DataFrame:
    """All pairs with a cosine of at least ``least``. Vectors are packed into blocks about the nearest of some centres, in one scan of each side; two blocks are compared, by a matrix product, only if the angle between their
    centres, less the largest angles of their vectors to them, leaves room for a pair: angles obey the triangle inequality, so no pair is lost. Blocks meet by the pairs of their cells; ``blocks_skipped`` tells how many need not.

    Zero vectors, vectors with a value that is no number, and nulls match nothing; vectors of different widths don't match.
    """
    a, b, met = _blocks_met(train, train_id, evals, eval_id, vector, least)
    b = b.select(
        F.col("block").alias("eval_block"), F.col("ids").alias("eval_ids"), F.col("data").alias("eval_data"),
        F.col("width").alias("eval_width")
    )
    pairs = met.join(a.drop("cell", "reach"), "block").join(b, "eval_block").select("ids", "data", "width", "eval_ids", "eval_data", "eval_width")
    return pairs.mapInPandas(_compared(train_id, eval_id, least), f"`{train_id}` long, `{eval_id}` long, cosine double")


def blocks_skipped(train: DataFrame, train_id: str, evals: DataFrame, eval_id: str, vector: str = "embedding", least: float = 0.9) -> DataFrame:
    """One row: how many pairs of blocks there are, how many are compared, and the share of those that are not."""
    a, b, met = _blocks_met(train, train_id, evals, eval_id, vector, least)
    n = a.count() * b.count()
    return met.agg(F.lit(n).cast("long").alias("pairs"), F.count("*").alias("compared"), (1 - F.count("*") / F.lit(max(1, n))).alias("skipped"))


def shared_structure(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """Fingerprints (values of the columns) both suites have, with their counts in either."""
    left, right = a.groupBy(*columns).agg(F.count("*").alias("n_a")), b.groupBy(*columns).agg(F.count("*").alias("n_b"))
    return left.join(right, columns)


def unseen_combinations(evals: DataFrame, train: DataFrame, tools: str = "tools") -> DataFrame:
    """Evaluation rows whose set of tools no training row has."""
    combo = F.array_join(F.array_sort(F.array_distinct(tools)), "+")
    return evals.withColumn("combo", combo).join(train.select(combo.alias("combo")).distinct(), "combo", "left_anti")


#: Keys that only evaluation rows have.
EVAL_KEYS = ("expected_behavior", "success_criteria")


def metadata_leaks(train: DataFrame, train_id: str, payload: str) -> DataFrame:
    """Training rows whose JSON holds an evaluation key at any depth."""
    return train.where(F.arrays_overlap(keys_at_any_depth(payload), F.array(*map(F.lit, EVAL_KEYS)))).select(train_id)
