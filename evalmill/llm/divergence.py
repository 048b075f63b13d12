"""Source divergence audit: how far the sources of a language are apart in their words, in whole numbers.

One ``CountVectorizer`` serves all languages: a term is counted as ``lang term``, so that minDF, a number of documents, holds for each language by itself. vocabSize is the largest integer:
no term is left out for want of room. Where more terms are kept than ``SHARD``, they are dealt into shards by hash and each shard has a vectorizer of its own, one after the other, so that the driver never holds
more than about a shard's vocabulary. Vectors are sparse and exact, and those of a (lang, source) in a slice of texts are made together; they are written, and added up by (lang, source) as a summarizer does, but
sparsely and in whole numbers. Inside a slice of texts terms are told apart by 64-bit hashes.

Pairs of sources are looked at in blocks of ``SOURCES`` sources and ``TERMS`` terms: a task has the shares of two blocks' sources for such terms as any of them has, and adds up the
pairs' differences. Terms that neither block has add the same each, which is multiplied. The number of pairs is what the result has.

Edge cases: null text, lang and source are empty strings, and so groups like others; a group without terms has all its pairs; a language without kept terms has pairs of value 0; an
empty table gives no rows; repeated rows are documents each; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalmill.llm._tables import Store
from evalmill.llm._text import LOWER, SLICE_BYTES, U64, mix, released, slices, utf8, word_bounds, word_hashes

#: Bytes that are in no term: all of ASCII but its letters.
APART = np.array([b < 0x80 and not chr(b).isalpha() for b in range(256)])
MIN_DF, TOP = 10, 10
#: The largest integer: vocabularies have no limit of their own.
VOCABULARY = 2**31 - 1
#: Terms of one vectorizer, about, and parts of them that are put together in rows to fit it.
SHARD, CHUNKS = 1 << 20, 1024
#: Found terms in one row.
LISTED = 1 << 16
_VECTOR = "struct<type:tinyint,size:int,indices:array<int>,values:array<double>>"
SOURCES, TERMS = 64, 1024
SCALE = 1_000_000_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _classes(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the keys in which equal ones stand together, and where in it each kind begins."""
    order = np.argsort(keys)
    ranked = keys[order]
    return order, np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])[: len(keys)])


def _spread(lengths: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For parts of these lengths, laid end to end, the places they begin at counted up: first, first + 1, ..."""
    begin = np.cumsum(lengths) - lengths
    return np.arange(int(lengths.sum())) + np.repeat(first - begin, lengths)


def _named(rows: pa.RecordBatch, data: np.ndarray, row: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Terms as strings, each behind its language and a blank; terms have no blanks, so the last blank parts the two."""
    marks, mark_at = utf8(pc.binary_join_element_wise(rows.column("lang").cast(pa.string()), "", " "))
    ahead, size = np.diff(mark_at)[row], ends - starts
    offsets = np.concatenate([[0], np.cumsum(ahead + size)])
    out = np.empty(int(offsets[-1]), dtype=np.uint8)
    out[_spread(ahead, offsets[:-1])] = marks[_spread(ahead, mark_at[:-1][row])]
    out[_spread(size, offsets[:-1] + ahead)] = LOWER[data[_spread(size, starts)]]
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(offsets), pa.py_buffer(out)).cast(pa.string())


_COUNTED = "lang string, source string, weight long, terms array<string>, found array<struct<term:string,n:long>>"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each slice of texts, rows of two kinds: terms that a (lang, source) has ``weight`` times there, each once; and found terms with the number of the slice's documents that have them."""
    for batch in batches:
        for rows, data, at in slices(batch, "text", 8 * SLICE_BYTES):
            starts, ends, by = word_bounds(data, at, APART)
            if not len(starts):
                continue
            row = np.repeat(np.arange(rows.num_rows), np.diff(by))
            langs, sources = (rows.column(c).cast(pa.string()).dictionary_encode() for c in ("lang", "source"))
            lang, source = (c.indices.to_numpy().astype(np.int64) for c in (langs, sources))
            salt = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in langs.dictionary.to_pylist()], dtype=U64)
            h = mix(word_hashes(data, starts, ends) ^ salt[lang][row])
            order, begin = _classes(mix(h ^ mix(row.astype(U64))))  # a term of a document
            times, at_word = np.diff(np.append(begin, len(order))), order[begin]
            group = (lang * len(sources.dictionary) + source)[row[at_word]]
            order, begin = _classes(mix(h[at_word] ^ mix(group.astype(U64))))  # a term of a group
            weight, documents = np.add.reduceat(times[order], begin), np.diff(np.append(begin, len(order)))
            at_word, group = at_word[order[begin]], group[order[begin]]

            order = np.lexsort((weight, group))
            begin = np.flatnonzero(np.concatenate([[True], (np.diff(group[order]) != 0) | (np.diff(weight[order]) != 0)]))
            some = at_word[order]
            terms = pa.ListArray.from_arrays(pa.array(np.append(begin, len(some)).astype(np.int32)), _named(rows, data, row[some], starts[some], ends[some]))
            of = pa.array(row[some[begin]])
            names = [rows.column(c).cast(pa.string()).take(of) for c in ("lang", "source")]
            none = pa.nulls(len(begin), pa.list_(pa.struct([("term", pa.string()), ("n", pa.int64())])))
            yield pa.RecordBatch.from_arrays([*names, pa.array(weight[order[begin]]), terms, none], ["lang", "source", "weight", "terms", "found"])

            order, begin = _classes(h[at_word])  # a term of a language
            some = at_word[order[begin]]
            found = pa.StructArray.from_arrays([_named(rows, data, row[some], starts[some], ends[some]), pa.array(np.add.reduceat(documents[order], begin))], ["term", "n"])
            found = pa.ListArray.from_arrays(pa.array(np.append(np.arange(0, len(some), LISTED), len(some)).astype(np.int32)), found)
            no = lambda kind, n=len(found): pa.nulls(n, kind)
            yield pa.RecordBatch.from_arrays([no(pa.string()), no(pa.string()), no(pa.int64()), no(pa.list_(pa.string())), found], ["lang", "source", "weight", "terms", "found"])


def _texts(docs: DataFrame) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return docs.select(text("lang"), text("source"), text("text"))


def vectorizer(frequencies: DataFrame, min_df: int) -> CountVectorizerModel:
    """The vectorizer of all terms that at least ``min_df`` documents have, fitted to rows in which each such term (term, n) stands ``min_df`` times, once in a row.

    Rows of an empty term are added, as a vectorizer must not find nothing.
    """
    rows = frequencies.where(F.col("n") >= min_df).select("term", F.explode(F.sequence(F.lit(1), F.lit(min_df))).alias("times"))
    rows = rows.groupBy(F.pmod(F.xxhash64("term"), F.lit(CHUNKS)).alias("chunk"), "times").agg(F.collect_list("term").alias("terms"))  # one of CHUNKS parts of a shard's terms
    blank = frequencies.sparkSession.range(min_df).select(F.array(F.lit("")).alias("terms"))
    return CountVectorizer(inputCol="terms", outputCol="vector", minDF=float(min_df), vocabSize=VOCABULARY).fit(rows.select("terms").union(blank))


def _in_shard(shards: int, shard: int) -> Callable[[Column], Column]:
    return lambda term: F.pmod(F.hash(term), F.lit(shards)) == shard


def group_counts(docs: DataFrame, store: Store, min_df: int = MIN_DF, shard: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """(lang, source, id, count) of kept terms, counts over 0, sums of the slices' sparse vectors; and (id, lang, term), what the ids stand for.

    Texts are read once. The vectorizer learns from how many documents have each term; it looks up a term once for each slice and group that has it. A group's vector is the sum of its rows'
    vectors, each times its weight.
    """
    counted = store.keep(_texts(docs).mapInArrow(released(_counted), _COUNTED), "slices")
    frequencies = counted.select(F.inline("found")).groupBy("term").agg(F.sum("n").alias("n"))
    frequencies = store.keep(frequencies.where(F.col("n") >= min_df), "frequencies")
    n, found, names = max(1, -(-frequencies.count() // shard)), None, None
    weighed = counted.where("weight IS NOT NULL").select("lang", "source", "weight", "terms")
    for k in range(n):
        model = vectorizer(frequencies if n == 1 else frequencies.where(_in_shard(n, k)(F.col("term"))), min_df)
        path = f"{store.folder}/vocabulary-{k}"
        model.write().save(path)
        rows = weighed if n == 1 else weighed.withColumn("terms", F.filter("terms", _in_shard(n, k)))
        store.keep(model.transform(rows).select("lang", "source", "weight", "vector"), f"vectors-{k}")
        vectors = docs.sparkSession.read.schema(f"lang string, source string, weight long, vector {_VECTOR}").parquet(f"{store.folder}/vectors-{k}")
        entries = vectors.select("lang", "source", "weight", F.explode("vector.indices").alias("index"))  # a term is once in a row: all values are 1
        ident = (F.lit(k << 32) + F.col("index")).alias("id")
        sums = entries.groupBy("lang", "source", "index").agg(F.sum("weight").alias("count")).select("lang", "source", ident, "count")
        words = docs.sparkSession.read.parquet(f"{path}/data").select(F.posexplode("vocabulary").alias("index", "word"))
        words = words.select(ident, F.regexp_extract("word", r"(?s)^(.*) ([^ ]*)\z", 1).alias("lang"), F.element_at(F.split("word", " "), -1).alias("term"))
        found, names = (sums, words) if found is None else (found.union(sums), names.union(words))
    return store.keep(found, "counts"), store.keep(names, "names")


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 (count + 2) / (total + 2 kept)), in decimals, as products may be longer than a long."""
    exact = lambda c: c.cast("decimal(38,0)")
    return F.call_function("div", exact(F.lit(SCALE)) * exact(count + 2).cast("decimal(20,0)"), exact(total + 2 * kept)) + 1


def difference(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _pairs(rows: pd.DataFrame) -> pd.DataFrame:
    """Sums of the differences of two blocks' sources over the terms that are here; rows (lang, bi, bj, shard, source, term, p), the term -1 has the share of what a source lacks."""
    head = rows.iloc[0]
    empty, full = rows[rows["term"] < 0].sort_values("source"), rows[rows["term"] >= 0]
    sources = empty["source"].to_numpy()
    terms, at = np.unique(full["term"].to_numpy(), return_inverse=True)
    shares = np.repeat(empty["p"].to_numpy(dtype=np.int64)[:, None], len(terms), axis=1)
    shares[np.searchsorted(sources, full["source"].to_numpy()), at] = full["p"].to_numpy(dtype=np.int64)
    low = sources // SOURCES
    left, right = np.flatnonzero(low == head["bi"]), np.flatnonzero(low == head["bj"])
    out = []
    for a in left:
        others = right[right > a] if head["bi"] == head["bj"] else right
        q = shares[others]
        out.append(pd.DataFrame({"a": sources[a], "b": sources[others], "value": ((shares[a] - q) ** 2 // (shares[a] + q)).sum(axis=1)}))
    made = pd.concat(out, ignore_index=True) if out else pd.DataFrame({"a": [], "b": [], "value": []})
    return made.assign(lang=head["lang"], terms=len(terms))[["lang", "a", "b", "value", "terms"]].astype({"a": "int64", "b": "int64", "value": "int64", "terms": "int64"})


def audit(docs: DataFrame, store: Store | None = None, min_df: int = MIN_DF, top: int = TOP, shard: int = SHARD) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` has every other source of the language, part ``term`` the first ``top`` terms a source has more of than its language."""
    store = store or Store(docs.sparkSession, "divergence")
    counts, names = group_counts(docs, store, min_df, shard)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    langs = counts.groupBy("lang", "id").agg(F.sum("count").alias("count"))
    in_lang = langs.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("count").alias("lang_total"))
    in_group = counts.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    zero = F.lit(0).cast("long")
    groups = docs.select(text("lang"), text("source")).distinct().join(in_group, ["lang", "source"], "left").join(in_lang, "lang", "left").fillna(0, ["total", "kept", "lang_total"])
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1  # the sources of one language
    groups = store.keep(groups.select("lang", "source", "total", "kept", "lang_total", number.cast("long").alias("number"), F.when(F.col("kept") > 0, share(zero, F.col("total"), F.col("kept"))).alias("p0")), "groups")

    shares = counts.join(groups, ["lang", "source"]).withColumn("p", share(F.col("count"), F.col("total"), F.col("kept")))
    shares = store.keep(shares.select("lang", "source", "number", "id", "p", "kept", "lang_total"), "shares")
    above = shares.join(langs.select("id", "count").join(names.select("id", "term"), "id"), "id").withColumn("q", share(F.col("count"), F.col("lang_total"), F.col("kept"))).where("p > q")
    terms = above.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), difference(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    terms = terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)

    blocks = groups.groupBy("lang").agg((F.floor(F.max("number") / SOURCES) + 1).alias("blocks"), F.max("kept").alias("n_kept"))
    shards = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("n_kept") / TERMS))
    entries = shares.join(blocks, "lang").select("lang", "number", F.pmod(F.xxhash64("id"), shards).alias("shard"), F.col("id").alias("term_id"), "p", "blocks")
    lacking = groups.where("kept > 0").join(blocks, "lang").select("lang", "number", F.explode(F.sequence(F.lit(0).cast("long"), shards - 1)).alias("shard"), F.lit(-1).cast("long").alias("term_id"), F.col("p0").alias("p"), "blocks")
    every = entries.select("lang", "number", "shard", "term_id", "p", "blocks").unionByName(lacking)
    own = F.floor(F.col("number") / SOURCES)
    met = every.select("lang", "shard", F.col("number").alias("source"), F.col("term_id").alias("term"), "p", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    met = met.select("lang", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"), "shard", "source", "term", "p")
    sums = met.groupBy("lang", "bi", "bj", "shard").applyInPandas(_pairs, "lang string, a long, b long, value long, terms long")
    sums = sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("terms").alias("terms"))

    one = groups.select("lang", F.col("number").alias("a"), F.col("source").alias("source_a"), F.col("p0").alias("p0_a"), "kept")
    two = groups.select("lang", F.col("number").alias("b"), F.col("source").alias("source_b"), F.col("p0").alias("p0_b"))
    rest = (F.col("kept") - F.col("terms")) * difference(F.col("p0_a"), F.col("p0_b"))
    known = sums.join(one, ["lang", "a"]).join(two, ["lang", "b"]).select("lang", "source_a", "source_b", (F.col("value") + rest).alias("value"))
    nothing = one.where("kept = 0").join(two, "lang").where("a < b").select("lang", "source_a", "source_b", zero.alias("value"))  # pairs that are all in the result
    pairs = known.union(nothing)
    both = F.explode(F.array(F.struct(F.col("source_a").alias("source"), F.col("source_b").alias("item")), F.struct(F.col("source_b").alias("source"), F.col("source_a").alias("item"))))
    pairs = pairs.select("lang", both.alias("x"), "value").select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value").withColumn("rank", F.row_number().over(order))
    return pairs.unionByName(terms).select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank"))


def op12_divergence(spark, sf_dir: str) -> DataFrame:
    """How far sources are apart in their words, over all documents."""
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = rf"""WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
w AS (SELECT id, lang, source, unnest(terms) AS term FROM d), k AS (SELECT lang, term, count(*)::HUGEINT AS c FROM w GROUP BY 1, 2 HAVING count(DISTINCT id) >= {MIN_DF}),
l AS (SELECT lang, count(*)::HUGEINT AS v, sum(c)::HUGEINT AS n FROM k GROUP BY 1), g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT w.lang, w.source, w.term, count(*)::HUGEINT AS c FROM w JOIN k ON w.lang = k.lang AND w.term = k.term GROUP BY 1, 2, 3),
n AS (SELECT g.lang, g.source, coalesce(sum(c.c), 0)::HUGEINT AS n FROM g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY 1, 2),
p AS (SELECT n.lang, n.source, k.term, coalesce(c.c, 0) AS c, 1 + ({SCALE} * (coalesce(c.c, 0) + 2)) // (n.n + 2 * l.v) AS p, 1 + ({SCALE} * (k.c + 2)) // (l.n + 2 * l.v) AS q
  FROM n JOIN l ON l.lang = n.lang JOIN k ON k.lang = n.lang LEFT JOIN c ON c.lang = n.lang AND c.source = n.source AND c.term = k.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
x AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::BIGINT FROM p WHERE c > 0 AND p > q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM x)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= {TOP}"""
