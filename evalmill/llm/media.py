"""Media payloads kept as content-defined chunks that are stored once, and read back verified.

A text's UTF-8 bytes, filled up with zero bytes to a positive multiple of 64, become the 8-bit samples of a WAV file. A
rolling gear hash over the file's bytes (the last 32 count) cuts it where the hash's top bits are zero, so equal stretches are
cut alike wherever they stand; chunks have ``SMALLEST`` to ``LARGEST`` bytes, about 770 on average. A medium is the ordered list of its chunks'
SHA-256 digests; a chunk's bytes (zstd) are kept once.

Three written tables hold the store: ``lists`` (each document's medium and its digests), ``packs`` (for each document the chunks that occur nowhere else,
end to end in one frame, and references to its other chunks) and ``chunks`` (chunks that occur more than once, by digest). Chunks are deduplicated by
digest in Spark: digests are counted by their first eight bytes, and the repeated ones are told to the tasks as a Bloom filter of ``2 ** FILTER_BITS`` bits. What it doesn't
hold occurs once and is written where it is met; what it holds, false alarms too, is shuffled by digest and written once. So only
repeated chunks move, and a filter that is full only makes more of them move.

To read, packs without references are whole media; of the others, references are joined with the chunk table by digest and all parts meet by
medium. Each medium is checked against its digest, and a difference is an error. Equal files are read back once and
joined to all documents that hold them.

Edge cases: a null or empty text has 64 zero bytes of payload. Repeated rows and null ids each get a row, an empty table has none; columns
other than the two named are not looked at.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalmill.llm._tables import Store
from evalmill.llm._text import BYTE_VALUE, U64, mix, released, slices

BLOCK, RATE = 64, 8000
SMALLEST, LARGEST, CUT_BITS = 1 << 8, 1 << 14, 9
FILTER_BITS = 25
HEADER = 44
GEAR = (BYTE_VALUE >> U64(32)).astype(np.uint32)


def payload_of(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % BLOCK or (0 if raw else BLOCK))


def wav(payload: bytes) -> bytes:
    """One channel of 8-bit samples."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload)) + payload


def samples_of(media: bytes) -> bytes:
    riff, _, kind, _, _, form, channels, _, _, _, bits, mark, size = struct.unpack("<4sI4s4sIHHIIHH4sI", media[:HEADER])
    if (riff, kind, form, channels, bits, mark) != (b"RIFF", b"WAVE", 1, 1, 8, b"data") or len(media) != HEADER + size:
        raise ValueError("not a WAV file of 8-bit samples")
    return media[HEADER:]


def gear(raw: np.ndarray) -> np.ndarray:
    """The rolling hash behind each byte; each sum doubles the bytes that count."""
    h = GEAR[raw]
    for step in (1, 2, 4, 8, 16):
        h[step:] += h[:-step] << np.uint32(step)
    return h


def cuts(media: bytes) -> list[int]:
    """Ends of the chunks."""
    if len(media) <= SMALLEST:
        return [len(media)]
    places = np.flatnonzero(gear(np.frombuffer(media, np.uint8)) >> np.uint32(32 - CUT_BITS) == 0) + 1
    out, here = [], 0
    while len(media) - here > SMALLEST:
        i = np.searchsorted(places, here + SMALLEST)
        here = min(int(places[i]) if i < len(places) else len(media), here + LARGEST, len(media))
        out.append(here)
    return out if here == len(media) else [*out, len(media)]


def chunks_of(media: bytes) -> list[bytes]:
    ends = cuts(media)
    return [media[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def _files(batches):
    for batch in batches:
        for rows, data, at in slices(batch, "text"):
            for i, doc_id in enumerate(rows.column("doc_id").to_pylist()):
                raw = data[at[i] : at[i + 1]].tobytes()
                yield doc_id, len(raw), wav(payload_of(raw))


_LISTS = "doc_id long, n_bytes long, media_sha string, media_bytes long, digests array<binary>"
_PACKS = "media_sha string, places array<int>, sizes array<int>, data binary, other_places array<int>, other_digests array<binary>"
_CHUNKS = "digest binary, data binary"
_ARROW = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<binary>": pa.list_(pa.binary()), "array<int>": pa.list_(pa.int32())}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(x.split() for x in schema.split(", ")), strict=True)
    columns = zip(*rows, strict=True) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(list(c), _ARROW[k]) for c, k in zip(columns, kinds, strict=True)], list(names))


def _batches(rows, schema: str, weight):
    """Rows in batches of about a megabyte."""
    out, size = [], 0
    for row in rows:
        out.append(row)
        size += weight(row) + 64
        if size > 1 << 20:
            yield _batch(out, schema)
            out, size = [], 0
    yield _batch(out, schema)


def _lists(batches):
    rows = ((doc_id, n, hashlib.sha256(media).hexdigest(), len(media), [hashlib.sha256(c).digest() for c in chunks_of(media)]) for doc_id, n, media in _files(batches))
    yield from _batches(rows, _LISTS, lambda r: 32 * len(r[4]))


def bits_of(prefixes: np.ndarray) -> np.ndarray:
    """Four bits of the filter for each digest, by its first eight bytes: len x 4."""
    return np.stack([(mix(prefixes + U64(k)) & U64((1 << FILTER_BITS) - 1)).astype(np.int64) for k in range(4)], axis=1)


def prefixes_of(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), "<u8").reshape(-1, 4)[:, 0]


def repeated(words: np.ndarray, digests: list[bytes]) -> np.ndarray:
    """Whether the filter holds each digest."""
    bits = bits_of(prefixes_of(digests))
    return ((words[bits >> 6] >> (bits & 63).astype(U64)) & U64(1)).all(axis=1)


def _count_prefixes(batches):
    for batch in batches:
        digests = batch.column("digests").flatten().to_pylist()
        if digests:
            k, n = np.unique(prefixes_of(digests).view(np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n)], ["prefix", "n"])


def _mark(batches):
    words = np.zeros(1 << (FILTER_BITS - 6), dtype=U64)
    for batch in batches:
        bits = bits_of(batch.column("prefix").to_numpy().view(U64)).ravel()
        np.bitwise_or.at(words, bits >> 6, U64(1) << (bits & 63).astype(U64))
    at = np.flatnonzero(words)
    for i in range(0, len(at), 1 << 16):
        part = at[i : i + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(words[part].view(np.int64))], ["word", "bits"])


def _pack_words(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([b.column(c).to_numpy(zero_copy_only=False).astype(kind).tobytes()], pa.binary()) for c, kind in (("word", "<i4"), ("bits", "<i8"))], ["word", "bits"])


def filter_of(lists: DataFrame) -> np.ndarray:
    """The Bloom filter of the digests that occur more than once; what reaches the driver has its fixed size."""
    counts = lists.select("digests").mapInArrow(released(_count_prefixes), "prefix long, n long").groupBy("prefix").agg(F.sum("n").alias("n"))
    marked = counts.where("n > 1").select("prefix").mapInArrow(released(_mark), "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    words = np.zeros(1 << (FILTER_BITS - 6), dtype=U64)
    for r in marked.mapInArrow(_pack_words, "word binary, bits binary").collect():
        words[np.frombuffer(bytes(r.word), "<i4")] = np.frombuffer(bytes(r.bits), "<i8").view(U64)
    return words


def _packing(sent):
    def pack(batches):
        import zstandard

        press = zstandard.ZstdCompressor(level=3)

        def rows():
            for _, _, media in _files(batches):
                chunks = chunks_of(media)
                digests = [hashlib.sha256(c).digest() for c in chunks]
                often = repeated(sent.value, digests)
                own = np.flatnonzero(~often).tolist()
                other = np.flatnonzero(often).tolist()
                data = press.compress(b"".join(chunks[i] for i in own)) if own else b""
                yield hashlib.sha256(media).hexdigest(), own, [len(chunks[i]) for i in own], data, other, [digests[i] for i in other]

        yield from _batches(rows(), _PACKS, lambda r: len(r[3]) + 32 * len(r[5]))

    return pack


def _chunking(sent):
    def chunk(batches):
        import zstandard

        press = zstandard.ZstdCompressor(level=3)

        def rows():
            seen: set[bytes] = set()
            for _, _, media in _files(batches):
                chunks = chunks_of(media)
                digests = [hashlib.sha256(c).digest() for c in chunks]
                for i in np.flatnonzero(repeated(sent.value, digests)).tolist():
                    if digests[i] in seen:
                        continue
                    if len(seen) >= 1 << 16:
                        seen.clear()
                    seen.add(digests[i])
                    yield digests[i], press.compress(chunks[i])

        yield from _batches(rows(), _CHUNKS, lambda r: len(r[1]))

    return chunk


def feature_of(payload: bytes) -> str:
    """Whole numbers of the samples about their middle: number, sum, sum of squares, changes of sign."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    return f"n={len(x)};sum={x.sum()};squares={(x * x).sum()};crossings={int(((x[1:] < 0) != (x[:-1] < 0)).sum())}"


_READ = "media_sha string, payload_bytes long, payload_sha256 string, tail_crc32 long, feature string"


def _read_back(batches):
    """Rows (media_sha, parts array of (places, sizes, data)) to what is measured of the media put together from them."""
    import zstandard

    unpack = zstandard.ZstdDecompressor()

    def rows():
        for batch in batches:
            names = batch.column("media_sha").to_pylist()
            for i, name in enumerate(names):
                pieces: dict[int, bytes] = {}
                for part in batch.column("parts")[i].as_py():
                    raw, ends = unpack.decompress(part["data"]) if part["data"] else b"", np.cumsum([0, *part["sizes"]]).tolist()
                    ends[-1] = len(raw)
                    pieces.update((place, raw[a:b]) for place, a, b in zip(part["places"], ends, ends[1:], strict=False))
                media = b"".join(pieces[k] for k in sorted(pieces))
                if hashlib.sha256(media).hexdigest() != name:
                    raise ValueError(f"medium {name} was not read back as it was stored")
                payload = samples_of(media)
                yield name, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), feature_of(payload)

    yield from _batches(rows(), _READ, lambda r: 256)


def store_media(docs: DataFrame, store: Store) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The written store: lists (doc_id, n_bytes, media_sha, media_bytes, digests), packs and chunks (digest, data), each chunk once."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
    lists = store.keep(rows.mapInArrow(released(_lists), _LISTS), "lists")
    sent = docs.sparkSession.sparkContext.broadcast(filter_of(lists))  # of a fixed size
    packs = store.keep(rows.mapInArrow(released(_packing(sent)), _PACKS), "packs")
    chunks = rows.mapInArrow(released(_chunking(sent)), _CHUNKS).groupBy("digest").agg(F.first("data").alias("data"))
    return lists, packs, store.keep(chunks, "chunks")


def read_media(packs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Each distinct medium, put together from its chunks, verified and measured."""
    one = lambda places, sizes: F.struct(places.alias("places"), sizes.alias("sizes"), F.col("data"))
    own = packs.where("size(places) > 0").select("media_sha", F.size("other_places").alias("others"), one(F.col("places"), F.col("sizes")).alias("part"))
    others = packs.select("media_sha", F.explode(F.arrays_zip("other_places", "other_digests")).alias("x")).select("media_sha", F.col("x.other_places").alias("place"), F.col("x.other_digests").alias("digest")).distinct()
    found = others.join(chunks, "digest").select("media_sha", one(F.array("place"), F.array(F.lit(0))).alias("part"))
    several = own.where("others > 0").select("media_sha", "part").union(found).groupBy("media_sha").agg(F.collect_list("part").alias("parts"))  # the chunks of one medium
    whole = own.where("others = 0").select("media_sha", F.array("part").alias("parts"))
    return whole.mapInArrow(released(_read_back), _READ).union(several.mapInArrow(released(_read_back), _READ))


def op9_media(spark, sf_dir: str) -> DataFrame:
    lists, packs, chunks = store_media(spark.read.parquet(f"{sf_dir}/documents.parquet"), Store(spark, "media"))
    own = lists.select("doc_id", "n_bytes", "media_sha", "media_bytes", F.size("digests").cast("long").alias("n_chunks"))  # the digests themselves don't travel
    return own.join(read_media(packs, chunks), "media_sha").select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", F.col("media_sha").alias("media_sha256"), "feature", "n_chunks"
    )
