"""SentencePiece models on the tokenizers library: parse the model file, rebuild it, encode, decode, verify.

``read_model`` reads the protobuf by hand. ``rebuild`` makes a tokenizers pipeline of it: the normaliser (its compiled
character map, white-space rules and the metaspace marker), then a unigram model with the pieces' scores or, for a BPE
model, merges ranked by them, with byte fallback; and the decoder. If no piece holds the marker behind another character,
no merge or piece can cross from one word to the next, so words are encoded apart and remembered.

Batches are encoded on ``THREADS`` threads. The ids returned are the rebuilt pipeline's. All that is encoded is also encoded by the sentencepiece
library itself: ``parity`` says whether the two agree for a text, and where they don't, the library's ids are returned instead. ``round_trip`` says whether decoding
the ids gives the text back (models that normalise or drop white space may rightly say no).

Each row is worked on by itself: no shuffle; models are loaded once in each Python worker.

Edge cases: a null or empty text has no ids, parity and round_trip are true; its ids are an empty array. Repeated rows and null ids each give a
row, an empty table none; columns other than the two named are not looked at.
"""

from __future__ import annotations

import itertools
import os
import re
import struct
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from evalmill.llm._text import released, slices

MODEL = "piece_bpe_32k.model"
THREADS = 2
MARK = "▁"
REMEMBERED = 64 << 20
#: Ids decoded together; the list of one row is never cut.
DECODED = 1 << 18
#: Words put end to end in a text, and words learnt in a call: threads share a call's texts.
_JOINED, _LEARNT = 128, 1 << 14
_KEPT = 1 << 16
_WORDS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)
UNIGRAM, BPE = 1, 2
_loaded: dict = {}


def _fields(raw: bytes):
    """(number, value) of each field of a protobuf message."""
    i = 0

    def number() -> int:
        nonlocal i
        value = shift = 0
        while True:
            c = raw[i]
            i += 1
            value |= (c & 127) << shift
            shift += 7
            if c < 128:
                return value

    while i < len(raw):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or number()
            yield key >> 3, raw[i : i + size]
            i += size


def read_model(raw: bytes) -> dict:
    """Pieces as (text, score, kind), and what encoding needs of the trainer's and normaliser's settings."""
    out: dict = {"pieces": [], "kind": UNIGRAM, "bytes": False, "charsmap": b"", "prefix": True, "squeeze": True, "escape": True, "suffix": False}
    for field, value in _fields(raw):
        if field == 1:
            piece = dict(_fields(value))
            out["pieces"].append((piece.get(1, b"").decode(), struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0], piece.get(3, NORMAL)))
        elif field == 2:
            trainer = dict(_fields(value))
            out |= {"kind": trainer.get(3, UNIGRAM), "bytes": bool(trainer.get(35, 0)), "suffix": bool(trainer.get(24, 0))}
        elif field == 3:
            norm = dict(_fields(value))
            out |= {"charsmap": norm.get(2, b""), "prefix": bool(norm.get(3, 1)), "squeeze": bool(norm.get(4, 1)), "escape": bool(norm.get(5, 1))}
    return out


def merges(pieces: list[tuple[str, float, int]]) -> list[tuple[str, str]]:
    """All pairs of pieces that make a piece, best made piece first."""
    ids = {p: i for i, (p, _, kind) in enumerate(pieces) if kind in (NORMAL, USER)}
    found = []
    for piece, i in ids.items():
        for cut in range(1, len(piece)):
            left, right = piece[:cut], piece[cut:]
            if left in ids and right in ids:
                found.append((-pieces[i][1], i, ids[left], ids[right], left, right))
    return [(left, right) for *_, left, right in sorted(found)]


def splits_at_marks(model: dict) -> bool:
    """Whether no piece holds the marker behind another character."""
    return all(MARK not in p.lstrip(MARK) for p, _, kind in model["pieces"] if kind in (NORMAL, USER))


def rebuild(model: dict, normalise: bool = True):
    """The model as a tokenizers.Tokenizer."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    pieces = model["pieces"]
    unknown = next((i for i, p in enumerate(pieces) if p[2] == UNKNOWN), None)
    if model["suffix"] or model["kind"] not in (UNIGRAM, BPE):
        raise ValueError("only unigram and BPE models with the marker before words are supported")
    if model["kind"] == BPE:
        core = models.BPE(vocab={p: i for i, (p, *_) in enumerate(pieces)}, merges=merges(pieces), unk_token=pieces[unknown][0] if unknown is not None else None, fuse_unk=True, byte_fallback=model["bytes"], cache_capacity=1 << 17)
    else:
        core = models.Unigram([(p, s) for p, s, _ in pieces], unknown, model["bytes"])
    out = Tokenizer(core)
    steps = [normalizers.Precompiled(model["charsmap"])] if model["charsmap"] else []
    if model["squeeze"]:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Strip(left=True, right=True)]
    mark = MARK if model["escape"] else " "
    steps += [normalizers.Prepend(mark)] if model["prefix"] else []
    steps += [normalizers.Replace(" ", MARK)] if model["escape"] else []
    if steps and normalise:
        out.normalizer = normalizers.Sequence(steps)
    if splits_at_marks(model):
        out.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*|[^{MARK}]+"), "isolated")
    own = [AddedToken(p, normalized=False, special=False) for p, _, kind in pieces if kind == USER]
    if own:
        out.add_tokens(own)
    undo = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
    out.decoder = decoders.Sequence(undo + ([decoders.Strip(" ", 1, 0)] if model["prefix"] else []))
    return out


def load(name: str, threads: int = THREADS) -> Backend:
    """Both libraries' forms of a public model or a path, kept in this process."""
    if name not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        import public_tokenizers

        with open(name if os.path.isabs(name) else public_tokenizers.path(name), "rb") as f:
            _loaded[name] = Backend(f.read())
    return _loaded[name]


class Backend:
    """Encodes and verifies with both libraries.

    Where no piece crosses from word to word and the normaliser only marks spaces, a text's ids are its words' ids end to end, in
    both libraries. So each distinct word is encoded, decoded and compared once while it is remembered (up to ``REMEMBERED`` bytes of
    words), and a text has parity if all of its words have. Other models encode and compare whole texts.
    """

    def __init__(self, raw: bytes):
        import sentencepiece

        model = read_model(raw)
        self.ours, self.theirs = rebuild(model), sentencepiece.SentencePieceProcessor(model_proto=raw)
        self.by_word = model["prefix"] and model["escape"] and not model["squeeze"] and not model["charsmap"] and splits_at_marks(model) and all(p[2] != USER for p in model["pieces"])
        self.bare = rebuild(model, normalise=False) if self.by_word else None
        self.sizes = np.array([1 if kind == BYTE else len(p.encode()) for p, _, kind in model["pieces"]])
        self.words: dict[str, int] = {}
        self.flat, self.first, self.good, self.held = array("i"), array("q", [0]), array("b"), 0

    def forget(self):
        """Keeps the ``_KEPT`` words met first, among which are nearly all frequent ones."""
        n = min(_KEPT, len(self.good))
        self.words = dict(itertools.islice(self.words.items(), n))
        self.flat, self.first, self.good = self.flat[: self.first[n]], self.first[: n + 1], self.good[:n]
        self.held = sum(map(len, self.words)) * 2 + 160 * n

    def learn(self, fresh: list[str]):
        """Encodes, decodes and compares words, each beginning with the marker.

        Words go through both libraries and the decoder end to end, ``_JOINED`` of them in a text, and are told apart by their lengths; where the two
        libraries differ or the text does not come back, and for words of markers only, each word goes by itself.
        """
        alone = [w for w in fresh if not w.strip(MARK)]
        rest = [w for w in fresh if w.strip(MARK)]
        joined = ["".join(rest[i : i + _JOINED]) for i in range(0, len(rest), _JOINED)]
        ours = [e.ids for e in self.bare.encode_batch_fast(joined, add_special_tokens=False)]
        theirs = self.theirs.encode([j[1:].replace(MARK, " ") for j in joined], num_threads=THREADS)
        back = self.ours.decode_batch(ours, skip_special_tokens=False)
        for i, (text, a, b) in enumerate(zip(joined, ours, theirs, strict=True)):
            words = rest[i * _JOINED : (i + 1) * _JOINED]
            ends = np.cumsum([len(w.encode()) for w in words])
            places = np.cumsum(self.sizes[a]) if a else np.zeros(0, np.int64)
            cut = np.searchsorted(places, ends)
            if a == b and back[i] == text[1:].replace(MARK, " ") and len(places) and places[-1] == ends[-1] and (places[cut] == ends).all():
                self.words.update(zip(words, range(len(self.good), len(self.good) + len(words)), strict=True))
                self.first.extend((len(self.flat) + cut + 1).tolist())
                self.flat.extend(a)
                self.good.extend([3] * len(words))
            else:
                alone += words
        for word in alone:
            bare = word[1:].replace(MARK, " ")
            a = self.bare.encode(word, add_special_tokens=False).ids
            b = [self.theirs.piece_to_id(MARK)] if word == MARK else self.theirs.encode(bare)
            self.words[word] = len(self.good)
            ids = a if a == b else b
            self.flat.extend(ids)
            self.first.append(len(self.flat))
            self.good.append((a == b) + 2 * (self.ours.decode(ids, skip_special_tokens=False) == bare))
        self.held += sum(map(len, fresh)) * 2 + 160 * len(fresh)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[bool], list[bool]]:
        """(ids end to end, numbers of ids, parity, round trip) of the texts."""
        if not self.by_word:
            ours = [e.ids for e in self.ours.encode_batch_fast(texts, add_special_tokens=False)]
            theirs = self.theirs.encode(texts, num_threads=THREADS)
            parity = [a == b for a, b in zip(ours, theirs, strict=True)]
            ids = [a if same else b for a, b, same in zip(ours, theirs, parity, strict=True)]
            back = self.ours.decode_batch(ids, skip_special_tokens=False)
            flat = np.concatenate([np.zeros(0, np.int32), *(np.array(k, np.int32) for k in ids)])
            return flat, np.array([len(k) for k in ids]), parity, [a == b for a, b in zip(texts, back, strict=True)]
        split = [_WORDS.findall((" " + t).replace(" ", MARK)) if t else [] for t in texts]
        if self.held > REMEMBERED:
            self.forget()
        fresh = [w for w in set().union(*split) if w not in self.words]
        for i in range(0, len(fresh), _LEARNT):
            self.learn(fresh[i : i + _LEARNT])
        words = np.concatenate([[0], np.cumsum([len(ws) for ws in split])])
        at = np.fromiter(map(self.words.__getitem__, itertools.chain.from_iterable(split)), np.int64, words[-1])
        first, flat, good = np.array(self.first), np.array(self.flat, dtype=np.int32), np.array(self.good)
        n = first[at + 1] - first[at]
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = flat[np.repeat(first[at] - ends[:-1], n) + np.arange(ends[-1])]
        bad = [np.concatenate([[0], np.cumsum(good[at] & bit == 0)])[words] for bit in (1, 2)]
        parity, back = (np.diff(x) == 0 for x in bad)
        return ids, np.diff(ends[words]), parity.tolist(), [bool(b) and MARK not in t for b, t in zip(back, texts, strict=True)]


_ENCODED = "doc_id long, token_ids array<int>, n_tokens long, parity boolean, round_trip boolean"


def _encoding(name: str):
    def encode(batches):
        backend = load(name)
        for batch in batches:
            for rows, *_ in slices(batch, "text", 1 << 20):
                ids, n, parity, back = backend.encode([t or "" for t in rows.column("text").to_pylist()])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), lists, pa.array(n.astype(np.int64)), pa.array(parity, pa.bool_()), pa.array(back, pa.bool_())], ["doc_id", "token_ids", "n_tokens", "parity", "round_trip"])

    return encode


def encode(docs: DataFrame, name: str = MODEL) -> DataFrame:
    """(doc_id, token_ids, n_tokens, parity, round_trip) of each row of docs (doc_id, text)."""
    return docs.select(docs.doc_id.cast("long").alias("doc_id"), "text").mapInArrow(released(_encoding(name)), _ENCODED)


def decode(encoded: DataFrame, name: str = MODEL) -> DataFrame:
    """(doc_id, text) of each row of encoded (doc_id, token_ids); null ids give an empty text."""

    def run(batches):
        ours = load(name).ours
        for batch in batches:
            lists = pc.fill_null(batch.column("token_ids"), [])
            at = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(at, at[lo] + DECODED, side="right")) - 1)
                texts = ours.decode_batch(lists.slice(lo, hi - lo).to_pylist(), skip_special_tokens=False)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(texts, pa.string())], ["doc_id", "text"])
                lo = hi

    return encoded.select("doc_id", "token_ids").mapInArrow(released(run), "doc_id long, text string")


def op5_pieces(spark, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
