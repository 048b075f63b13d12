"""Token counts of whole texts with a byte-level tokenizer; huge texts are counted from overlapping chunks.

A text of more than ``LONG`` characters is encoded in chunks that overlap: the two
encodings are spliced at a place in the overlap where both have a token boundary with the same tokens beside it and
where the pre-tokenizer must split whatever stands around it: between a letter and a single space before a letter. Left
of it no token can depend on what follows, right of it none on what came before, so the sum is exact. Where the overlap
holds no such place (text without spaces, say) it is widened, at last to all that is left of the chunk; a chunk that can't
be left at all is doubled. Memory is bounded by the longest stretch without a stable place.

Shorter texts are cut at all places that are proven without encoding: before a space behind a visible character, where the
pre-tokenizer must split too (its pieces have a space at their beginning only). Each distinct stretch is encoded once
while it is remembered, by its characters, and a text's count is the sum of its stretches'; of a stretch that ends in a
letter and marks of punctuation, the two parts are counted apart, as the pre-tokenizer parts them.

Both hold for a byte-level pre-tokenizer with its own pattern, no normaliser and no added token that takes or holds white space. That is checked
when a tokenizer is loaded (``provable``); any other one encodes each text whole.

The tokenizer is loaded once in each Python worker. Every row is counted by itself: no shuffle.

Edge cases: a null or empty text has 0 bytes and 0 tokens. Repeated rows and null ids each give a row, an empty table
none; columns other than the two named are not looked at.
"""

from __future__ import annotations

import itertools
import json
import os
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from evalmill.llm._text import released, slices

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 1024
LONG, CHUNK, OVERLAP = 1 << 16, 1 << 15, 512
_WORDS = 1 << 17
#: Stretches a worker remembers, and the longest that is remembered.
_KNOWN, _LONGEST = 1 << 20, 64
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_LETTER = re.compile(f"[{_LETTERS}]")
_CUT = re.compile(f" (?<=[!-~{_LETTERS}] )")
_MARKS = ".,;:!?"
#: Where a stretch is parted into its letters and the marks behind them: no added token may reach over such a place.
_PARTED = re.compile(f"[{_LETTERS}][{re.escape(_MARKS)}]")
_loaded: dict = {}


def provable(tok) -> bool:
    """Whether places can be told where this tokenizer must split."""
    s = json.loads(tok.to_str())
    before = s["pre_tokenizer"] or {}
    plain = s["normalizer"] is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
    return bool(plain) and all(not (t["single_word"] or t["lstrip"] or t["rstrip"] or any(c.isspace() for c in t["content"]) or _PARTED.search(t["content"])) for t in s["added_tokens"])


class Counts:
    """A tokenizer with the numbers of tokens of the stretches it met, each with a space before it."""

    def __init__(self, tok):
        self.tok, self.provable, self.known, self.marks = tok, provable(tok), {}, {"": 0}

    def encoded(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, fresh: set[str]) -> dict[str, int]:
        """Numbers of tokens of stretches that are not known; short ones are remembered."""
        cores = {w: core if (core := w.rstrip(_MARKS)) and _LETTER.match(core[-1]) else w for w in fresh}
        tails = {w[len(core) :] for w, core in cores.items()} - self.marks.keys()
        for tail in tails:
            n = self.encoded([tail])[0]
            if len(self.marks) < _KNOWN:
                self.marks[tail] = n
        new = list({core for core in cores.values() if core not in self.known})
        counts = dict(zip(new, self.encoded([" " + w for w in new]), strict=True))
        out = {}
        for w, core in cores.items():
            n = counts[core] if core in counts else self.known[core]
            tail = w[len(core) :]
            out[w] = n + (self.marks[tail] if tail in self.marks else self.encoded([tail])[0])
        if len(self.known) + len(out) + len(counts) > _KNOWN:
            self.known = dict(itertools.islice(self.known.items(), _KNOWN // 2))  # those met first, the frequent ones among them
        self.known.update((w, n) for w, n in itertools.chain(counts.items(), out.items()) if len(w) <= _LONGEST)
        return out

    def count(self, texts: list[str]) -> list[int]:
        if not self.provable:
            return self.encoded(texts)
        split = [_CUT.split(t) for t in texts]
        fresh = set(itertools.chain.from_iterable(p[1:] for p in split)).difference(self.known)
        known = self.known
        if fresh:
            new = self.learn(fresh)
            if self.known is not known or any(len(w) > _LONGEST for w in new):
                known = {w: n for w in set(itertools.chain.from_iterable(p[1:] for p in split)) if (n := new.get(w, known.get(w))) is not None}
        heads = self.encoded([p[0] for p in split])
        return [head + sum(map(known.__getitem__, p[1:])) for head, p in zip(heads, split, strict=True)]


def counts_of(name: str) -> Counts:
    """The tokenizer of that file, kept in this process, with room to remember more words than by default."""
    if name not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(name if os.path.isabs(name) else public_tokenizers.path(name))
        found.no_truncation()
        found.no_padding()
        if hasattr(found.model, "_resize_cache"):
            found.model._resize_cache(_WORDS)
        _loaded[name] = Counts(found)
    return _loaded[name]


def tokenizer(name: str):
    return counts_of(name).tok


def stable(text: str, p: int) -> bool:
    """Whether a token boundary stands before text[p] in any text that holds these three characters."""
    return text[p] == " " and bool(_LETTER.match(text[p - 1]) and _LETTER.match(text[p + 1]))


class _Chunk:
    def __init__(self, tok, text: str, start: int, end: int):
        self.start, self.end = start, min(end, len(text))
        e = tok.encode(text[start : self.end], add_special_tokens=False)
        self.ids, self.at = e.ids, [a + start for a, _ in e.offsets]
        self.ends = [b + start for _, b in e.offsets]

    def boundaries(self, lo: int, hi: int) -> dict[int, int]:
        """Place -> number of the token that begins there, where the one before ends there."""
        return {p: i for i, p in enumerate(self.at) if i and lo <= p < hi and self.ends[i - 1] == p}


def splice(text: str, left: _Chunk, right: _Chunk) -> tuple[int, int] | None:
    """Numbers of the tokens of left and right that begin at the last stable common boundary."""
    a, b = left.boundaries(right.start + 1, left.end - 1), right.boundaries(right.start + 1, left.end - 1)
    for p in sorted(a.keys() & b.keys(), reverse=True):
        if stable(text, p) and left.ids[a[p]] == right.ids[b[p]] and left.ids[a[p] - 1] == right.ids[b[p] - 1]:
            return a[p], b[p]
    return None


def count_long(tok, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of the whole text."""
    here, first, total = _Chunk(tok, text, 0, chunk), 0, 0
    while here.end < len(text):
        width = overlap
        while True:
            start = max(here.at[first], here.end - width)
            following = _Chunk(tok, text, start, here.end + chunk)
            if met := splice(text, here, following):
                total += met[0] - first
                here, first = following, met[1]
                break
            if start == here.at[first]:  # no place in all of the chunk: a longer one from the same start
                here, first = _Chunk(tok, text, start, here.end + 2 * (here.end - start) + chunk), 0
                if here.end == len(text):
                    break
                width = overlap
                continue
            width *= 4
    return total + len(here.ids) - first


def count_texts(counts: Counts, texts: list[str]) -> list[int]:
    out = [0] * len(texts)
    some = [i for i, t in enumerate(texts) if t and (len(t) <= LONG or not counts.provable)]
    for i, n in zip(some, counts.count([texts[i] for i in some]), strict=True):
        out[i] = n
    for i, t in enumerate(texts):
        if len(t) > LONG and counts.provable:
            out[i] = count_long(counts.tok, t)
    return out


def _counting(name: str, limit: int):
    def count(batches):
        counts = counts_of(name)
        for batch in batches:
            for rows, _, at in slices(batch, "text", 1 << 20):
                n = count_texts(counts, [t or "" for t in rows.column("text").to_pylist()])
                size = at[1:] - at[:-1]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(size), pa.array(n, pa.int64()), pa.array([x > limit for x in n])], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return count


def token_counts(docs: DataFrame, name: str = TOKENIZER, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each row of docs (doc_id, text). ``name``: a public tokenizer or a path on all machines."""
    return docs.select(docs.doc_id.cast("long").alias("doc_id"), "text").mapInArrow(released(_counting(name, limit)), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op4_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
