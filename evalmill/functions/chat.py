"""Chat examples as a model is trained on them: rendered by a template, tokenised, the prompt masked in the labels.

Rendering is an expression; tokens come from an Arrow UDF whose tokenizer is loaded once in each worker. The tokenizer's file is a parameter: a path, or the name of one of the public
vocabularies where the package ``public_tokenizers`` is installed. Special strings in a text are ordinary text; no token is added at either end.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: what labels hold where nothing is to be learnt.
IGNORED = -100
TOKENS = "struct<input_ids:array<int>,attention_mask:array<int>,labels:array<int>,prompt_tokens:bigint,full_tokens:bigint>"
_ARROW = pa.struct([
    ("input_ids", pa.list_(pa.int32())), ("attention_mask", pa.list_(pa.int32())), ("labels", pa.list_(pa.int32())),
    ("prompt_tokens", pa.int64()), ("full_tokens", pa.int64())
])
_loaded: dict = {}


@dataclass(frozen=True)
class Template:
    """What stands before a message's role, between role and content, behind the content, and what asks for an answer."""

    before: str = "<|im_start|>"
    between: str = "\n"
    after: str = "<|im_end|>\n"
    answer: str = "<|im_start|>assistant\n"


def rendered(messages: Column, template: Template, answer: bool) -> Column:
    """The messages as one text; with ``answer`` it ends where an answer is asked for."""
    lit = F.lit
    each = F.transform(
        messages,
        lambda m: F.concat(lit(template.before), m["role"], lit(template.between), F.coalesce(m["content"], lit("")), lit(template.after))
    )
    return F.concat(F.array_join(each, ""), lit(template.answer if answer else ""))


def encoder(name: str):
    """A function of a list of texts to their ids, kept in this process: of a tokenizers file (.json) or a sentencepiece model (.model)."""
    if name not in _loaded:
        path = name
        if not os.path.isabs(name):
            import public_tokenizers

            path = public_tokenizers.path(name)
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            _loaded[name] = lambda texts: model.encode(texts, num_threads=1)
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(path)
            tok.encode_special_tokens = True
            tok.no_truncation()
            tok.no_padding()
            _loaded[name] = lambda texts: [e.ids for e in tok.encode_batch_fast(texts, add_special_tokens=False)]
    return _loaded[name]


#: Texts that are encoded together, and characters of them.
ENCODED, ENCODED_CHARS = 256, 1 << 20


def _parts(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Rows in runs of at most ``ENCODED`` rows and, but for single rows, ``ENCODED_CHARS`` characters."""
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and (i - start == ENCODED or total + size > ENCODED_CHARS):
            yield start, i
            start, total = i, 0
        total += size
    if len(sizes) > start:
        yield start, len(sizes)


def _lists(values: list[np.ndarray], rows: np.ndarray) -> pa.Array:
    """A list of whole numbers for each row; rows without one have null."""
    sizes = np.zeros(len(rows), dtype=np.int64)
    sizes[rows] = [len(v) for v in values]
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), mask=np.append(~rows, False))
    return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([*values, np.zeros(0)]).astype(np.int32)))


def _examples(prompts: pa.Array, wholes: pa.Array, encode, max_length: int) -> Iterator[pa.Array]:
    """``TOKENS`` of a batch in arrays of a few rows each: ids are lists of Python only while their part is at work."""
    sizes = [a + b for a, b in zip(*(pc.fill_null(pc.utf8_length(x), 0).to_pylist() for x in (prompts, wholes)), strict=True)]
    for start, end in _parts(sizes):
        asked, texts = prompts.slice(start, end - start), wholes.slice(start, end - start)
        rows = np.asarray(asked.is_valid())
        n_prompt = [len(x) for x in encode(asked.drop_null().to_pylist())]
        full = encode(texts.filter(pa.array(rows)).to_pylist())
        n_full, ids = [len(x) for x in full], [np.array(x[:max_length], dtype=np.int32) for x in full]
        labels = [np.where(np.arange(len(x)) < n, IGNORED, x) for x, n in zip(ids, n_prompt, strict=True)]
        count = lambda n: pa.array(np.bincount(np.flatnonzero(rows), n, len(rows)).astype(np.int64), mask=~rows)
        columns = [_lists(ids, rows), _lists([np.ones(len(x)) for x in ids], rows), _lists(labels, rows), count(n_prompt), count(n_full)]
        yield pa.StructArray.from_arrays(columns, fields=list(_ARROW), mask=pa.array(~rows))


def tokens(messages: Column, tokenizer: str, max_length: int, template: Template | None = None) -> Column:
    """input_ids, attention_mask and labels of an example, at most ``max_length`` of each, and how many tokens the prompt and the whole had before; null where there are not three messages.

    The prompt is all but the last message with what asks for an answer; as many labels as it has tokens are masked.
    """
    template = template or Template()

    @F.arrow_udf(TOKENS)
    def work(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        encode = encoder(tokenizer)
        for prompts, wholes in batches:
            yield from _examples(prompts, wholes, encode, max_length)

    once = work.asNondeterministic()  # else a filter on the tokens is pushed below them and encodes all texts a second time
    three = F.size(messages) == 3
    prompt = F.when(three, rendered(F.slice(messages, 1, 2), template, True))
    return once(prompt, F.when(three, rendered(messages, template, False)))
