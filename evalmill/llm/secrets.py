"""Secrets in texts: fixed patterns, and strings that a battery of randomness tests takes for keys.

Candidates are runs of 20 or more characters of the base-64 alphabets. The encoding is the smallest of ``ALPHABETS`` that
holds all of a run's characters. Three tests ask whether the run is uniform over it: chi-squared over the alphabet (with
its exact first two moments, as cells are sparse), runs about the alphabet's middle, and lag-1 serial correlation. Their
p-values are combined by Bonferroni's rule into ``p_uniform``; a run with less than ``UNIFORM`` is no key.

That alone would also keep short words, on which the tests have no power. So each run also has ``p_text``: how likely a run
of that length whose characters are drawn as in the corpus (counted over all texts, within the encoding's alphabet) would look as
uniform, by the chi-squared statistic. Within each class of lengths (powers of two), Benjamini and Hochberg's rule
over all runs of the corpus keeps the share of text among the reported runs below ``FALSE_SHARE``. p-values are rounded up to
quarter powers of ten, so the rule needs a small table of counts only, whatever the corpus' size.

Each text is looked at twice (once for the character counts); no text is shuffled.

Edge cases: a null or empty text has no spans, an empty table no rows. Repeated rows and null ids each give a row and count as often as they
occur. Offsets are in code points. Columns other than the two named are not looked at.
"""

from __future__ import annotations

import itertools
import math
import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalmill.llm._tables import Store
from evalmill.llm._text import released, slices, word_bounds

ASSIGN = re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
KINDS = ("assign", "access", "hex", "random")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX, LEAST_RANDOM = 6, 20, 24, 20
UNIFORM, FALSE_SHARE = 0.001, 0.01

_DIGIT, _UPPER, _LOW = b"0123456789", bytes(range(65, 91)), bytes(range(97, 123))
#: Encodings by size of alphabet; the first that holds all characters counts.
ALPHABETS: dict[str, bytes] = {
    "decimal": _DIGIT, "hex": _DIGIT + b"abcdef", "HEX": _DIGIT + b"ABCDEF", "lower": _LOW, "upper": _UPPER, "base32": _UPPER + b"234567",
    "lower36": _DIGIT + _LOW, "upper36": _DIGIT + _UPPER, "letters": _UPPER + _LOW, "base58": bytes(c for c in _DIGIT + _UPPER + _LOW if c not in b"0OIl"), "base62": _DIGIT + _UPPER + _LOW, "base64": _UPPER + _LOW + _DIGIT + b"+/", "base64url": _UPPER + _LOW + _DIGIT + b"-_",
    "any": _UPPER + _LOW + _DIGIT + b"+/-_=",
}


def _outside(alphabet: bytes) -> np.ndarray:
    out = np.ones(256, dtype=bool)
    out[list(alphabet)] = False
    return out


_NOT_HEX, _NOT_ANY = _outside(ALPHABETS["hex"]), _outside(ALPHABETS["any"])
_CODES = {}
for _name, _letters in ALPHABETS.items():
    _CODES[_name] = np.full(256, -1, dtype=np.int64)
    _CODES[_name][list(_letters)] = np.arange(len(_letters))


_NAMES = list(ALPHABETS)
#: For each byte a bit for each encoding that has it.
_HAVE = sum((_CODES[name] >= 0).astype(np.uint32) << i for i, name in enumerate(_NAMES))
_ALL = np.uint32((1 << len(_NAMES)) - 1)
_CELLS = 1 << 20


def upper_tail(z: np.ndarray) -> np.ndarray:
    """Of the normal distribution."""
    return np.array([0.5 * math.erfc(v) for v in (np.asarray(z, float) / math.sqrt(2)).tolist()])


def encodings_of(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place in ``ALPHABETS`` of each run's encoding, and whether up to two marks of equality in it are padding."""
    equal = data == 61
    padded = (np.add.reduceat(equal, at[:-1]) <= 2) & (np.diff(at) > 2)
    have = np.where(equal & np.repeat(padded, np.diff(at)), _ALL, _HAVE[data])
    common = np.bitwise_and.reduceat(have, at[:-1])
    return np.log2((common & -common.astype(np.int64)).astype(float)).astype(np.int64), padded


def batteries(runs: list[np.ndarray], shares: np.ndarray) -> list[tuple[str, float, float]]:
    """Encoding, p_uniform and p_text of runs of bytes; shares: the corpus' bytes' relative counts. Runs of one encoding and length are tested together."""
    if not runs:
        return []
    data, at = np.concatenate(runs), np.concatenate([[0], np.cumsum([len(r) for r in runs])])
    kind, padded = encodings_of(data, at)
    groups: dict[tuple[int, int], list[int]] = {}
    bodies = []
    for i, (run, k) in enumerate(zip(runs, kind.tolist(), strict=True)):
        x = _CODES[_NAMES[k]][run]
        bodies.append(x[x >= 0])
        groups.setdefault((k, len(bodies[i])), []).append(i)
    out: list = [None] * len(runs)
    for (k, n), members in groups.items():
        step = max(1, _CELLS // max(n, 1))
        for lo in range(0, len(members), step):
            part = members[lo : lo + step]
            for i, u, t in zip(part, *tested(np.stack([bodies[i] for i in part]), _NAMES[k], shares), strict=True):
                out[i] = (_NAMES[k], float(u), float(t))
    return out


def tested(x: np.ndarray, name: str, shares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """p_uniform and p_text of runs of one encoding and length: a row of letters' numbers for each."""
    m, n = x.shape
    k = len(ALPHABETS[name])
    if n < 2:
        return np.ones(m), np.ones(m)
    counts = np.bincount((np.arange(m)[:, None] * k + x).ravel(), minlength=m * k).reshape(m, k).astype(float)
    chi = (counts**2).sum(axis=1) * k / n - n
    p_chi = upper_tail((chi - (k - 1)) / math.sqrt(2 * (k - 1) * (n - 1) / n))
    above = x >= k // 2
    high = above.sum(axis=1)
    some = (high > 0) & (high < n)
    number, mean = 1 + (above[:, 1:] != above[:, :-1]).sum(axis=1), 1 + 2 * high * (n - high) / n
    spread = np.sqrt(np.maximum(1e-9, (mean - 1) * (mean - 2) / (n - 1)))
    p_runs = np.where(some, 2 * upper_tail(np.maximum(0.0, np.abs(number - mean) - 0.5) / spread), 0.0)
    c = x - x.mean(axis=1, keepdims=True)
    serial = (c[:, 1:] * c[:, :-1]).sum(axis=1) / np.maximum(1e-9, (c * c).sum(axis=1)) + 1 / n
    p_serial = 2 * upper_tail(np.abs(serial) * math.sqrt(n))
    mean_text, var_text = text_moments(n, name, shares)
    p_text = upper_tail(-(chi - mean_text) / math.sqrt(max(var_text, 1e-9)))
    return np.minimum(1.0, 3 * np.minimum(np.minimum(p_chi, p_runs), p_serial)), p_text


def text_moments(n: int, name: str, shares: np.ndarray) -> tuple[float, float]:
    """Mean and variance of k / n * (sum of the squared counts) - n of n letters drawn as in the corpus."""
    k = len(ALPHABETS[name])
    q = shares[list(ALPHABETS[name])] + 1e-6
    q = q / q.sum()
    s2, s3 = float((q**2).sum()), float((q**3).sum())
    return k * (1 + (n - 1) * s2) - n, (k / n) ** 2 * 2 * n * (n - 1) * (s2 - s2**2 + 2 * (n - 2) * (s3 - s2**2))


def apart(runs: list[tuple[int, int]], spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The runs that overlap none of the spans (start, rank, end), which are sorted by start."""
    starts = [s for s, *_ in spans]
    reach = list(itertools.accumulate((e for *_, e in spans), max, initial=-1))  # the furthest end of the first i spans
    return [(a, b) for a, b in runs if reach[bisect_left(starts, b)] <= a]


_FOUND = "doc_id long, base array<struct<start:long,rank:int,end:long>>, runs array<struct<start:long,end:long,encoding:string,length:int,p_uniform:double,step:int>>"


def base_spans(raw: bytes, hexes: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(start, rank, end) in bytes."""
    out = [(a, 2, b) for a, b in hexes]
    if b":" in raw or b"=" in raw:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(raw) if len(m[1]) >= LEAST_ASSIGN]
    if b"AKIA" in raw:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(raw) if len(m[0]) >= LEAST_ACCESS]
    return sorted(out)


def _long_runs(data: np.ndarray, at: np.ndarray, outside: np.ndarray, least: int) -> dict[int, list[tuple[int, int]]]:
    """Runs by text, in bytes from its start."""
    starts, ends, _ = word_bounds(data, at, outside)
    keep = np.flatnonzero(ends - starts >= least)
    out: dict[int, list[tuple[int, int]]] = {}
    rows = np.searchsorted(at, starts[keep], side="right") - 1
    for row, a, b in zip(rows.tolist(), starts[keep].tolist(), ends[keep].tolist(), strict=True):
        out.setdefault(row, []).append((a - int(at[row]), b - int(at[row])))
    return out


_SPAN = pa.struct([("start", pa.int64()), ("rank", pa.int32()), ("end", pa.int64())])
_RUN = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("encoding", pa.string()), ("length", pa.int32()), ("p_uniform", pa.float64()), ("step", pa.int32())])


def _searching(shares: np.ndarray):
    def search(batches):
        for batch in batches:
            for rows, data, at in slices(batch, "text"):
                hexes, runs = _long_runs(data, at, _NOT_HEX, LEAST_HEX), _long_runs(data, at, _NOT_ANY, LEAST_RANDOM)
                base, of, free = [], [], []
                for i in range(rows.num_rows):
                    part = data[at[i] : at[i + 1]]
                    base.append(base_spans(part.tobytes(), hexes.get(i, [])))
                    own = apart(runs.get(i, []), base[i])
                    free += [(i, a, b) for a, b in own]
                    of.append([])
                results = batteries([data[at[i] + a : at[i] + b] for i, a, b in free], shares)
                for (i, a, b), (name, p_uniform, p_text) in zip(free, results, strict=True):
                    of[i].append((a, b, name, b - a, p_uniform, max(0, math.floor(-4 * math.log10(max(p_text, 1e-300))))))
                for i in range(rows.num_rows):
                    if base[i] or of[i]:
                        place = np.concatenate([[0], np.cumsum((data[at[i] : at[i + 1]] & 0xC0) != 0x80)])
                        base[i] = [(int(place[a]), r, int(place[b])) for a, r, b in base[i]]
                        of[i] = [(int(place[a]), int(place[b]), *rest) for a, b, *rest in of[i]]
                spans = [[dict(zip(("start", "rank", "end"), s, strict=True)) for s in found] for found in base]
                tests = [[dict(zip(("start", "end", "encoding", "length", "p_uniform", "step"), t, strict=True)) for t in found] for found in of]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(spans, pa.list_(_SPAN)), pa.array(tests, pa.list_(_RUN))], ["doc_id", "base", "runs"])

    return search


def _count_bytes(batches):
    total = np.zeros(256, dtype=np.int64)
    for batch in batches:
        for _, data, _ in slices(batch, "text"):
            total += np.bincount(data, minlength=256)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(256, dtype=np.int32)), pa.array(total)], ["byte", "n"])


def thresholds(counts: dict[int, dict[int, int]], share: float = FALSE_SHARE) -> dict[int, int]:
    """Length class -> least step (quarter power of ten) at which p <= share * rank / number."""
    out = {}
    for length, by_step in counts.items():
        number, rank = sum(by_step.values()), 0
        for step in sorted(by_step, reverse=True):
            rank += by_step[step]
            if 10 ** (-step / 4) <= share * rank / number:
                out[length] = step
    return out


def find_secrets(docs: DataFrame, store: Store) -> DataFrame:
    """(doc_id, spans array<struct<start, rank, end>>, base) of each row of docs (doc_id, text); rank: place in ``KINDS``."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
    counted = {r.byte: r.n for r in rows.select("text").mapInArrow(released(_count_bytes), "byte int, n long").groupBy("byte").agg(F.sum("n").alias("n")).collect()}
    shares = np.array([counted.get(b, 0) for b in range(256)], dtype=float)
    found = store.keep(rows.select("doc_id", "text").mapInArrow(released(_searching(shares / max(1.0, shares.sum()))), _FOUND), "found")
    length = lambda n: F.floor(F.log2(n)).cast("int")
    by: dict[int, dict[int, int]] = {}
    for r in found.select(F.explode("runs").alias("r")).groupBy(length("r.length").alias("length"), F.col("r.step").alias("step")).count().collect():
        by.setdefault(r.length, {})[r.step] = r["count"]
    least = thresholds(by)
    bar = F.create_map(*(F.lit(x) for pair in least.items() for x in pair)) if least else F.create_map().cast("map<int,int>")
    passed = F.filter("runs", lambda r: (r["p_uniform"] >= UNIFORM) & F.coalesce(r["step"] >= F.try_element_at(bar, length(r["length"])), F.lit(False)))
    added = F.transform(passed, lambda r: F.struct(r["start"], F.lit(3).alias("rank"), r["end"]))
    return found.select("doc_id", F.array_sort(F.concat("base", added)).alias("spans"), "base")


def op6_secrets(spark, sf_dir: str) -> DataFrame:
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"), Store(spark, "secrets"))
    kind = F.array(*(F.lit(k) for k in KINDS))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kind, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda rank: F.size(F.filter("spans", lambda s: s["rank"] == rank)).cast("long")
    return found.select("doc_id", *(count(i).alias(f"n_{KINDS[i]}") for i in range(3)), F.sha2(text("base"), 256).alias("base_sha256"), text("spans").alias("spans"), count(3).alias("n_random"))
