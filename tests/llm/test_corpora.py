"""The prefix trie of conversations, the divergence audit and the mix of sources against plain versions."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from helpers import DOCS, ODD, documents, save
from pyspark.sql import functions as F

from evalmill.llm import divergence, mixing, turn_trie
from evalmill.llm._tables import Store

TURNS = "conv_id long, turn long, role string, text string"


def rebuilt(rows) -> dict[int, list[tuple[str, str]]]:
    """Each conversation as the contract rebuilds it; ties of turn by the turn's hash, as the operator has them."""
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            tie = hashlib.sha256(f"{len(r.encode())}:{r}{x}".encode()).hexdigest()[:32] + f"{len(x.encode()):08x}"
            own[c].append((t is not None, t or 0, tie, r, x))
    own = {c: [(r, x) for *_, r, x in sorted(v)] for c, v in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % 9 for c in own}
    return {c: own.get(c - c % 5, [])[: h[c]] + own[c][h[c] :] for c in own}


def plain_trie(rows) -> set[tuple]:
    convs = rebuilt(rows)
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += k not in kids
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1].encode()) if k else 0
    ends = {k: ",".join(str(c) for c in sorted(m) if len(convs[c]) == len(k)) for k, m in members.items()}
    return {(min(m), len(k), min(members[k[:-1]]) if k else None, len(m), kids[k], leaves[k], saved[k], hashlib.sha256(ends[k].encode()).hexdigest()) for k, m in members.items()}


def trie(spark, rows, parts=3):
    df = spark.createDataFrame(rows, TURNS).repartition(parts).withColumn("before", F.lit(1)).withColumn("id", F.lit("x"))
    return {tuple(r) for r in turn_trie.prefix_trie(df).collect()}


def some_conversations(seed: int, n: int = 120):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(3 * n), n):
        for t in range(rng.choice([1, 2, 5, 9, 12])):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "é", "", None, "long " * 9]) if t < 3 else rng.choice(["x", "y"])))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_is_that_of_plain_python(spark, seed):
    rows = some_conversations(seed)
    rows += [(5000 + i, t, "user", "the same") for i in range(400) for t in range(11)]  # a group of copies
    rows += [(None, 1, "user", "x"), (7000, None, None, None), (7000, 3, "b", "2"), (7000, 3, "b", "1"), (7000, 3, "b", "1"), (7000, None, "z", "z")]
    assert trie(spark, rows) == plain_trie(rows)


def test_conversations_longer_than_a_segment(spark):
    """Two conversations of 700 turns that part within a later segment, one that ends where a segment ends, and one turn too many there."""
    long = [("user" if t % 2 else "assistant", f"turn {t}") for t in range(700)]
    shapes = {1000: long, 1005: [*long[:600], *[("user", f"other {t}") for t in range(100)]], 1010: long[:256], 1015: long[:257], 1020: long[:512], 1025: long, 1030: long[:2]}
    rows = [(c, t, r, x) for c, turns in shapes.items() for t, (r, x) in enumerate(turns)]
    rows += [(1026, t, "user", f"own {t}") for t in range(300)]
    got = trie(spark, rows)
    assert got == plain_trie(rows) and len(got) > 1000


def test_tries_of_nothing_and_of_turnless_conversations(spark):
    assert trie(spark, [], 1) == set()
    few = next(c for c in range(11, 999) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 2)
    rows = [(few, 1, "user", "only")]  # its head is that of a conversation that is not there, and it has no turn behind it
    assert trie(spark, rows, 1) == plain_trie(rows) == {(few, 0, None, 1, 0, 1, 0, hashlib.sha256(str(few).encode()).hexdigest())}


def test_radix_trees_grow_and_add_up():
    rng = random.Random(3)
    for alphabet, n in ((range(256), 2000), (range(3), 300), (range(40), 700)):
        keys = {bytes(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 2, 3, 6]))) for _ in range(n)}
        tree = turn_trie.Tree()
        for i, k in enumerate(rng.sample(sorted(keys), len(keys))):
            tree.insert(k, (1, i, len(k), 0, (i, 0, 0)))
        seen, kinds, stack = {}, set(), [tree.top]
        while stack:
            node = stack.pop()
            kinds.add(type(node).__name__)
            assert [label for label, _ in node.children()] == sorted({label for label, _ in node.children()}) and all(node.get(label) is child for label, child in node.children())
            stack.extend(child for _, child in node.children())
        for key, above, (count, _, own, _, _) in tree.walk():
            seen[key] = count
            assert above < len(key) or not key
            assert (count, own) == (sum(k.startswith(key) for k in keys), sum(len(k) for k in keys if k.startswith(key)))
        assert set(keys) <= set(seen)
        assert kinds >= ({"Node4", "Node16", "Node256"} if len(alphabet) == 256 else {"Node4"} if len(alphabet) == 3 else {"Node4", "Node48"})
    assert turn_trie.shared(b"abcdef" * 50 + b"x", b"abcdef" * 50 + b"y") == 300 and turn_trie.shared(b"", b"a") == 0


def test_hashes_of_many_ends_are_taken_in_order(spark):
    rows = [(c, 1, "user", "one") for c in range(0, 5 * 1500, 5)]
    got = {r[1]: r for r in trie(spark, rows, 5)}
    kept = [c for c in range(0, 5 * 1500, 5)]
    assert got[1][7] == hashlib.sha256(",".join(map(str, kept)).encode()).hexdigest() and got[1][3] == 1500


def plain_audit(docs, min_df, top):
    word = __import__("re").compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans(divergence._UPPER, divergence._LOWER)
    terms = [(lang or "", source or "", word.findall((text or "").translate(lower))) for text, lang, source in docs]
    df, counts = defaultdict(Counter), defaultdict(Counter)
    for lang, _, t in terms:
        df[lang].update(set(t))
    kept = {lang: sorted(t for t, n in c.items() if n >= min_df) for lang, c in df.items()}
    for lang, source, t in terms:
        counts[lang, source].update(x for x in t if x in set(kept.get(lang, ())))
    out = set()
    share = lambda c, n, v: 1 + 10**9 * (c + 2) // (n + 2 * v)
    f = lambda p, q: (p - q) ** 2 // (p + q)
    for lang in {x for x, _ in counts}:
        words, sources = kept.get(lang, []), sorted((s for x, s in counts if x == lang), key=str.encode)
        whole = sum((counts[lang, s] for s in sources), Counter())
        p = {s: [share(counts[lang, s][w], sum(counts[lang, s].values()), len(words)) for w in words] for s in sources}
        q = [share(whole[w], sum(whole.values()), len(words)) for w in words]
        for s in sources:
            pairs = sorted(((-sum(map(f, p[s], p[o])), o.encode(), o) for o in sources if o != s))
            out |= {(lang, s, "pair", o, -v, i) for i, (v, _, o) in enumerate(pairs, 1)}
            above = sorted((-f(a, b), w.encode(), w) for w, a, b in zip(words, p[s], q, strict=True) if counts[lang, s][w] and a > b)
            out |= {(lang, s, "term", w, -v, i) for i, (v, _, w) in enumerate(above[:top], 1)}
    return out


@pytest.mark.parametrize(("shard", "terms"), [(1 << 20, 1024), (16, 8)])
def test_audit_is_that_of_plain_python(spark, monkeypatch, shard, terms):
    rng = random.Random(5)
    words = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(9) for j in range(9)] + ["Élan", "straße", "naïve", "日本", "ABC", "abc"]
    docs = []
    for i in range(600):
        lang = rng.choice(["en", "de x", "", None, "rare"]) if i < 595 else "rare2"
        text = " ".join(rng.choices(words, weights=range(1, len(words) + 1), k=rng.randint(0, 30))) + rng.choice(["", "1 2-3", ",x!"])
        docs.append((rng.choice([text, text, None, ""]) if i % 9 == 0 else text, lang, rng.choice(["s1", "é", "s10", "", None])))
    docs += [(f"common word {'common ' * (i % 3)}", "many", f"src{i % 70:02d}") for i in range(700)]  # more sources than one block has
    monkeypatch.setattr(divergence, "TERMS", terms)
    df = spark.createDataFrame(docs, "text string, lang string, source string").repartition(3).withColumn("term", F.lit(1)).withColumn("count", F.lit(2))
    got = {tuple(r) for r in divergence.audit(df, shard=shard).collect()}
    assert got == plain_audit(docs, 10, 10)


def test_audits_of_nothing_and_of_nothing_kept(spark):
    assert divergence.audit(spark.createDataFrame([], DOCS)).collect() == []
    df = spark.createDataFrame([("one two", "en", "a"), (None, "en", "b"), ("", None, None)], "text string, lang string, source string")
    assert {tuple(r) for r in divergence.audit(df).collect()} == {("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)}


def test_audit_looks_up_a_term_once_for_each_slice_and_group(spark):
    words = "one two two three three three four"
    df = spark.createDataFrame([(words, "en", f"s{i % 2}") for i in range(400)], "text string, lang string, source string").coalesce(1)
    store = Store(spark, "divergence")
    counts, names = divergence.group_counts(df, store)
    got = {(r.source, r.term, r["count"]) for r in counts.join(names, ["id", "lang"]).collect()}
    assert got == {(s, t, 200 * n) for s in ("s0", "s1") for t, n in (("one", 1), ("two", 2), ("three", 3), ("four", 1))}
    vectors = spark.read.schema(f"vector {divergence._VECTOR}").parquet(f"{store.folder}/vectors-0")
    assert vectors.select(F.sum(F.size("vector.indices"))).first()[0] == 2 * 4  # not once for each of 400 documents


def plain_targets(sizes: list[int], weights=mixing.WEIGHTS) -> list[Fraction]:
    """Share by weight; what is above a limit is taken off and shared again among the others."""
    w = [Fraction(weights[i % len(weights)]) for i in range(len(sizes))]
    target, left, open_ = [Fraction(0)] * len(sizes), Fraction(sum(sizes)), set(range(len(sizes)))
    while left and open_:
        total = sum(w[i] for i in open_)
        for i in open_:
            target[i] += left * w[i] / total
        left = Fraction(0)
        for i in list(open_):
            if target[i] >= 3 * sizes[i]:
                left += target[i] - 3 * sizes[i]
                target[i] = Fraction(3 * sizes[i])
                open_.discard(i)
    return target


@pytest.mark.parametrize("sizes", [[100], [10, 1000], [0, 0], [5, 0, 7], [1, 2, 3, 400, 50, 6, 7000], [1000, 1, 1, 1, 1, 1], [3, 30, 300, 3000, 30000, 3, 3]])
def test_targets_are_those_of_sharing_again_and_again(spark, sizes):
    df = spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(sizes)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    assert [got[f"s{i}"] for i in range(len(sizes))] == pytest.approx([float(t) for t in plain_targets(sizes)])


def test_permutations(spark):
    rows = [(n, k, x) for n in (1, 2, 3, 7, 64, 100) for k in range(3) for x in range(n)]
    df = spark.createDataFrame(rows, "n long, k long, x long")
    got = defaultdict(list)
    for r in df.select("n", "k", "x", mixing.permuted(F.col("x"), F.col("n"), F.col("k")).alias("y")).orderBy("n", "k", "x").collect():
        got[r.n, r.k].append(r.y)
    assert all(sorted(v) == list(range(n)) for (n, _), v in got.items())
    assert got[100, 0] != got[100, 1] and sum(a == b for a, b in enumerate(got[100, 0])) < 12


def mixture(spark, docs, parts):
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(parts).withColumn("size", F.lit("x")).withColumn("number", F.lit(1))
    return sorted(((r.doc_id, r.size, r.source_size, r.target, r.taken) for r in mixing.mix(df).collect()), key=str)


def test_mix_comes_near_its_targets(spark):
    rng = random.Random(9)
    text = lambda n: " ".join(rng.choice(["a", "bb", "é x", "c\x0bd"]).split("\x0b")[0] for _ in range(n))
    docs = [(i, text(rng.choice([0, 1, 5, 50, 400])), rng.choice(["big", "big", "big", "mid", "tiny" if i % 40 == 0 else "mid", None])) for i in range(900)]
    docs += [(2000, None, "big"), (2001, "", None), (None, "one two", "mid"), (5, "again here", "mid"), (5, "again here", "mid"), (3000, " \t\n", "void")]
    got = mixture(spark, docs, 3)
    assert got == mixture(spark, docs, 7) and len(got) == len(docs)
    words = Counter()
    for _, t, s in docs:
        words[s] += len(__import__("re").findall(r"[^\x20\x09-\x0D]+", t or ""))
    order = sorted((s for s in words if s is not None)) + [None]
    want = dict(zip(order, plain_targets([words[s] for s in order]), strict=True))
    by = defaultdict(lambda: [0, None])
    for _, size, source_size, target, taken in got:
        assert 0 <= taken <= 3 * size
        by[source_size][0] += taken
        by[source_size][1] = target
    assert {n: t for n, (_, t) in by.items()} == pytest.approx({words[s]: float(want[s]) for s in order})
    for n, (taken, target) in by.items():
        assert abs(taken - target) <= max(0.03 * target, 8), (n, taken, target)


def test_mix_of_nothing_and_of_odd_texts(spark, tmp_path):
    assert mixing.mix(spark.createDataFrame([], DOCS)).collect() == []
    rows = mixing.op13_mixing(spark, save(spark, tmp_path, documents=documents(spark, ODD, extra=True))).collect()
    assert len(rows) == len(ODD) and all(r.taken <= 3 * r.size for r in rows) and sum(r.taken for r in rows) == pytest.approx(rows[0].target, rel=0.02)


def test_slots_are_drawn_by_shard(spark, monkeypatch):
    """A shard's counts vary as draws do, and all slots together are exactly what each source should have."""
    from evalmill.llm._tables import Store

    sources = spark.createDataFrame([(0, 30000, 0, 99), (1, 9000, 30000, 50), (2, 5, 39000, 2), (3, 0, 39005, 0)], "number long, slots long, low long, blocks long")
    slots = mixing.drawn_slots(sources, Store(spark, "slots"))
    turns = {r.number: (r.n, r.m, r.d) for r in slots.groupBy("number").agg(F.count("*").alias("n"), F.max("turn").alias("m"), F.count_distinct("turn").alias("d")).collect()}
    assert turns == {0: (30000, 29999, 30000), 1: (9000, 8999, 9000), 2: (5, 4, 5)}
    per = [r.n for r in slots.where("number = 1").groupBy("shard").agg(F.count("*").alias("n")).collect()]
    assert len(per) == 39 and len(set(per)) > 10 and all(abs(n - 1024 * 9000 / 39005) < 90 for n in per[:-1] if n > 60)
    sizes = [r.n for r in slots.groupBy("shard").agg(F.count("*").alias("n")).collect()]
    assert sorted(sizes) == [39005 - 38 * 1024, *[1024] * 38]
