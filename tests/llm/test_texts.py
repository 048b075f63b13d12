"""Language-model scores, token counts, pieces, secrets, personal data and media against plain versions."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import ODD, documents, save

from evalmill.llm import media, pieces, pii, ppm, secrets, token_counts
from evalmill.llm._tables import Store


def stream(texts):
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])


def plain_ppm(train, text, order):
    counts = [defaultdict(Counter) for _ in range(order + 1)]
    for t in train:
        s = [256] * order + list(t) + [256]
        for p in range(order, len(s)):
            for k in range(order + 1):
                counts[k][tuple(s[p - k : p])][s[p]] += 1
    total, s = 0.0, [256] * order + list(text) + [256]
    for p in range(order, len(s)):
        out: set = set()
        for k in range(order, -1, -1):
            c = counts[k].get(tuple(s[p - k : p]))
            if not c:
                continue
            n, d = sum(v for x, v in c.items() if x not in out), sum(x not in out for x in c)
            if s[p] in c:
                total += math.log10(c[s[p]] / (n + d))
                break
            total += math.log10(d / (n + d)) if d else 0
            out |= set(c)
        else:
            total -= math.log10(257 - len(out))
    return total


@pytest.mark.parametrize("order", [1, 2, 5])
def test_trie_against_a_plain_one(order):
    rng = random.Random(order)
    train = [bytes(rng.choices(b"abcd ", k=rng.randint(0, 60))) for _ in range(30)]
    texts = [bytes(rng.choices(b"abcdef \xff", k=rng.randint(0, 60))) for _ in range(30)] + [b""]
    k, n = np.unique(ppm.codes_of(*stream(train), order)[0], return_counts=True)
    codes, by = ppm.codes_of(*stream(texts), order)
    got = np.add.reduceat(ppm.Model(k, n, order).log10(codes), by[:-1])
    assert np.allclose(got, [plain_ppm(train, t, order) for t in texts])


def test_probabilities_of_all_symbols_sum_to_one():
    k, n = np.unique(ppm.codes_of(*stream([b"abracadabra", b"abc", b""]), 3)[0], return_counts=True)
    model = ppm.Model(k, n, 3)
    for context in (b"abr", b"zzz", b"bra", b"\x00ab"):
        base = sum(int(c) << (ppm.SHIFT * (3 - i)) for i, c in enumerate(context))
        assert math.isclose((10 ** model.log10(np.array([base + s for s in range(257)], np.uint64))).sum(), 1)


def test_op1_base_scores(spark, tmp_path):
    rng = random.Random(2)
    texts = [" ".join(rng.choices(["The", "the", "cat", "Dog", "é"] + [f"r{i}" for i in range(200)], k=rng.randint(0, 40))) for _ in range(80)] + ODD
    rows = {r.doc_id: r for r in ppm.op1_lm_ppm(spark, save(spark, tmp_path, documents=documents(spark, texts))).collect()}
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    words = [(t or "").encode().lower().split() for t in texts]
    counts = Counter(w for i, ws in enumerate(words) if not held(i) for w in ws)
    n_docs = sum(not held(i) for i in range(len(texts)))
    total, distinct = sum(counts.values()) + n_docs, len(counts) + 1
    for i, ws in enumerate(words):
        base = sum(math.log10(counts[w] + 1) for w in ws) + math.log10(n_docs + 1) - (len(ws) + 1) * math.log10(total + distinct + 1)
        r = rows[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i), len(ws) + 1, sum(w in counts for w in ws) + 1, total)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.score < 0


def test_words_beyond_the_head_meet_the_table(spark, tmp_path, monkeypatch):
    texts = ["a b c d", "a b c", "a x", "a y y"] * 3
    folder = save(spark, tmp_path, documents=documents(spark, texts))
    full = sorted(ppm.op1_lm_ppm(spark, folder).collect())
    monkeypatch.setattr(ppm, "HEAD", 2)
    for a, b in zip(full, sorted(ppm.op1_lm_ppm(spark, folder).collect()), strict=True):
        assert a[:5] == b[:5] and math.isclose(a.base_score, b.base_score) and math.isclose(a.score, b.score)


@pytest.mark.parametrize(("nodes", "group"), [(0, 50), (40, 50), (400, 50), (40, 3), (0, 10**6)])
def test_order_stays_when_the_trie_outgrows_what_is_sent(spark, tmp_path, monkeypatch, nodes, group):
    rng = random.Random(9)
    texts = ["".join(rng.choices("aaabbcde ", k=rng.randint(0, 60))) for _ in range(40)] + ["zzz", "aaazq", "é", None]
    folder = save(spark, tmp_path, documents=documents(spark, texts))
    full = sorted(ppm.op1_lm_ppm(spark, folder).collect())
    train = [(texts[r.doc_id] or "").encode() for r in full if not r.held_out]
    monkeypatch.setattr(ppm, "MAX_NODES", nodes)
    monkeypatch.setattr(ppm, "GROUP_NODES", group)
    for a, b in zip(full, sorted(ppm.op1_lm_ppm(spark, folder).collect()), strict=True):
        assert a[:5] == b[:5] and math.isclose(a.base_score, b.base_score) and math.isclose(a.score, b.score)
        assert math.isclose(b.score, plain_ppm(train, (texts[b.doc_id] or "").encode(), ppm.ORDER))


def test_empty_corpus(spark, tmp_path):
    assert ppm.op1_lm_ppm(spark, save(spark, tmp_path, documents=documents(spark, ["a"]).limit(0))).count() == 0


def test_spliced_counts_are_the_library_s():
    tok = token_counts.tokenizer(token_counts.TOKENIZER)
    rng = random.Random(6)
    parts = [" ", "  ", "a", "bc", "'s", "\n", "1", "é", "!", "<|endoftext|>", " word", "日本"]
    for _ in range(80):
        s = "".join(rng.choices(parts, k=rng.randint(1, 900)))
        assert token_counts.count_long(tok, s, rng.randint(8, 80), rng.randint(2, 20)) == len(tok.encode(s, add_special_tokens=False).ids)


def test_added_tokens_over_letters_and_marks_leave_nothing_to_prove():
    from tokenizers import AddedToken, Tokenizer

    import public_tokenizers

    tok = Tokenizer.from_file(public_tokenizers.path(token_counts.TOKENIZER))
    assert token_counts.provable(tok)
    tok.add_tokens([AddedToken("Mr.", normalized=False)])
    assert not token_counts.provable(tok)
    counts = token_counts.Counts(tok)
    assert counts.count(["ask Mr. X, Mr."]) == [len(tok.encode("ask Mr. X, Mr.", add_special_tokens=False).ids)]


def test_op4_counts(spark, tmp_path):
    tok = token_counts.tokenizer(token_counts.TOKENIZER)
    texts = [*ODD, "some words, and more. " * 6000]
    for r in token_counts.op4_token_counts(spark, save(spark, tmp_path, documents=documents(spark, texts))).collect():
        t = texts[r.doc_id] or ""
        n = len(tok.encode(t, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), n, n > 1024)


def test_pieces_are_the_library_s_and_decode(spark, tmp_path):
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(pieces.MODEL))
    texts = [*ODD, "a  b ", "▁x", "tabs\tand\r\nlines", "   "]
    got = {r.doc_id: r for r in pieces.op5_pieces(spark, save(spark, tmp_path, documents=documents(spark, texts))).collect()}
    for i, t in enumerate(texts):
        assert got[i].token_ids == sp.encode(t or "") and got[i].parity and got[i].n_tokens == len(got[i].token_ids)
        assert got[i].round_trip == ("▁" not in (t or ""))
    back = {r.doc_id: r.text for r in pieces.decode(pieces.encode(documents(spark, texts))).collect()}
    assert all(back[i] == (t or "").replace("▁", " ") for i, t in enumerate(texts))


def test_parity_over_the_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    encoded = pieces.encode(docs)
    assert encoded.where("not parity").count() == 0
    back = pieces.decode(encoded).withColumnRenamed("text", "back").join(docs, "doc_id").join(encoded, "doc_id")
    assert back.where("round_trip and back <> text").count() == 0 and back.where("round_trip").count() > 0.9 * docs.count()


def test_decoding_of_nulls_and_long_lists(spark, monkeypatch):
    docs = documents(spark, ["word " * 3000, "", "é a", "x" * 3000])
    ids = pieces.encode(docs).select("doc_id", "token_ids")
    ids = ids.union(ids.sparkSession.createDataFrame([(9, None)], ids.schema))
    want = {0: "word " * 3000, 1: "", 2: "é a", 3: "x" * 3000, 9: ""}
    monkeypatch.setattr(pieces, "DECODED", 100)
    assert {r.doc_id: r.text for r in pieces.decode(ids).collect()} == want


def test_no_shared_folder_on_a_cluster_is_an_error():
    from types import SimpleNamespace

    from evalmill.llm._tables import shared_folder

    session = lambda master, conf: SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, applicationId=master))
    with pytest.raises(ValueError, match="share"):
        shared_folder(session("spark://host:7077", {}))
    assert shared_folder(session("local[2]", {})) == shared_folder(session("local[2]", {}))
    assert shared_folder(session("spark://host:7077", {"spark.checkpoint.dir": "hdfs://x/y/"})) == "hdfs://x/y"


def message(number, value):
    def varint(n):
        out = b""
        while True:
            out += bytes([n & 127 | (128 if n > 127 else 0)])
            n >>= 7
            if not n:
                return out

    return varint(number << 3) + varint(value) if isinstance(value, int) else varint(number << 3 | 2) + varint(len(value)) + value


def test_unigram_models_are_rebuilt():
    import struct

    import sentencepiece

    def piece(text, score, kind=1):
        return message(1, message(1, text.encode()) + b"\x15" + struct.pack("<f", score) + message(3, kind))

    words = [("▁", -3.0), ("a", -2.5), ("b", -3.1), ("ab", -3.3), ("▁ab", -3.6), ("c", -4.0), ("bc", -5.0), ("▁a", -3.2), ("abc", -6.0)]
    raw = piece("<unk>", 0.0, 2) + piece("<s>", 0.0, 3) + b"".join(piece(f"<0x{i:02X}>", 0.0, 6) for i in range(256)) + b"".join(piece(w, s) for w, s in words)
    raw += message(2, message(3, 1) + message(35, 1)) + message(3, message(1, b"identity") + message(3, 1) + message(4, 0) + message(5, 1))
    backend, sp = pieces.Backend(raw), sentencepiece.SentencePieceProcessor(model_proto=raw)
    texts = ["abc ab", "cab bc  a", "", "zé a", " "]
    ids, n, parity, _ = backend.encode(texts)
    assert all(parity) and ids.tolist() == [i for t in texts for i in sp.encode(t)] and n.tolist() == [len(sp.encode(t)) for t in texts]


ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


def base_secrets(t):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24])


def test_secrets(spark, tmp_path):
    rng = random.Random(1)
    key = lambda n: "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=n))
    keys = [key(64) for _ in range(6)]
    word = lambda: "".join(rng.choices(["the", "in", "er", "on", "tion", "ing", "and", "th"], k=12))
    texts = [*ODD, 'é PassWord = "hunter22x"; token=abc', "AKIA" + "Q7" * 9 + " AKIAQ", "f" * 24 + " " + "0" * 23, "token=token :abcdefgh", "API_KEY:'x.y-z=/+'", *(f"prose here {k} and there" for k in keys), *(word() for _ in range(200))]
    for r in secrets.op6_secrets(spark, save(spark, tmp_path, documents=documents(spark, texts))).collect():
        t = texts[r.doc_id] or ""
        base = base_secrets(t)
        line = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for _, k, _ in base) for x in range(3))
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest() and all(x in r.spans.split(",") for x in line.split(",") if x)
        planted = next((k for k in keys if k in t), None)
        assert (f"random:{t.index(planted)}:{t.index(planted) + 64}" in r.spans.split(",")) if planted else r.n_random == 0


@pytest.mark.parametrize("query", [ppm.op1_lm_ppm, token_counts.op4_token_counts, pieces.op5_pieces, secrets.op6_secrets, pii.op8_pii, media.op9_media])
def test_odd_tables(spark, tmp_path, query):
    """No rows; null ids, repeated rows and further columns, which change nothing."""
    texts = [*ODD, "write to a@b.cc, token=abcdef1 and 4111 1111 1111 1111", "AKIA" + "Q7" * 9]
    docs = documents(spark, texts)
    plain = {r.doc_id: r for r in query(spark, save(spark, tmp_path / "a", documents=docs)).collect()}
    more = documents(spark, texts, extra=True)
    more = more.union(more.where("doc_id in (4, 8)")).union(more.where("doc_id = 8").withColumn("doc_id", __import__("pyspark").sql.functions.lit(None).cast("long")))
    rows = query(spark, save(spark, tmp_path / "b", documents=more)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows) == sorted([(False, i) for i in [*range(len(texts)), 4, 8]] + [(True, 0)])
    for r in rows:
        want = plain[8 if r.doc_id is None else r.doc_id]
        if query is not ppm.op1_lm_ppm:  # there repeated rows are learned from as often as they occur
            assert [v for k, v in r.asDict().items() if k != "doc_id"] == [v for k, v in want.asDict().items() if k != "doc_id"]
    assert query(spark, save(spark, tmp_path / "c", documents=docs.limit(0))).count() == 0


def test_false_discovery_rule():
    assert secrets.thresholds({5: {0: 90, 40: 10}}, 0.01) == {5: 40}
    assert secrets.thresholds({5: {0: 100}, 6: {4: 1}}, 0.01) == {}


def plain_battery(run, shares):
    """The three tests and the corpus' one, letter by letter."""
    tail = lambda z: 0.5 * math.erfc(z / math.sqrt(2))
    bare = run.replace(b"=", b"") if run.count(b"=") <= 2 else run
    name = next(n for n, letters in secrets.ALPHABETS.items() if all(c in letters for c in bare))
    letters = secrets.ALPHABETS[name]
    x = [letters.index(c) for c in run if c in letters]
    n, k = len(x), len(letters)
    chi = sum(x.count(v) ** 2 for v in range(k)) * k / n - n
    p = [tail((chi - (k - 1)) / math.sqrt(2 * (k - 1) * (n - 1) / n))]
    high = sum(v >= k // 2 for v in x)
    if 0 < high < n:
        runs = 1 + sum((a >= k // 2) != (b >= k // 2) for a, b in zip(x, x[1:]))
        mean = 1 + 2 * high * (n - high) / n
        p.append(2 * tail(max(0, abs(runs - mean) - 0.5) / math.sqrt(max(1e-9, (mean - 1) * (mean - 2) / (n - 1)))))
    else:
        p.append(0)
    mid = sum(x) / n
    r = sum((a - mid) * (b - mid) for a, b in zip(x, x[1:])) / max(1e-9, sum((a - mid) ** 2 for a in x))
    p.append(2 * tail(abs(r + 1 / n) * math.sqrt(n)))
    mean, var = secrets.text_moments(n, name, shares)
    return name, min(1, 3 * min(p)), tail(-(chi - mean) / math.sqrt(max(var, 1e-9)))


def test_batteries_are_those_of_plain_loops():
    rng = random.Random(5)
    shares = np.array([rng.random() for _ in range(256)])
    pools = [*secrets.ALPHABETS.values(), b"ab", b"0", b"q"]
    runs = [bytes(rng.choices(rng.choice(pools), k=rng.choice([20, 21, 40, 90]))) + rng.choice([b"", b"", b"=", b"==", b"==="]) for _ in range(400)]
    for run, (name, u, t) in zip(runs, secrets.batteries([np.frombuffer(r, np.uint8) for r in runs], shares), strict=True):
        want = plain_battery(run, shares)
        assert name == want[0] and math.isclose(u, want[1], rel_tol=1e-6, abs_tol=1e-12) and math.isclose(t, want[2], rel_tol=1e-6, abs_tol=1e-12), run


def test_moments_are_those_of_drawn_texts():
    rng = np.random.default_rng(4)
    letters = np.frombuffer(secrets.ALPHABETS["lower"], np.uint8)
    shares = np.zeros(256)
    shares[letters] = rng.dirichlet(np.ones(26) * 2)
    x = rng.choice(26, (20000, 40), p=(shares[letters] + 1e-6) / (shares[letters] + 1e-6).sum())
    chi = np.array([(np.bincount(r, minlength=26) ** 2).sum() for r in x]) * 26 / 40 - 40
    mean, var = secrets.text_moments(40, "lower", shares)
    assert abs(chi.mean() - mean) < 0.02 * mean and abs(chi.var() - var) < 0.1 * var


def test_discovery_rule_against_the_rule_on_single_values():
    rng = random.Random(6)
    for _ in range(50):
        steps = [min(200, int(rng.expovariate(0.05 if rng.random() < 0.2 else 0.8))) for _ in range(rng.randint(1, 300))]
        p = sorted(10 ** (-s / 4) for s in steps)
        passed = [v for i, v in enumerate(p) if v <= 0.01 * (i + 1) / len(p)]
        least = secrets.thresholds({5: Counter(steps)}, 0.01).get(5)
        assert sum(least is not None and s >= least for s in steps) == (sum(v <= max(passed) for v in p) if passed else 0)


def test_runs_apart_from_spans():
    rng = random.Random(7)
    for _ in range(200):
        spans = sorted((a, 0, a + rng.randint(1, 30)) for a in rng.sample(range(300), rng.randint(0, 12)))
        cuts = sorted(rng.sample(range(320), 20))
        runs = list(zip(cuts[::2], cuts[1::2]))
        assert secrets.apart(runs, spans) == [(a, b) for a, b in runs if all(b <= s or a >= e for s, _, e in spans)]


def test_a_long_text_with_many_spans_and_runs_takes_seconds():
    import time

    text = b" ".join(b"token=abcdef%05d %s" % (i, bytes(random.Random(i).choices(b"abcdefghijkmnpqrstuvwxyz", k=25))) for i in range(30000))
    batch = __import__("pyarrow").record_batch({"doc_id": [1], "text": [text.decode()]})
    began = time.time()
    (out,) = secrets._searching(np.ones(256) / 256)(iter([batch]))
    assert time.time() - began < 30 and len(out.column("base")[0]) == 30000 and len(out.column("runs")[0]) == 30000


PATTERNS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base_personal(t):
    out = []
    for rank, (kind, pattern) in enumerate(PATTERNS):
        for m in re.finditer(pattern, t):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]:
                out.append((m.start(), rank, m.end()))
    return sorted(out)


def test_personal_data_against_the_plain_patterns(spark, tmp_path):
    rng = random.Random(9)
    bits = ["a@b.c", ".d", "_", "@", "x.y", "1.2.3.4", "256.1.1.1", ".5", "4111 1111 1111 1111", "4111-1111-1111-1111", " ", "-", "7", "12", "+49 (0)30 1234567", "+", "é", "𝄞", "0000255.1.1.1", "  ", "GB82WEST12345698765432", "\n"]
    texts = [*ODD, *("".join(rng.choices(bits, k=rng.randint(1, 25))) for _ in range(300)), "x@y.zz " * 400]
    rows = pii.op8_pii(spark, save(spark, tmp_path, documents=documents(spark, texts))).collect()
    for r in rows:
        t = texts[r.doc_id] or ""
        base = base_personal(t)
        line = ",".join(f"{PATTERNS[k][0]}:{a}:{b}" for a, k, b in base)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for _, k, _ in base) for x in range(4)), t
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest(), t


def test_context_raises_scores_and_masks_hide(spark):
    df = documents(spark, ["card 4111111111111111 or x@y.zz", "4111111111111111", None, "IBAN GB82WEST12345698765432", "GB82WEST12345698765431"])
    score = {r.doc_id: [s.score for s in r.pii_spans] for r in pii.find_pii(df).collect()}
    assert score == {0: [90, 60], 1: [70], 2: [], 3: [100], 4: []}
    text = {r.doc_id: r.text for r in pii.mask_pii(df).collect()}
    assert text == {0: "card [CARD] or [EMAIL]", 1: "[CARD]", 2: None, 3: "IBAN [IBAN]", 4: "GB82WEST12345698765431"}


def test_masks_of_long_and_crowded_texts(spark):
    rng = random.Random(4)
    bits = ["x@y.zz", " ", "é𝄞 words ", "a" * 5000, "1.2.3.4", "+49 30 1234567", "5" * 4100, "\n"]
    texts = ["".join(rng.choices(bits, k=rng.randint(1, 700))) for _ in range(8)]
    df = documents(spark, texts)
    spans = {r.doc_id: r.pii_spans for r in pii.find_pii(df).collect()}
    for r in pii.mask_pii(df).collect():
        out, pos = [], 0
        for s in spans[r.doc_id]:
            if s.start >= pos:
                out += [texts[r.doc_id][pos : s.start], f"[{s.kind.upper()}]"]
            pos = max(pos, s.end)
        assert r.text == "".join(out) + texts[r.doc_id][pos:]


def test_media_round_trip(spark, tmp_path):
    rng = random.Random(3)
    long = "".join(rng.choices("abcdefgh ", k=150000))
    texts = [*ODD, long, "head " + long, long]
    rows = {r.doc_id: r for r in media.op9_media(spark, save(spark, tmp_path, documents=documents(spark, texts))).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64) or b"\0" * 64
        stored = media.wav(payload)
        want = (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest())
        assert rows[i][1:7] == want and rows[i].feature == media.feature_of(payload)


def test_cuts_are_found_again_behind_other_bytes(spark):
    rng = random.Random(5)
    body = bytes(rng.choices(range(256), k=300000))
    a, b = media.chunks_of(body), media.chunks_of(b"something before" + body)
    assert b"".join(a) == body and len({hashlib.sha256(c).digest() for c in a} & {hashlib.sha256(c).digest() for c in b}) >= len(a) - 3
    assert all(len(c) <= media.LARGEST for c in a) and all(len(c) > media.SMALLEST // 2 for c in a[:-1])
    h = media.gear(np.frombuffer(body[:200], np.uint8))
    want = 0
    for i, c in enumerate(body[:200]):
        want = ((want << 1) + int(media.GEAR[c])) & 0xFFFFFFFF
        assert i < 31 or h[i] == want  # beyond 32 bytes shifts fall out


def chunk_store(spark, texts):
    store = Store(spark, "t")
    return store, media.store_media(documents(spark, texts), store)


def test_a_changed_chunk_is_an_error(spark):
    from pyspark.sql import functions as F

    _, (_, packs, chunks) = chunk_store(spark, ["one text", "another", "one text"])
    import zstandard

    assert media.read_media(packs, chunks).count() == 2
    bad = chunks.withColumn("data", F.lit(zstandard.ZstdCompressor().compress(b"other")))
    with pytest.raises(Exception, match="not read back"):
        media.read_media(packs, bad).collect()


def test_media_are_read_from_the_written_chunks(spark):
    import glob
    import os

    rng = random.Random(7)
    body = ["".join(rng.choices("abcdefgh ", k=20000)) for _ in range(3)]
    store, (_, packs, chunks) = chunk_store(spark, [*body, "x" + body[0], body[1]])
    assert media.read_media(packs, chunks).count() == 4
    path = store.folder.removeprefix("file:")
    for name in ("chunks", "packs"):
        files = glob.glob(f"{path}/{name}/*.parquet")
        hidden = [(f, f + ".away") for f in files]
        for f, away in hidden:
            os.rename(f, away)
        with pytest.raises(Exception, match="FILE_NOT_EXIST|does not exist|FileNotFound"):
            media.read_media(packs, chunks).collect()
        for f, away in hidden:
            os.rename(away, f)
    assert media.read_media(packs, chunks).count() == 4


def test_near_copies_share_most_bytes_and_each_chunk_is_stored_once(spark):
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(3000)]
    base = [rng.choices(words, k=2500) for _ in range(4)]
    texts = []
    for b in base:
        copy = list(b)
        copy[700] = copy[1800] = "changed"
        texts += [" ".join(b), " ".join(copy), "a line before\n" + " ".join(b)]
    import zstandard

    _, (lists, packs, chunks) = chunk_store(spark, texts)
    kept = sum(sum(r.sizes) for r in packs.collect()) + sum(len(zstandard.ZstdDecompressor().decompress(r.data)) for r in chunks.collect())
    assert kept < 0.5 * sum(r.media_bytes for r in lists.collect())  # a third of them differs from all before
    cut = [media.chunks_of(media.wav(media.payload_of(t.encode()))) for t in texts]
    for i in range(0, len(texts), 3):
        known = set(cut[i])
        assert all(sum(len(c) for c in copy if c in known) > 0.5 * sum(map(len, copy)) for copy in cut[i + 1 : i + 3])
    digests = [d for r in lists.collect() for d in map(bytes, r.digests)]
    stored = [bytes(r.digest) for r in chunks.collect()]
    assert len(stored) == len(set(stored)) == len({d for d in digests if digests.count(d) > 1})
    assert len(stored) + sum(len(r.places) for r in packs.collect()) == len(set(digests))


def test_a_full_filter_loses_nothing(spark, tmp_path, monkeypatch):
    texts = [f"text {i} " * (i % 50) for i in range(120)]
    folder = save(spark, tmp_path, documents=documents(spark, texts))
    want = sorted(media.op9_media(spark, folder).collect())
    monkeypatch.setattr(media, "filter_of", lambda lists: np.full(1 << (media.FILTER_BITS - 6), 2**64 - 1, np.uint64))
    assert sorted(media.op9_media(spark, folder).collect()) == want
    assert media.op9_media(spark, save(spark, tmp_path / "none", documents=documents(spark, ["a"]).limit(0))).count() == 0


def plain_feature(payload):
    x = [b - 128 for b in payload]
    turns = sum((a < 0) != (b < 0) for a, b in zip(x, x[1:]))
    return f"n={len(x)};sum={sum(x)};squares={sum(v * v for v in x)};crossings={turns}"


def plain_cuts(data):
    """Ends of the chunks, byte by byte."""
    out, start, h = [], 0, 0
    for i, c in enumerate(data):
        h = ((h << 1) + int(media.GEAR[c])) & 0xFFFFFFFF
        size = i + 1 - start
        if (size >= media.SMALLEST and h >> (32 - media.CUT_BITS) == 0 and len(data) - start > media.SMALLEST) or size == media.LARGEST or i + 1 == len(data):
            out.append(i + 1)
            start = i + 1
    return out


def test_cuts_and_features_are_those_of_plain_loops():
    rng = random.Random(9)
    for n in (1, 255, 256, 257, 5000, 60000):
        data = bytes(rng.choices(b"abcdefghijklmnop \n", k=n))
        assert media.cuts(data) == plain_cuts(data) and media.feature_of(data) == plain_feature(data)
    assert media.cuts(b"a" * 50000) == plain_cuts(b"a" * 50000)
