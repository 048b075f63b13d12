"""Personal data in texts, with Spark expressions alone.

Regular expressions propose spans, checksum validators (Luhn for cards, mod 97 for bank account
numbers) confirm them, and context words in the 40 code points before a span raise its score.

Everything is a column expression: no Python runs on the executors, no row moves between tasks, and a
document's work is in proportion to its length. Each pattern is written so that the JVM's engine neither
backtracks over long runs nor recurses: a match may only begin where a run of its characters begins (or
where the match before it ended), and inner repetitions are possessive. The spans are those of the plain
patterns in ``KINDS``: leftmost, not overlapping within a kind.

Edge cases: a null text counts as empty; an empty text gives an empty span array; other columns of the
input pass through, and a clashing result column name is overwritten.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in their listed order: pattern, base score, words of context.
KINDS: dict[str, tuple[str, int, str]] = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 60, "mail|contact|write|reach"),
    "ip": (r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}", 50, "ip|server|host|address"),
    "card": (r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}(?![\x20-]?[0-9])", 70, "card|visa|credit|karte|carte|tarjeta"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", 50, "call|phone|tel|mobile|fax"),
    "iban": (r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", 80, "iban|bank|account|konto"),
}
CONTEXT_CHARS = 40
CONTEXT_BONUS = 20
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
_BLOCK = 64


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running_sums(a: Column) -> Column:
    """Inclusive running sums of an array of longs, by blocks, so that long arrays stay cheap."""
    blocks = F.sequence(F.lit(0), F.floor((F.size(a) - 1) / _BLOCK).cast("int"))
    total = lambda x: F.aggregate(x, F.lit(0).cast("bigint"), lambda s, v: s + v)
    sums = F.transform(blocks, lambda b: total(F.slice(a, b * _BLOCK + 1, _BLOCK)))
    before = F.aggregate(sums, F.array(F.lit(0).cast("bigint")), lambda acc, s: F.concat(acc, F.array(F.element_at(acc, -1) + s)))
    at = lambda i: F.floor(i / _BLOCK).cast("int")
    return let(before, lambda p: F.transform(a, lambda x, i: F.get(p, at(i)) + total(F.slice(a, at(i) * _BLOCK + 1, i % _BLOCK + 1))))


def _mod97(value: Column) -> Column:
    moved = F.concat(F.substring(value, 5, 40), F.substring(value, 1, 4))
    step = lambda acc, c: F.when(F.ascii(c) < 58, (acc * 10 + F.ascii(c) - 48) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.split(moved, ""), F.lit(0), lambda acc, c: F.when(c == "", acc).otherwise(step(acc, c)))


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return value.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}\z")
    if kind == "card":
        return F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "iban":
        return _mod97(value) == 1
    return F.lit(True)


#: What a text must hold for a kind to be looked for; saves the patterns' work elsewhere.
_HINT = {"email": "@", "phone": "+", "ip": "."}
_SPAN = "array<struct<start:bigint,rank:int,kind:string,end:bigint,score:int,in_context:boolean,value:string>>"


def spans_of(text: Column, kind: str) -> Column:
    """Array of (start, rank, kind, end, score, in_context, value) of one kind; offsets in code points, end exclusive."""
    pattern, base, words = KINDS[kind]
    rank = list(KINDS).index(kind)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def build(s: Column) -> Column:
        steps = F.transform(s["hits"], lambda h, i: (F.length(F.get(s["gaps"], i)) + F.length(h)).cast("bigint"))
        return let(
            let(steps, running_sums),
            lambda ends: F.transform(
                s["hits"],
                lambda h, i: F.struct(
                    (F.get(ends, i) - F.length(h)).alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), F.get(ends, i).alias("end"),
                    h.alias("value"), F.right(F.get(s["gaps"], i), F.lit(CONTEXT_CHARS)).rlike(rf"(?i)(?<![A-Za-z])(?:{words})").alias("in_context"),
                ),
            ),
        )

    def scored(x: Column) -> Column:
        score = F.lit(base) + F.when(x["in_context"], CONTEXT_BONUS).otherwise(0)
        return F.struct(x["start"], x["rank"], x["kind"], x["end"], score.cast("int").alias("score"), x["in_context"], x["value"])

    found = let(hits, lambda h: F.when(F.size(h) > 0, let(F.struct(h.alias("hits"), F.split(text, pattern, -1).alias("gaps")), build)))
    kept = F.transform(F.filter(found, lambda x: _valid(kind, x["value"])), scored).cast(_SPAN)
    hint = text.contains(_HINT[kind]) if kind in _HINT else F.lit(True)
    return F.coalesce(F.when(hint, kept), F.array().cast(_SPAN))


def find_pii(docs: DataFrame, text_col: str = "text", result_col: str = "pii_spans") -> DataFrame:
    """Adds the spans of all kinds, ordered by start and then kind."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.withColumn(result_col, F.array_sort(F.concat(*(spans_of(text, k) for k in KINDS))))


def mask_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Replaces each span by its kind in brackets; spans that overlap become one mask, named by the first.

    The text is cut into pieces of ``_PIECE`` code points once, so no span is looked for from the text's start, and masks are put
    together in groups of ``_GROUP`` spans: the work stays in proportion to the text.
    """
    keep = docs.columns
    text = F.coalesce(F.col(text_col), F.lit(""))
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_PIECE}}}"), F.lit(0))
    masked = let(F.struct(pieces.alias("pieces"), F.col("__pii_spans").alias("spans"), F.length(text).cast("bigint").alias("n")), _masked)
    out = F.when(F.size("__pii_spans") > 0, masked).otherwise(F.col(text_col))
    return find_pii(docs, text_col, "__pii_spans").withColumn(text_col, out).select(*(f"`{c}`" for c in keep))


_PIECE, _GROUP = 4096, 256


def _between(pieces: Column, a: Column, b: Column) -> Column:
    """The text's code points from a up to b."""
    i, j = (F.floor(x / _PIECE).cast("int") for x in (a, b))
    skip, rest = (a % _PIECE + 1).cast("int"), (b % _PIECE).cast("int")
    across = F.concat(F.substr(F.get(pieces, i), skip), F.array_join(F.slice(pieces, i + 2, F.greatest(j - i - 1, F.lit(0))), ""), F.substr(F.coalesce(F.get(pieces, j), F.lit("")), F.lit(1), rest))
    return F.when(b <= a, "").when(i == j, F.substr(F.get(pieces, i), skip, (b - a).cast("int"))).otherwise(across)


def _masked(s: Column) -> Column:
    def one(acc: Column, x: Column) -> Column:
        piece = F.concat(_between(s["pieces"], acc["pos"], x["start"]), F.lit("["), F.upper(x["kind"]), F.lit("]"))
        fresh = F.struct(F.concat(acc["parts"], F.array(piece)).alias("parts"), x["end"].alias("pos"))
        return F.when(x["start"] >= acc["pos"], fresh).otherwise(F.struct(acc["parts"].alias("parts"), F.greatest(acc["pos"], x["end"]).alias("pos")))

    def group(acc: Column, g: Column) -> Column:
        begin = F.struct(F.array().cast("array<string>").alias("parts"), acc["pos"].alias("pos"))
        inner = F.aggregate(F.slice(s["spans"], g * _GROUP + 1, _GROUP), begin, one)
        return let(inner, lambda x: F.struct(F.concat(acc["parts"], F.array(F.array_join(x["parts"], ""))).alias("parts"), x["pos"].alias("pos")))

    groups = F.sequence(F.lit(0), F.floor((F.size(s["spans"]) - 1) / _GROUP).cast("int"))
    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(0).cast("bigint").alias("pos"))
    return F.aggregate(groups, start, group, lambda acc: F.concat(F.array_join(acc["parts"], ""), _between(s["pieces"], acc["pos"], s["n"])))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op8_pii(spark, sf_dir: str) -> DataFrame:
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    spans = F.col("pii_spans")
    count = lambda k: F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("bigint")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in ("email", "ip", "card", "phone")),
        F.sha2(joined(F.filter(spans, lambda s: s["rank"] < 4)), 256).alias("base_sha256"),
        joined(spans).alias("spans"),
        count("iban").alias("n_iban"),
        F.size(F.filter(spans, lambda s: s["in_context"])).cast("bigint").alias("n_in_context"),
        F.coalesce(F.array_max(F.transform(spans, lambda s: s["score"])), F.lit(0)).cast("bigint").alias("max_score"),
    )


def _oracle() -> str:
    plain = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
        "ip": (r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "len(list_filter(string_split(v, '.'), lambda p: CAST(p AS HUGEINT) > 255)) = 0"),
        "card": (r"[0-9](?:[\x20-]?[0-9])+", "len(d) BETWEEN 12 AND 19 AND list_sum(list_transform(range(1, len(d) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(reverse(d)[i] AS INT) "
                 "WHEN CAST(reverse(d)[i] AS INT) > 4 THEN 2 * CAST(reverse(d)[i] AS INT) - 9 ELSE 2 * CAST(reverse(d)[i] AS INT) END)) % 10 = 0"),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "len(d) BETWEEN 9 AND 15"),
        "iban": (r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", "list_reduce(list_prepend(0, list_transform(string_split(v[5:] || v[:4], ''), lambda c: CASE WHEN c < 'A' THEN ascii(c) - 48 ELSE ascii(c) - 55 END)), "
                 "lambda a, x: CASE WHEN x < 10 THEN (a * 10 + x) % 97 ELSE (a * 100 + x) % 97 END) = 1"),
    }
    parts = []
    for rank, (kind, (pattern, test)) in enumerate(plain.items()):
        _, base, words = KINDS[kind]
        parts.append(f"""SELECT doc_id, {rank} AS rank, '{kind}' AS kind, s AS start_, e AS end_, {base} + CASE WHEN ctx THEN {CONTEXT_BONUS} ELSE 0 END AS score, ctx
        FROM (SELECT doc_id, v, s, e, regexp_replace(v, '[^0-9]', '', 'g') AS d, regexp_matches(g[-{CONTEXT_CHARS}:], '(?i)(?:^|[^A-Za-z])(?:{words})') AS ctx
          FROM (SELECT doc_id, hits[i] AS v, gaps[i] AS g, list_sum(list_transform(range(1, i + 1), lambda j: len(gaps[j]) + len(hits[j]))) - len(hits[i]) AS s,
                       list_sum(list_transform(range(1, i + 1), lambda j: len(gaps[j]) + len(hits[j]))) AS e
            FROM (SELECT doc_id, hits, gaps, unnest(range(1, len(hits) + 1)) AS i
              FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS hits, string_split_regex(text, '{pattern}') AS gaps FROM docs) WHERE len(hits) > 0)))
        WHERE {test}""")
    return f"""WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), found AS ({' UNION ALL '.join(parts)}),
    per AS (SELECT doc_id, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card,
      count(*) FILTER (kind = 'phone') AS n_phone, count(*) FILTER (kind = 'iban') AS n_iban, count(*) FILTER (ctx) AS n_in_context, max(score) AS max_score,
      string_agg(kind || ':' || CAST(CAST(start_ AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(end_ AS BIGINT) AS VARCHAR), ',' ORDER BY start_, rank) AS spans,
      string_agg(kind || ':' || CAST(CAST(start_ AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(end_ AS BIGINT) AS VARCHAR), ',' ORDER BY start_, rank) FILTER (rank < 4) AS base
      FROM found GROUP BY doc_id)
    SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256,
      coalesce(spans, '') AS spans, coalesce(n_iban, 0) AS n_iban, coalesce(n_in_context, 0) AS n_in_context, CAST(coalesce(max_score, 0) AS BIGINT) AS max_score
    FROM docs LEFT JOIN per USING (doc_id)"""


ORACLE_SQL = _oracle()
