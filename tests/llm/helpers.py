from __future__ import annotations

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, parts=2, extra=False):
    """Documents with ids from 0; more rows than one partition holds."""
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS).repartition(parts)
    if extra:
        from pyspark.sql import functions as F

        for name in ("text_a", "key", "component", "bands", "matches", "pii_spans", "row", "score"):
            df = df.withColumn(name, F.lit(1))
    return df


def save(spark, folder, **tables):
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


ODD = [None, "", " \t\n", "a", "one two three", "\x00\x01 é \U0001d11e ﬁ", "word " * 30000, "x" * 200000]
