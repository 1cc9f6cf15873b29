"""Awkward documents shared by the corpus tests."""

import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def words(text):
    return WORD.findall(lower(text))


def prose(seed, n):
    import random

    rng = random.Random(seed)
    parts = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split()
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randrange(2, 5))) for _ in range(n))


def awkward(spark, extra=True):
    long = prose(1, 30_000)
    rows = [
        (1, None, "en", "a", None), (2, "", "en", "a", 0), (3, "   \n\n ", None, None, 5), (4, "one two", "en", "a", 7), (5, "one two", "en", "a", 7), (5, "one two", "en", "a", 7),
        (None, "one two", None, None, None), (None, None, None, None, None), (6, long, "en", "b", len(long)), (7, long + " tail", "en", "b", len(long) + 5), (8, "日本語 Ünïcode ß \U0001f600 ÀÉ", "xx", "ñ", 3), (9, "\x00 \x7f ~ !!", "en", "b", 7),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    if extra:  # names that the operators' own outputs have, in other cases too
        from pyspark.sql import functions as F

        for c in ("score", "N_WORDS", "size", "taken", "n_tokens", "predicted", "n_lines", "spans", "matches", "class_id", "keep", "n_found", "item_ids", "target", "lang_pred"):
            df = df.withColumn(c, F.lit("clash"))
    return df
