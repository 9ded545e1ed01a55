"""Operator 1, quality rules: clean line by line, then reject documents that lose too much.

Every step is a DataFrame expression; one pass over the documents, no shuffle.

Defined cases: a null or blank text has no words, fails the base rule and is rejected; a repeated
doc_id is judged row by row; columns beside doc_id and text are carried by ``clean_documents`` and may
have any name (working columns live in one struct column whose name is chosen to be free).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import columns_of, free_name, materialize

#: White space between words.
SPACE = r"[\x20\x09-\x0D]"
#: A line with fewer words than this must end in a punctuation mark.
SHORT_LINE_WORDS = 8
#: A line with a larger share of ASCII punctuation is not prose.
MAX_PUNCTUATION = 0.15
#: A line with this many separators, and one to every four words at least, is a menu or a table row.
MIN_SEPARATORS = 3
#: A document that loses more than this share of its characters is rejected.
MAX_LOST = 0.3
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
BOILERPLATE = r"(?i)(all rights reserved|cookie policy|privacy policy|terms of (use|service)|enable javascript|lorem ipsum|click here to|subscribe to our|share this (page|article|post))"
TERMINAL = r"[.!?…。:;\"'”’)\]][\x20\x09-\x0D]*$"


def line_passes(line: Column) -> Column:
    """True if a line holds no word (it costs nothing) or passes the three rules."""
    words = F.size(F.split(F.btrim(line, F.lit(" \t\n\x0b\x0c\r")), SPACE + "+"))
    marks = F.length(line) - F.length(F.regexp_replace(line, r"[!-/:-@\[-`{-~]+", ""))
    bars = F.length(line) - F.length(F.translate(line, "|»›•·", ""))
    punctuation = (marks <= F.length(line) * MAX_PUNCTUATION) & ((words >= SHORT_LINE_WORDS) | line.rlike(TERMINAL))
    navigation = (bars >= MIN_SEPARATORS) & (bars * 4 >= words)
    return ~line.rlike("[^\\x20\\x09-\\x0D]") | (punctuation & ~navigation & ~line.rlike(BOILERPLATE))


def _repeat_words(words: Column, grams: Column, pairs: Column) -> Column:
    """Words inside 3-word windows that occur twice or more: the union of the windows' positions."""
    again = F.filter(
        F.transform(pairs, lambda x, i: F.when((x["h"] == F.get(pairs, i - 1)["h"]) | (x["h"] == F.get(pairs, i + 1)["h"]), x["p"])),
        lambda p: p.isNotNull(),
    )
    step = F.aggregate(
        F.array_sort(again),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, p: F.struct((a["n"] + p + 3 - F.greatest(p, a["end"])).alias("n"), (p + 3).alias("end")),
        lambda a: a["n"],
    )
    return F.when(F.size(pairs) == 0, F.lit(0)).otherwise(step)


def measure(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with one struct column of measures and verdicts, and that column's name."""
    s, w, g, p, li = (free_name(docs, f"_q_{x}") for x in ("text", "words", "grams", "pairs", "lines"))
    c = F.col
    empty_pairs = F.array().cast("array<struct<h:bigint,p:int>>")
    df = (
        docs.withColumn(s, F.coalesce("text", F.lit("")))
        .withColumn(w, F.filter(F.split(s, SPACE + "+"), lambda x: x != ""))
        .withColumn(li, F.split(s, "\n"))
        .withColumn(
            g,
            F.when(
                F.size(w) >= 3,
                F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(c(w), i), F.get(c(w), i + 1), F.get(c(w), i + 2))),
            ).otherwise(F.array().cast("array<bigint>")),
        )
        .withColumn(
            p,
            F.when(
                F.size(F.array_distinct(g)) < F.size(g),
                F.array_sort(F.transform(c(g), lambda x, i: F.struct(x.alias("h"), i.alias("p")))),
            ).otherwise(empty_pairs),
        )
    )
    out = free_name(docs, "_quality")
    full = F.filter(c(li), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    kept = F.filter(c(li), line_passes)
    li2, kp = free_name(docs, "_q_full"), free_name(docs, "_q_kept")
    df = df.withColumn(li2, full).withColumn(kp, kept)
    chars = F.length(F.array_join(c(li), ""))
    left = F.length(F.array_join(c(kp), ""))
    n = F.size(w)
    df = df.withColumn(
        out,
        F.struct(
            n.cast("long").alias("n_words"),
            F.length(F.array_join(c(w), "")).cast("long").alias("word_chars"),
            (F.length(s) - F.length(F.translate(c(s), "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
            (F.size(li2) - F.size(F.array_distinct(li2))).cast("long").alias("n_dup_lines"),
            _repeat_words(c(w), c(g), c(p)).cast("long").alias("n_repeat_words"),
            (F.size(li) - F.size(kp)).cast("long").alias("n_bad_lines"),
            ((chars - left) / F.greatest(chars, F.lit(1))).alias("lost"),
            F.array_join(c(kp), "\n").alias("clean_text"),
        ),
    )
    q = c(out)
    failed = (q["n_words"] < MIN_WORDS) | (q["n_repeat_words"] * 100 > q["n_words"] * MAX_REPEAT_PERCENT)
    df = df.withColumn(out, q.withField("base_failed", failed).withField("kept", ~failed & (q["lost"] <= MAX_LOST)))
    return df.drop(s, w, li, g, p, li2, kp), out


def quality_report(docs: DataFrame) -> DataFrame:
    """One row per input row: counts, base_failed, kept, and the lines and share of characters lost."""
    df, q = measure(docs)
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_bad_lines", "lost")
    return df.select("doc_id", *(F.col(q)[x].alias(x) for x in fields))


def clean_documents(docs: DataFrame) -> DataFrame:
    """The documents that are kept, without the lines that failed; same columns (n_chars, if there, follows the text)."""
    df, q = measure(docs)
    kept = free_name(docs, "_kept")
    # Written before the filter: pushed down, the filter would compute every measure once more.
    df = materialize(df.withColumn("text", F.col(q)["clean_text"]).withColumn(kept, F.col(q)["kept"]).drop(q)).filter(kept)
    if "n_chars" in docs.columns:
        df = df.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return df.select(*columns_of(docs))
