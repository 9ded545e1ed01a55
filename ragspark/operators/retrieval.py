"""Retrieval assembly (RET-01..08): routing, de-duplication, cited context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Openings of small talk, matched at the start of the lower-cased question.
OPENINGS = [
    "hi", "hello", "hey", "hiya", "howdy", "how are you", "how're you", "how do you do", "what's up", "whats up", "wassup",
    "good morning", "good afternoon", "good evening", "thanks", "thank you", "thx", "bye", "goodbye", "see you", "farewell",
    "yes", "no", "ok", "okay", "sure", "alright", "tell me about yourself", "who are you", "what can you do", "what do you do",
    "help", "can you help", "sorry", "excuse me", "pardon", "nice", "good", "great", "awesome", "cool", "wow", "please", "pls",
]
QUESTION_OPENING = r"(what|who|where|when|why|how)\s+(are you|is it|was it)"
QUESTION_WORDS = ["what", "how", "why", "when", "where", "who", "which"]
SOCIAL_WORDS = ["hi", "hello", "hey", "thanks", "bye", "good", "nice", "great", "cool", "awesome"]
BLANKS = " \t\n\x0b\x0c\r"
CONVERSATIONAL = "^(" + "|".join([*OPENINGS, QUESTION_OPENING]) + ")"


def is_conversational(question: Column) -> Column:
    q = F.lower(F.btrim(question, F.lit(BLANKS)))
    short = (F.length(q) < 10) & ~q.rlike("|".join(QUESTION_WORDS))
    words = F.size(F.filter(F.split(q, r"\s+"), lambda w: w != ""))
    return q.rlike(CONVERSATIONAL) | short | (q.rlike("|".join(SOCIAL_WORDS)) & (words <= 3))


def route(questions: DataFrame, corrected: DataFrame) -> DataFrame:
    """Adds route: corrected, conversational or retrieval. ``corrected`` has qid of questions with a stored answer."""
    known = corrected.select(F.col("qid").alias("_known")).distinct()
    joined = questions.join(known, questions["qid"] == known["_known"], "left")
    kind = F.when(F.col("_known").isNotNull(), "corrected").when(is_conversational(F.col("question")), "conversational").otherwise("retrieval")
    return joined.withColumn("route", kind).drop("_known")


def contextual_query(context: Column, question: Column) -> Column:
    return F.when(F.coalesce(context, F.lit("")) == "", question).otherwise(F.concat(context, F.lit("\n\nUser: "), question))


def dedup_hits(hits: DataFrame, prefix: int = 50, cap: int | None = 30) -> DataFrame:
    """Union of hits in (variant, rank) order; the first of each source and text prefix stays; at most ``cap``, a parameter of the prompt."""
    key = F.concat(F.col("source"), F.lit("_"), F.substring("text", 1, prefix))
    first = Window.partitionBy(key).orderBy("variant", "rank")
    out = hits.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n").orderBy("variant", "rank")
    return out.limit(cap) if cap else out


def citation(i: Column, file_name: Column, folder: Column | None = None, page: Column | None = None, modified: Column | None = None) -> Column:
    """``[Document i] (Source: f - folder, Page p, Modified: d)``; a missing name is Unknown and has no source, an empty one stays empty."""
    parts = [F.lit(" (Source: "), file_name]
    for lead, c in ((" - ", folder), (", Page ", page)):
        if c is not None:
            parts.append(F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(lead), c)).otherwise(""))
    if modified is not None:
        day = F.date_format(F.try_to_timestamp(F.regexp_replace(modified, "Z$", "+00:00")), "yyyy-MM-dd")
        parts.append(F.when(day.isNotNull(), F.concat(F.lit(", Modified: "), day)).otherwise(""))
    name = F.coalesce(file_name, F.lit("Unknown"))
    return F.concat(F.lit("[Document "), i.cast("string"), F.lit("]"), F.when(name != "Unknown", F.concat(*parts, F.lit(")"))).otherwise(""))


def cited_context(docs: DataFrame) -> DataFrame:
    """One row: the blocks of (n, source, text) in order. The context of one prompt, bounded by the cap of dedup_hits."""
    block = F.concat(citation(F.col("n"), F.col("source")), F.lit("\n"), F.col("text"))
    rows = F.array_sort(F.collect_list(F.struct("n", block.alias("b"))))
    return docs.agg(F.array_join(F.transform(rows, lambda x: x["b"]), "\n\n---\n\n").alias("context"), F.count(F.lit(1)).alias("n_docs"))


def plain_context(docs: DataFrame, by: str = "qid") -> DataFrame:
    """``Document i:`` blocks of each question's hits (qid, rank, text)."""
    block = F.concat(F.lit("Document "), F.col("rank").cast("string"), F.lit(":\n"), F.col("text"))
    rows = F.array_sort(F.collect_list(F.struct("rank", block.alias("b"))))
    return docs.groupBy(by).agg(F.array_join(F.transform(rows, lambda x: x["b"]), "\n\n").alias("context"))


def debug_preview(docs: DataFrame, first: int = 10, chars: int = 200) -> DataFrame:
    text = F.when(F.length("text") > chars, F.concat(F.substring("text", 1, chars), F.lit("..."))).otherwise(F.col("text"))
    return docs.filter(F.col("rank") <= first).select("qid", "rank", F.coalesce("source", F.lit("Unknown")).alias("source"), text.alias("preview"), F.length("text").cast("long").alias("length"))
