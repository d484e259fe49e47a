"""Conversations: titles, memory, the branch a message takes, prompts, answers and their trace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from archivolt.functions import fixed, pii, text
from archivolt.operators import lifecycle

CLIP = 120


def title(c: Column) -> Column:
    """A conversation's title: the first characters of what it is called, or a standard one."""
    t = F.coalesce(c, F.lit(""))
    return F.substring(F.when(t == "", fixed.NEW_CONVERSATION).otherwise(t), 1, CLIP)


def opened(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Stored conversations and new ones (user_id, title, created_at), numbered from the highest number on."""
    start = stored.agg(F.coalesce(F.max("conversation_id"), F.lit(0)).alias("_top"))
    w = Window.partitionBy(F.lit(0)).orderBy("created_at", "user_id", "title")  # new rows of one request
    rows = new.withColumn("_n", F.row_number().over(w)).crossJoin(F.broadcast(start))
    made = rows.select((F.col("_top") + F.col("_n")).cast("long").alias("conversation_id"), "user_id", title(F.col("title")).alias("title"), "created_at", F.col("created_at").alias("updated_at"))
    return stored.unionByName(made)


def of_user(conversations: DataFrame, user_id: int) -> DataFrame:
    """A user's own conversations, the latest first."""
    return conversations.where(F.col("user_id") == user_id).orderBy(F.desc("updated_at"), F.desc("conversation_id"))


def without(t: dict[str, DataFrame], user_id: int, conversation_id: int) -> dict[str, DataFrame]:
    """Tables without a conversation and its messages, if it is the user's own."""
    mine = (F.col("user_id") == user_id) & (F.col("conversation_id") == conversation_id)
    gone = t["conversations"].where(mine).select("conversation_id")
    return {**t, "conversations": t["conversations"].where(~mine), "messages": t["messages"].join(F.broadcast(gone), "conversation_id", "left_anti")}


def titled(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """Conversations named after their first question."""
    first = messages.where("role = 'user'").groupBy("conversation_id").agg(F.min_by("content", "turn").alias("_q"))
    named = conversations.join(first, "conversation_id", "left")
    return named.withColumn("title", F.when(F.col("_q").isNull(), F.col("title")).otherwise(title(F.col("_q")))).drop("_q")


def branch(question: Column, sources: Column, least: int = 1) -> Column:
    """What answers a message: small talk, a polite refusal without evidence, or the documents."""
    return F.when(text.is_small_talk(question), "chat").when(F.coalesce(sources, F.lit(0)) < least, "refuse").otherwise("answer")


def prompt(context: Column, history: Column) -> Column:
    """The context, after the conversation's memory if there is any."""
    return F.when(F.coalesce(history, F.lit("")) == "", context).otherwise(F.concat(F.lit(fixed.HISTORY_HEAD), history, F.lit(fixed.CONTEXT_HEAD), context))


def history(messages: DataFrame, n: int = 4) -> DataFrame:
    return lifecycle.memory(messages, n)


def source_lines(sources: DataFrame, most: int = 3) -> DataFrame:
    """Per query the lines that name its first sources: query_id, rank, document_name, page_numbers, section."""
    pages = F.concat(F.lit("["), F.array_join(F.transform("page_numbers", lambda p: p.cast("string")), ", "), F.lit("]"))
    section = F.when(F.coalesce("section", F.lit("")) != "", F.concat(F.lit(" (sección: "), "section", F.lit(")"))).otherwise("")
    line = F.concat(F.lit("- "), "document_name", F.lit(", pág. "), pages, section)
    few = sources.where(F.col("rank") < most).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", line.alias("line")))).alias("_l"))
    return few.select("query_id", F.array_join(F.transform("_l", lambda x: x["line"]), "\n").alias("lines"))


def finished(answer: Column, sources: Column, lines: Column) -> Column:
    """An answer as it is shown: source lines after one that cites none or others, personal data masked."""
    cited = F.coalesce(text.is_grounded(answer, sources), F.lit(False)) | (F.coalesce(lines, F.lit("")) == "")
    return pii.mask(F.when(cited, answer).otherwise(F.concat(answer, F.lit(fixed.SOURCES_HEAD), lines)))


def trace(queries: DataFrame, scored: DataFrame, kept: DataFrame, answers: DataFrame, least: float) -> DataFrame:
    """Audit rows of answered and refused questions, with what each rests on as JSON.

    queries: query_id, query_text; scored and kept: hits with query_id,
    chunk_id, document_id, page_numbers, rank, evidence; answers: query_id,
    answer. A refused question (no hit kept) has its best score and the
    threshold instead of chunks and answer.
    """
    best = scored.groupBy("query_id").agg(F.max("evidence").alias("best"))
    chunk = F.struct("rank", F.struct("chunk_id", "document_id", F.col("page_numbers").alias("pages")).alias("chunk"))
    used = kept.groupBy("query_id").agg(F.sort_array(F.collect_list(chunk)).alias("_u"))
    rows = queries.join(best, "query_id", "left").join(used, "query_id", "left").join(answers, "query_id", "left")
    refused = F.to_json(F.struct(F.col("query_text").alias("question"), F.lit(True).alias("abstained"), F.coalesce("best", F.lit(0.0)).alias("best_score"), F.lit(least).alias("threshold")))
    full = F.to_json(F.struct(F.col("query_text").alias("question"), F.transform("_u", lambda x: x["chunk"]).alias("chunks"), F.col("answer")))
    detail = F.when(F.col("_u").isNull(), refused).otherwise(full)
    return rows.select("query_id", F.lit("query").alias("action"), F.lit("query").alias("resource_type"), F.coalesce(F.size("_u"), F.lit(0)).alias("n_sources"), detail.alias("detail"))
