"""Putting retrieved text together for language-model prompts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEPARATOR = "\n\n---\n\n"


def joined_in_order(rows: DataFrame, group: str, order: str, text: str = "text", separator: str = SEPARATOR, alias: str = "context") -> DataFrame:
    """For each group its texts in order, joined."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return rows.groupBy(group).agg(F.array_join(F.transform(parts, lambda x: x["t"]), separator).alias(alias))


def rag_prompts(hits: DataFrame, contents: DataFrame, questions: DataFrame, k: int = 3, query: str = "query_id", key: str = "doc_id", text: str = "text", question: str = "question") -> DataFrame:
    """(query, prompt): the contents of the ``k`` best hits by rank, and the question."""
    context = joined_in_order(hits.where(F.col("rank") <= k).join(contents, key), query, "rank", text)
    rows = questions.join(context, query, "left")
    prompt = F.concat(F.lit("Answer from the context.\n\nContext:\n"), F.coalesce("context", F.lit("")), F.lit("\n\nQuestion: "), F.col(question))
    return rows.select(query, prompt.alias("prompt"))


def lookup_archives(ids: list[str], archives: DataFrame, names: list[str] | None = None, key: str = "archive_id") -> DataFrame:
    """Those of ``ids`` that are there, in order, with a display name: the one given at its place."""
    named = [(p, i, names[p] if names and p < len(names) else None) for p, i in enumerate(ids)]
    asked = archives.sparkSession.createDataFrame(named, f"pos int, {key} string, given string")
    rows = F.broadcast(asked).join(archives, key)
    return rows.withColumn("display_name", F.coalesce("given", key)).drop("given").orderBy("pos")


def memory_prompts(files: DataFrame, questions: DataFrame, memory: str = "memory_id", name: str = "source_file", text: str = "content", question: str = "question") -> DataFrame:
    """(memory, prompt): all files of a memory under their names, then the question."""
    part = F.concat(F.lit("=== "), F.col(name), F.lit(" ===\n"), F.col(text))
    whole = joined_in_order(files.withColumn("_part", part), memory, name, "_part", "\n\n", "_files")
    prompt = F.concat(F.lit("File id: "), F.col(memory).cast("string"), F.lit("\n\n"), F.col("_files"), F.lit("\n\nQuestion: "), F.col(question))
    return whole.join(questions, memory).select(memory, prompt.alias("prompt"))


def complete(prompts: DataFrame, client: Callable[[list[str]], list[str | None]], prompt: str = "prompt") -> DataFrame:
    """Adds response and error by ``client``, which answers a list of prompts (None: no answer)."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            try:
                found = [(a, None if a is not None else "no answer") for a in client(list(batch))]
            except Exception as e:  # the batch's rows carry the error
                found = [(None, str(e) or type(e).__name__)] * len(batch)
            yield pd.DataFrame(found, columns=["response", "error"])

    rows = prompts.withColumn("_r", F.pandas_udf(run, "response string, error string")(F.col(prompt)))
    return rows.withColumns({"response": F.col("_r.response"), "error": F.col("_r.error")}).drop("_r")
