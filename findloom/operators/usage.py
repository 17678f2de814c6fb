"""Token usage from event logs: cumulative counters by session, summed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Names that providers give the same counters.
ALIASES = {
    "input_tokens": ("input_tokens", "inputTokens", "prompt_tokens", "promptTokenCount", "prompt_token_count"),
    "output_tokens": ("output_tokens", "outputTokens", "completion_tokens", "candidatesTokenCount", "candidates_token_count"),
    "cached_input_tokens": ("cached_input_tokens", "cachedInputTokens", "cachedContentTokenCount", "cached_content_token_count"),
    "reasoning_output_tokens": ("reasoning_output_tokens", "reasoningOutputTokens", "thoughtsTokenCount", "thoughts_token_count"),
    "total_tokens": ("total_tokens", "totalTokens", "totalTokenCount", "total_token_count"),
}


def normalized(usage: Column) -> Column:
    """A map of counters under common names; details objects are given as ``a.b`` keys."""
    pick = lambda names: F.coalesce(*[F.try_element_at(usage, F.lit(n)) for n in names])
    more = {"cached_input_tokens": ("input_tokens_details.cached_tokens",), "reasoning_output_tokens": ("output_tokens_details.reasoning_tokens",)}
    entries = F.array(*[F.struct(F.lit(k).alias("key"), pick((*v, *more.get(k, ()))).alias("value")) for k, v in ALIASES.items()])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"] >= 0))


def by_session(events: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys, session, usage): the last cumulative usage of each session.

    ``events`` has (keys, file, line, thread_id, usage map). A session's name
    holds from the event that gives it to the next one of the file; events
    before any belong to the file's own session. A resumed session is counted
    once, by its last file and line.
    """
    order = W.partitionBy(*keys, "file").orderBy("line").rowsBetween(W.unboundedPreceding, 0)
    session = F.coalesce(F.last("thread_id", True).over(order), F.col("file"))
    named = events.withColumn("session", session).filter(F.size("usage") > 0)
    return named.groupBy(*keys, "session").agg(F.max_by("usage", F.struct("file", "line")).alias("usage"))


def totals(sessions: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys, counter, n): counters summed over sessions, or over runs to merge them."""
    each = sessions.select(*keys, F.explode("usage").alias("counter", "n")).filter("n >= 0")
    return each.groupBy(*keys, "counter").agg(F.sum("n").alias("n"))


def case_counts(cases: DataFrame, expected: int) -> DataFrame:
    """One row: cases by status, and those not begun."""
    n = lambda s: F.count_if(F.col("status") == s)
    return cases.agg(n("SUCCESS").alias("success"), n("FAILED").alias("failed"), n("INTERRUPTED").alias("interrupted"), n("RUNNING").alias("running"), F.count("*").alias("started")).withColumn(
        "pending", F.lit(expected) - F.col("started")
    )


def event_violations(events: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (rule_id, key, detail): logs whose turns do not open once, close once and end.

    ``events`` has (keys, line, type).
    """
    n = lambda t: F.count_if(F.col("type") == t)
    at = F.struct("line", "type")
    g = events.groupBy(*keys).agg(
        n("thread.started").alias("threads"), n("turn.started").alias("opened"), n("turn.completed").alias("closed"),
        F.count_if(F.col("type").isin("turn.failed", "error")).alias("failed"), F.max_by("type", at).alias("last"), F.min_by("type", at).alias("first"),
    )
    tests = {
        "THREADS": F.col("threads") != 1,
        "FIRST_EVENT": ~F.col("first").eqNullSafe(F.lit("thread.started")),
        "OPEN_TURN": F.col("opened") != F.col("closed"),
        "FAILED_TURN": F.col("failed") > 0,
        "LAST_EVENT": ~F.col("last").eqNullSafe(F.lit("turn.completed")),
    }
    found = F.array_compact(F.array(*[F.when(t, F.lit(k)) for k, t in tests.items()]))
    return g.select(F.explode(found).alias("rule_id"), F.concat_ws(" ", *keys).alias("key"), F.col("last").alias("detail"))
