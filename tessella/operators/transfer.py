"""What to ask for, what to serve, what has arrived."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..numbering import numbered
from ..scratch import Scratch
from .series import first_write, last_write


def all_wanted(entries: DataFrame) -> DataFrame:
    """Every chunk hash of a manifest, once."""
    return entries.select(F.explode("chunk_hashes").alias("hash")).distinct()


def wanted(required: DataFrame, stored: DataFrame, most: int = 100) -> DataFrame:
    """The first hashes, by hash, of what is required and not stored; a message holds ``most``."""
    return required.select("hash").distinct().join(stored.select("hash"), "hash", "left_anti").orderBy("hash").limit(most)


def served(wants: DataFrame, sent: DataFrame, objects: DataFrame, most: int = 10) -> DataFrame:
    """Objects for the first wants not sent yet; hashes that the store lacks are passed over."""
    return wants.select("hash").distinct().join(sent.select("hash"), "hash", "left_anti").join(objects, "hash").orderBy("hash").limit(most)


def accepted(received: DataFrame, wants: DataFrame) -> DataFrame:
    """Received chunks that were wanted; the others are dropped."""
    return received.join(wants.select("hash").distinct(), "hash", "left_semi")


def remaining(needed: DataFrame, received: DataFrame) -> DataFrame:
    """Needed chunks that have not arrived, in order."""
    return needed.join(received.select("hash").distinct(), "hash", "left_anti").orderBy("seq", "hash")


def complete(wants: DataFrame, received: DataFrame) -> DataFrame:
    """One row: wanted hashes, those missing, and whether none is."""
    marked = wants.select("hash").distinct().join(received.select("hash").distinct().withColumn("__got", F.lit(1)), "hash", "left")
    return marked.agg(F.count("*").alias("wanted"), (F.count("*") - F.count("__got")).alias("missing")).withColumn("complete", F.col("missing") == 0)


def pending_page(pending: DataFrame, most: int) -> DataFrame:
    """High priority first, then the oldest; the rest is a tie-break."""
    return pending.orderBy(F.col("priority").desc(), F.col("created_s").asc(), F.col("id").asc()).limit(most)


def insert_or_ignore(pending: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return first_write(pending, keys, order)


def scheduled(requests: DataFrame, most_active: int) -> DataFrame:
    """The requests that run now. A request that is pushed again takes the priority of its last push."""
    now = last_write(requests, ["request_id"], [F.col("seq")])
    return now.orderBy(F.col("priority").desc(), F.col("request_id").asc()).limit(most_active)


def stream_queue(requests: DataFrame, most: int) -> DataFrame:
    """Priorities 0 to 255, high first, first in first out within one."""
    return requests.orderBy(F.col("priority").desc(), F.col("seq").asc()).limit(most)


def stream_order(requests: DataFrame, scratch: Scratch) -> DataFrame:
    """The whole queue: every request with its rank, counted from 1, in the order of stream_queue."""
    rows, _ = numbered(requests.withColumn("__down", -F.col("priority")), ["__down", "seq"], scratch, "rank")
    return rows.withColumn("rank", F.col("rank") + 1).drop("__down")


def chunk_states(events: DataFrame) -> DataFrame:
    """Completed, pending and failed chunks of each session from ordered events.

    Completing takes a chunk out of pending and failed. Failing takes it out of pending but leaves it completed.
    """
    last = events.groupBy("session_id", "hash").agg(F.max_by("event", F.struct("seq", "event")).alias("last"), F.max(F.when(F.col("event") == "complete", 1)).alias("done"))
    state = last.select("session_id", F.col("done").isNotNull().alias("completed"), (F.col("last") == "add").alias("pending"), (F.col("last") == "fail").alias("failed"))
    return state.groupBy("session_id").agg(*(F.count_if(c).alias(c) for c in ("completed", "pending", "failed")))


def mark_completed(pending: Column, failed: Column, completed: Column, item: Column) -> Column:
    """The same transition on arrays that serve as sets."""
    one = F.array(item)
    return F.struct(F.array_except(pending, one).alias("pending"), F.array_except(failed, one).alias("failed"), F.array_union(completed, one).alias("completed"))


def resumable(sessions: DataFrame) -> DataFrame:
    """Interrupted sessions with something pending."""
    return sessions.where((F.col("status") == "Interrupted") & (F.size("pending") > 0))


def append_once(items: Column, item: Column) -> Column:
    return F.array_union(items, F.array(item))


def count_saves(completions: DataFrame, every: int = 50) -> DataFrame:
    """Which completed chunk of a session has its state saved: every n-th, in the order of seq. Adds nth and saved.

    A repeated chunk counts again, as the counter does.
    """
    nth = F.row_number().over(Window.partitionBy("session_id").orderBy("seq"))
    return completions.withColumn("nth", nth.cast("long")).withColumn("saved", F.col("nth") % every == 0)
