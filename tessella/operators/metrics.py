"""Counters, ratios, percentiles and scores over operation, connection and transfer rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import percent
from .series import most_recent, percentile_at


def ratio(part: Column, rest: Column, empty: float = 0.0) -> Column:
    """part / (part + rest)."""
    return F.when(part + rest > 0, part / (part + rest)).otherwise(empty)


def compression_ratio(before: Column, after: Column) -> Column:
    return F.when(before > 0, after / before).otherwise(1.0)


def latency_percentiles(ops: DataFrame, keys: list[str], order: list[Column], value: str = "ms", window: int = 1000) -> DataFrame:
    """p50, p95 and p99 of the last ``window`` operations of each key, in whole milliseconds."""
    recent = most_recent(ops, keys, order, window)
    out = recent.groupBy(*keys).agg(F.sort_array(F.collect_list(F.floor(F.col(value)).cast("long"))).alias("v"))
    return out.select(*keys, F.size("v").cast("long").alias("samples"), *(percentile_at(F.col("v"), p).alias(f"p{p}") for p in (50, 95, 99)))


def io_metrics(ops: DataFrame, uptime_s: float) -> DataFrame:
    """Of op, ms, bytes: counts, bytes, mean whole milliseconds, MiB and operations a second."""
    is_ = lambda op: F.col("op") == op
    of = lambda op, c: F.coalesce(F.sum(F.when(is_(op), c)), F.lit(0))
    whole = F.floor(F.col("ms")).cast("long")
    out = ops.agg(F.count("*").alias("total"), F.count_if(is_("read")).alias("reads"), F.count_if(is_("write")).alias("writes"), of("read", F.col("bytes")).alias("bytes_read"), of("write", F.col("bytes")).alias("bytes_written"), of("read", whole).alias("read_ms"), of("write", whole).alias("write_ms"), F.count_if("error").alias("errors"))
    rate = (lambda c: c / uptime_s) if uptime_s > 0 else (lambda c: F.lit(0.0))
    mean = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return out.select("total", "reads", "writes", "errors", "bytes_read", "bytes_written", mean("read_ms", "reads").alias("avg_read_ms"), mean("write_ms", "writes").alias("avg_write_ms"), rate((F.col("bytes_read") + F.col("bytes_written")) / 1048576.0).alias("throughput_mbps"), rate(F.col("total").cast("double")).alias("ops_per_s"))


def batch_stats(batches: DataFrame) -> DataFrame:
    return batches.agg(F.count("*").alias("batches"), F.sum("n").cast("long").alias("chunks"), F.avg("n").alias("avg_batch"), F.lit(100).cast("long").alias("max_batch"))


def health_score(total: Column, errors: Column, hit_rate: Column, throughput: Column, partials: Column, temps: Column) -> Column:
    """1 less what each problem costs, in tenths, so that the edges at 0.9, 0.7 and 0.4 are met exactly."""
    rate = F.when(total > 0, errors / total).otherwise(0.0)
    lost = F.when(rate > 0.05, 3).when(rate > 0.01, 1).otherwise(0) + F.when(hit_rate < 0.7, 2).when(hit_rate < 0.8, 1).otherwise(0) + F.when(throughput < 50, 2).otherwise(0) + F.when(partials > 100, 1).otherwise(0) + F.when(temps > 1000, 1).otherwise(0)
    return F.greatest(10 - lost, F.lit(0)) / 10.0


def health_status(score: Column) -> Column:
    return F.when(score >= 0.9, "Healthy").when(score >= 0.7, "Warning").when(score >= 0.4, "Critical").otherwise("Unknown")


# What is recommended, in order; {} stands for a count.
ADVICE = (
    "Storage health is degraded - run maintenance",
    "Clean up {} orphaned files",
    "High number of temp files - run cleanup_expired_partials()",
    "Shard distribution is unbalanced - consider rehashing",
    "Data corruption detected - run repair immediately",
    "Remove {} corrupt objects",
    "Low cache hit rate - consider increasing cache size",
    "Low throughput - check disk performance and consider SSD",
    "High read latency - optimize storage backend",
)


def recommendations(score: Column, orphaned: Column, temps: Column, unbalanced: Column, integrity: Column, corrupt: Column, hit_rate: Column, throughput: Column, read_ms: Column) -> Column:
    """The advice whose condition holds, as an array of texts."""
    holds = (score < 0.8, orphaned > 0, temps > 100, unbalanced, integrity < 0.95, corrupt > 0, hit_rate < 0.7, throughput < 50, read_ms > 10)
    counts = {1: orphaned, 5: corrupt}
    texts = [F.replace(F.lit(t), F.lit("{}"), counts[i].cast("string")) if i in counts else F.lit(t) for i, t in enumerate(ADVICE)]
    return F.filter(F.array(*(F.when(c, t) for c, t in zip(holds, texts, strict=True))), lambda t: t.isNotNull())


def connection_summary(connections: DataFrame) -> DataFrame:
    """Of status, rtt_ms, bytes: connections of each status, mean round trip, bytes."""
    count = lambda s: F.count_if(F.col("status") == s).alias(s.lower())
    return connections.agg(F.count("*").alias("connections"), *(count(s) for s in ("Healthy", "Degraded", "Unhealthy", "Failing")), F.avg("rtt_ms").alias("avg_rtt_ms"), F.sum("bytes").alias("bytes"))


def network_stats(peers: DataFrame) -> DataFrame:
    return peers.agg(F.count("*").alias("peers"), F.sum("throughput").alias("throughput"), F.avg("rtt_ms").alias("avg_rtt_ms"), F.avg("loss").alias("avg_loss"))


def reconnection_stats(peers: DataFrame) -> DataFrame:
    """Peers in each state, retries, and those connected after a retry."""
    count = lambda s: F.count_if(F.col("state") == s).alias(s.lower())
    return peers.agg(*(count(s) for s in ("Connected", "Reconnecting", "Disconnected", "Failed")), F.sum("retries").cast("long").alias("retries"), F.count_if((F.col("state") == "Connected") & (F.col("retries") > 0)).alias("recovered"))


def pool_stats(connections: DataFrame) -> DataFrame:
    return connections.groupBy("peer_id").agg(F.count("*").alias("connections"), F.count_if(F.col("status") == "Healthy").alias("healthy"), F.count_if(F.col("status") != "Healthy").alias("unhealthy"))


def stream_stats(messages: DataFrame) -> DataFrame:
    """Sent bytes and messages of each stream."""
    return messages.groupBy("stream_id").agg(F.sum("bytes").alias("sent_bytes"), F.count("*").alias("sent_messages"))


def chunk_server_stats(requests: DataFrame) -> DataFrame:
    """Of found, cached, bytes, ms: chunks served and missed, bytes, mean latency of requests that did not hit the cache."""
    return requests.agg(F.count_if("found").alias("served"), F.count_if(~F.col("found")).alias("not_found"), F.sum(F.when(F.col("found"), F.col("bytes"))).alias("bytes"), F.avg(F.when(F.col("found") & ~F.col("cached"), F.col("ms"))).alias("avg_ms"))


def resume_stats(sessions: DataFrame) -> DataFrame:
    """Of progress (percent), retries, status, saved: sessions that can go on, share that got anywhere, bytes saved."""
    can = (F.col("progress") < 100) & (F.col("retries") > 0) & (F.col("status") != "Completed")
    return sessions.agg(F.count("*").alias("sessions"), F.count_if(can).alias("resumable"), (F.count_if(F.col("progress") > 0) / F.count("*") * 100).alias("success_percent"), F.sum("saved").alias("saved_bytes"))


def resume_success(completed: Column, cancelled: Column) -> Column:
    return ratio(completed, cancelled, 1.0)


def recovery_outcome(age_hours: Column, errors: Column) -> Column:
    """Abandoned above 24 whole hours, failed at the third error, else to be tried again."""
    return F.when(age_hours > 24, "abandoned").when(errors >= 3, "failed").otherwise("retry")


def progress_percent(done: Column, total: Column) -> Column:
    """A transfer of nothing is complete."""
    return percent(done, total, 100.0)


def transfer_progress(chunks: DataFrame) -> DataFrame:
    """Of transfer_id, received, total_bytes: ratio of chunks, and bytes by that ratio."""
    out = chunks.groupBy("transfer_id").agg(F.count_if("received").alias("got"), F.count("*").alias("needed"), F.max("total_bytes").alias("total_bytes"))
    share = F.when(F.col("needed") > 0, F.col("got") / F.col("needed")).otherwise(0.0)
    return out.select("transfer_id", "got", "needed", share.alias("progress"), (F.col("total_bytes") * share).alias("bytes_done"))


def queue_totals(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("transfer_id").agg(F.sum("size").alias("total_bytes"), F.count("*").alias("chunks"))


def active_peers(peers: DataFrame) -> DataFrame:
    return peers.agg(F.count_if(F.col("state").isin("Negotiating", "Transferring")).alias("active"), F.count("*").alias("peers"))
