"""Queries on names, messages, operations, sessions and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import messages, scalar
from ..operators import metrics, retention, series, transfer
from ..operators.store import batch_flushes as flushes
from ..sources.views import AS_OF, EPOCH, Views
from ..streaming import events as ev
from ..streaming import state as machines
from .registry import query

#: Paths and names that the rules tell apart, by doc_id.
NAMES = {0: "a/.git", 1: "a/x.tmp", 2: "a/y.swp", 3: "a/z~", 4: "a/.#lock", 5: "a/#auto#", 6: "Thumbs.db", 7: "etcetera/etc/plain.txt", 8: "/home/u/.ssh/id", 9: "a..b/c", 10: "../up", 11: "a/b/c/d/e/f/g/h/i/j/k", 12: "\\x", 13: "a/b/c.txt", 14: "Dev/SYSTEM/x", 15: ".DS_Store"}
_NAMES_SQL = "names as (select doc_id, case doc_id % 17 " + " ".join(f"when {k} then '{t}'" for k, t in NAMES.items()) + " else repeat('n', 300) || '/f' end as path from documents)"


def names(v: Views) -> DataFrame:
    kind = F.col("doc_id") % 17
    path = F.when(kind == 0, NAMES[0])
    for k, t in list(NAMES.items())[1:]:
        path = path.when(kind == k, t)
    return v.table("documents").select("doc_id", path.otherwise(F.concat(F.repeat(F.lit("n"), 300), F.lit("/f"))).alias("path"))


BASE = "regexp_extract(path, '[^/]*$')"


def _ignored_sql(patterns) -> str:
    out = []
    for p in patterns:
        if p.startswith("*"):
            out.append(f"ends_with({BASE}, '{p[1:]}')")
        elif p.endswith("*"):
            out.append(f"starts_with({BASE}, '{p[:-1]}')")
        else:
            out.append(f"{BASE} = '{p}'")
    return "(" + " or ".join(out) + ")"


@query(f"select doc_id, {_ignored_sql(scalar.INDEXER_IGNORED)} as indexer, {_ignored_sql(scalar.WATCHER_IGNORED)} as watcher, (starts_with({BASE}, '.') or ends_with({BASE}, '~') or ends_with({BASE}, '.tmp') or ends_with({BASE}, '.swp') or (starts_with({BASE}, '#') and ends_with({BASE}, '#'))) as daemon from names", [], _NAMES_SQL)
def ignore_filter(v):
    p = F.col("path")
    return names(v).select("doc_id", scalar.ignored(p).alias("indexer"), scalar.ignored(p, scalar.WATCHER_IGNORED).alias("watcher"), scalar.ignored_by_daemon(p).alias("daemon"))


@query("select doc_id, (" + " or ".join(f"contains(lower(path), '{s}')" for s in scalar.SENSITIVE_PARTS) + f" or starts_with({BASE}, '.')) as sensitive from names", [], _NAMES_SQL)
def sensitive_paths(v):
    return names(v).select("doc_id", scalar.sensitive(F.col("path")).alias("sensitive"))


PARTS = "len(list_filter(string_split(path, '/'), lambda p: p <> ''))"


@query(f"select doc_id, case when strlen(path) > 4096 then 'too_long' when contains(path, '..') then 'parent' when starts_with(path, '/') or starts_with(path, '\\') then 'absolute' else 'ok' end as message, case when starts_with(path, '/') or starts_with(path, '\\') then 'absolute' when contains(path, '..') then 'parent' when {PARTS} > 10 then 'too_deep' when len(list_filter(string_split(path, '/'), lambda p: starts_with(p, '.'))) > 0 then 'hidden' else 'ok' end as store, case when path = '' then 'empty' when list_contains(string_split(path, '/'), '..') then 'parent' when {PARTS} > 32 then 'too_deep' when len(list_filter(string_split(path, '/'), lambda p: strlen(p) > 255)) > 0 then 'name_too_long' else 'ok' end as lexical from names", [], _NAMES_SQL)
def path_validation(v):
    p = F.col("path")
    return names(v).select("doc_id", scalar.message_path_problem(p).alias("message"), scalar.store_path_problem(p).alias("store"), scalar.lexical_path_problem(p).alias("lexical"))


HASHES = "hashes as (select doc_id, case doc_id % 4 when 0 then sha256(text) when 1 then substr(sha256(text), 1, 63) when 2 then '' else substr(sha256(text), 1, 63) || 'g' end as h from documents)"


@query("select doc_id, case when h = '' then 'empty' when strlen(h) <> 64 then 'length' when not regexp_matches(h, '^[0-9a-fA-F]*$') then 'not_hex' else 'ok' end as problem from hashes", [], HASHES)
def hash_validation(v):
    h = F.sha2(F.col("text").cast("binary"), 256)
    kind = F.col("doc_id") % 4
    h = F.when(kind == 0, h).when(kind == 1, F.left(h, F.lit(63))).when(kind == 2, "").otherwise(F.concat(F.left(h, F.lit(63)), F.lit("g")))
    return v.table("documents").select("doc_id", scalar.hash_problem(h).alias("problem"))


@query("select c_custkey, case when n = '' then 'empty' when strlen(n) > 64 then 'too_long' when not regexp_matches(n, '^[\\p{L}\\p{N}_-]+$') then 'characters' else 'ok' end as folder, case when n = '' then 'empty' when strlen(n) > 256 then 'too_long' when regexp_matches(n, '\\p{Cc}') then 'control' else 'ok' end as device, case when n = '' then 'empty' when strlen(n) > 64 then 'too_long' when regexp_matches(n, '[/\\\\]') then 'separator' when regexp_matches(n, '\\p{Cc}') then 'control' else 'ok' end as daemon from (select c_custkey, case c_custkey % 6 when 0 then 'a b' when 1 then repeat('é', 33) when 2 then '' when 3 then 'x/y' when 4 then 'tab' || chr(9) else 'ok_1-ß' end as n from customer) x")
def name_validation(v):
    kind = F.col("c_custkey") % 6
    n = F.when(kind == 0, "a b").when(kind == 1, F.repeat(F.lit("é"), 33)).when(kind == 2, "").when(kind == 3, "x/y").when(kind == 4, "tab\t").otherwise("ok_1-ß")
    return v.table("customer").select("c_custkey", scalar.folder_id_problem(n).alias("folder"), scalar.device_name_problem(n).alias("device"), scalar.daemon_device_name_problem(n).alias("daemon"))


@query("select doc_id, " + ", ".join(f"n_chars * 100 between {low} and {high} as {kind}" for kind, (low, high) in scalar.MESSAGE_LIMITS.items()) + " from documents")
def size_limits(v):
    return v.table("documents").select("doc_id", *(scalar.within_limit(F.col("n_chars") * 100, kind).alias(kind) for kind in scalar.MESSAGE_LIMITS))


@query("select s_suppkey, regexp_matches(x, '^[0-9]+\\.[0-9]+\\.[0-9]+$') and split_part(x, '.', 1) = '0' as message, split_part(x, '.', 1) = '1' as session from (select s_suppkey, case s_suppkey % 5 when 0 then '0.9.7' when 1 then '1.0.0' when 2 then '0.1' when 3 then '1.x.2' else '0.1.0' end as x from supplier) y")
def version_check(v):
    kind = F.col("s_suppkey") % 5
    x = F.when(kind == 0, "0.9.7").when(kind == 1, "1.0.0").when(kind == 2, "0.1").when(kind == 3, "1.x.2").otherwise("0.1.0")
    return v.table("supplier").select("s_suppkey", scalar.compatible_version(x).alias("message"), scalar.compatible_major(x).alias("session"))


@query("select doc_id, case when doc_id % 7 = 0 then 'hash_length' when strlen(text) < 256 or strlen(text) > 16777216 then 'size' when doc_id % 5 = 0 then 'hash_mismatch' else 'ok' end as chunk_data, case when doc_id % 3 = 0 then 'path_absolute' when doc_id % 7 = 0 then 'content_hash' else 'ok' end as file_entry, case when doc_id % 4 = 0 then 'folder_id_characters' when doc_id % 7 = 0 then 'chunk_hash' else 'ok' end as want, case when doc_id % 4 = 0 then 'folder_id_characters' when doc_id % 7 = 0 then 'manifest_hash' when n_chars * 1000 > 1000000 then 'file_count' else 'ok' end as summary, case when doc_id % 6 = 0 then 'version' when doc_id % 7 = 0 then 'device_id' else 'ok' end as hello from documents")
def message_validation(v):
    content = F.col("text").cast("binary")
    full = F.unhex(F.sha2(F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("?"))).otherwise(F.col("text")).cast("binary"), 256))
    h = F.when(F.col("doc_id") % 7 == 0, F.unhex(F.lit("00ff"))).otherwise(full)
    path = F.when(F.col("doc_id") % 3 == 0, "/a").otherwise("a/b")
    folder = F.when(F.col("doc_id") % 4 == 0, "a b").otherwise("folder")
    version = F.when(F.col("doc_id") % 6 == 0, "2.0.0").otherwise("0.1.0")
    none = F.array().cast("array<string>")
    return v.table("documents").select(
        "doc_id",
        messages.chunk_data_problem(h, content).alias("chunk_data"),
        messages.file_entry_problem(path, h, F.array(full)).alias("file_entry"),
        messages.want_problem(folder, F.array(h)).alias("want"),
        messages.folder_summary_problem(folder, h, F.col("n_chars") * 1000).alias("summary"),
        messages.hello_problem(version, F.lit("box"), h, none).alias("hello"),
    )


@query("select source, case when regexp_matches(source, '[05]$') then 'folder_id_characters' when min(case when doc_id % 50 = 7 then doc_id end) is not null then 'file_content_hash' else 'ok' end as problem from documents group by source")
def manifest_validation(v):
    h = F.when(F.col("doc_id") % 50 == 7, F.unhex(F.lit("00"))).otherwise(F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    each = v.table("documents").select("source", "doc_id", messages.file_entry_problem(F.lit("a/b"), h, F.array(h)).alias("p"))
    groups = each.groupBy("source").agg(F.count("*").alias("n"), F.coalesce(F.min_by("p", F.when(F.col("p") != "ok", F.col("doc_id"))), F.lit("ok")).alias("p"))
    folder = F.when(F.col("source").rlike("[05]$"), "a b").otherwise("folder")
    return groups.select("source", messages.manifest_problem(folder, F.col("n"), F.col("p"), F.unhex(F.sha2(F.col("source").cast("binary"), 256))).alias("problem"))


@query("select l_orderkey, l_linenumber, case when b < 1024 then b || ' B' when b < 1048576 then printf('%.1f KB', b / 1024.0::double) when b < 1073741824 then printf('%.1f MB', b / 1048576.0::double) else printf('%.1f GB', b / 1073741824.0::double) end as size_text, case when b <= 1048576 then 'Small' when b <= 104857600 then 'Medium' when b <= 1073741824 then 'Large' else 'Huge' end as size_class from (select l_orderkey, l_linenumber, bytes * (l_linenumber * l_linenumber * l_linenumber * 97 - 96) as b from ops) x", ["ops"])
def size_class(v):
    line = F.col("l_linenumber").cast("long")
    b = F.col("bytes") * (line * line * line * 97 - 96)
    return v.ops().select("l_orderkey", "l_linenumber", scalar.human_bytes(b).alias("size_text"), scalar.size_class(b).alias("size_class"))


@query("select s_suppkey, rtrim(regexp_replace(substr(sha256(s_name), 1, 32), '(....)', '\\1:', 'g'), ':') as fingerprint from supplier")
def device_fingerprint(v):
    return v.table("supplier").select("s_suppkey", scalar.fingerprint(F.col("s_name")).alias("fingerprint"))


@query("select event_id, left(regexp_replace(event_type || chr(7) || props || chr(10), '[\\x00-\\x08\\x0E-\\x1F\\x7F]', '', 'g'), 12) as cleaned, split_part(p, '/', 1) as top, regexp_extract(p, '[^/]*$') as base from (select *, 'u' || user_id || '/' || event_type as p from events) x")
def text_functions(v):
    p = F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("/"), F.col("event_type"))
    return v.table("events").select("event_id", scalar.sanitised(F.concat("event_type", F.lit("\x07"), "props", F.lit("\n")), 12).alias("cleaned"), scalar.first_component(p).alias("top"), scalar.basename(p).alias("base"))


@query("select s_suppkey, attempt::int as attempt, round(case when attempt = 0 then 0 else least(500.0 * pow(2, attempt - 1), 30000) end, 6) as delay_ms, round(case when attempt = 0 then 0 else least(100.0 * pow(1.5, attempt - 1), 10000) end, 6) as aggressive_ms, least(100.0 * pow(2, attempt), 30000)::double as reconnect_ms, (case when attempt < 1 then 0.0 else least(pow(2, attempt - 1), 60) end)::double as daemon_s from (select s_suppkey, unnest(range(0, 12)) as attempt from supplier) x")
def retry_delay(v):
    a = F.col("attempt")
    base, factor, most = scalar.RETRY_PRESETS["aggressive"]
    rows = v.table("supplier").select("s_suppkey", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("attempt"))
    return rows.select("s_suppkey", "attempt", F.round(scalar.retry_delay(a), 6).alias("delay_ms"), F.round(scalar.retry_delay(a, base, factor, most), 6).alias("aggressive_ms"), scalar.reconnect_delay(a).alias("reconnect_ms"), scalar.daemon_delay(a).alias("daemon_s"))


@query("select op, least(count(*), 1000)::bigint as samples, list_sort(list(ms))[len(list(ms)) * 50 // 100 + 1] as p50, list_sort(list(ms))[len(list(ms)) * 95 // 100 + 1] as p95, list_sort(list(ms))[len(list(ms)) * 99 // 100 + 1] as p99 from (select op, floor(ms)::bigint as ms, row_number() over (partition by op order by l_orderkey desc, l_linenumber desc) as n from ops) x where n <= 1000 group by op", ["ops"])
def latency_percentiles(v):
    return metrics.latency_percentiles(v.ops(), ["op"], [F.col("l_orderkey"), F.col("l_linenumber")])


@query("select count(*) as total, count(*) filter (where op = 'read') as reads, count(*) filter (where op = 'write') as writes, count(*) filter (where error) as errors, (sum(bytes) filter (where op = 'read'))::bigint as bytes_read, (sum(bytes) filter (where op = 'write'))::bigint as bytes_written, round(avg(floor(ms)) filter (where op = 'read'), 6) as avg_read_ms, round(avg(floor(ms)) filter (where op = 'write'), 6) as avg_write_ms, round(sum(bytes)::double / 1048576 / 3600, 6) as throughput_mbps, round(count(*)::double / 3600, 6) as ops_per_s from ops", ["ops"])
def io_metrics(v):
    out = metrics.io_metrics(v.ops(), 3600.0)
    return out.select("total", "reads", "writes", "errors", "bytes_read", "bytes_written", *(F.round(c, 6).alias(c) for c in ("avg_read_ms", "avg_write_ms", "throughput_mbps", "ops_per_s")))


@query("select count(*) as batches, sum(n)::bigint as chunks, round(avg(n), 6) as avg_batch, 100::bigint as max_batch from (select count(*) as n from ops group by l_orderkey) x", ["ops"])
def batch_stats(v):
    return metrics.batch_stats(v.ops().groupBy("l_orderkey").agg(F.count("*").alias("n"))).withColumn("avg_batch", F.round("avg_batch", 6))


@query("select l_orderkey, n >= 100 or b >= 200000 or age >= 150 as flush from (select l_orderkey, count(*) as n, sum(bytes) as b, sum(ms) as age from ops group by l_orderkey) x", ["ops"])
def batch_flushes(v):
    rows = v.ops().groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.sum("ms").alias("age_ms"))
    return flushes(rows, 100, 200_000, 150).select("l_orderkey", "flush")


HEALTH = "h as (select peer_id, n, errors, 0.5 + (peer_id % 6) / 10.0 as hit, (peer_id % 9) * 10.0 as thr, peer_id % 200 as partials, peer_id * 17 as temps from peers), s as (select *, greatest(10 - (case when errors::double / n > 0.05 then 3 when errors::double / n > 0.01 then 1 else 0 end + case when hit < 0.7 then 2 when hit < 0.8 then 1 else 0 end + case when thr < 50 then 2 else 0 end + case when partials > 100 then 1 else 0 end + case when temps > 1000 then 1 else 0 end), 0) / 10.0 as score from h)"


def _health(v: Views) -> DataFrame:
    p = F.col("peer_id")
    rows = v.peers().select("peer_id", "n", "errors", ((F.lit(5) + p % 6) / F.lit(10.0)).alias("hit"), ((p % 9) * 10.0).alias("thr"), (p % 200).alias("partials"), (p * 17).alias("temps"))
    return rows.withColumn("score", metrics.health_score(*(F.col(c) for c in ("n", "errors", "hit", "thr", "partials", "temps"))))


@query("select peer_id, score::double as score, case when score >= 0.9 then 'Healthy' when score >= 0.7 then 'Warning' when score >= 0.4 then 'Critical' else 'Unknown' end as status from s", ["peers"], HEALTH)
def health_score(v):
    return _health(v).select("peer_id", "score", metrics.health_status(F.col("score")).alias("status"))


@query("select peer_id, concat_ws('|', case when score < 0.8 then 'Storage health is degraded - run maintenance' end, case when partials > 0 then 'Clean up ' || partials || ' orphaned files' end, case when temps > 100 then 'High number of temp files - run cleanup_expired_partials()' end, case when peer_id % 3 = 0 then 'Shard distribution is unbalanced - consider rehashing' end, case when errors::double / n > 0.05 then 'Data corruption detected - run repair immediately' end, case when errors > 0 then 'Remove ' || errors || ' corrupt objects' end, case when hit < 0.7 then 'Low cache hit rate - consider increasing cache size' end, case when thr < 50 then 'Low throughput - check disk performance and consider SSD' end, case when thr / 2 > 10 then 'High read latency - optimize storage backend' end) as told from s", ["peers"], HEALTH)
def recommendations(v):
    c = F.col
    told = metrics.recommendations(c("score"), c("partials"), c("temps"), c("peer_id") % 3 == 0, 1 - c("errors") / c("n"), c("errors"), c("hit"), c("thr"), c("thr") / 2)
    return _health(v).select("peer_id", F.array_join(told, "|").alias("told"))


NET = "net as (select peer_id, n, bytes, errors, peer_id * 7 % 700 as rtt, (peer_id * 13 % 160)::double as thr, (peer_id % 11) / 100.0::double as loss, peer_id * 3 % 45 as idle from peers), st as (select *, case when idle > 30 then 'Unhealthy' when rtt > 500 then 'Degraded' when loss > 0.05 then 'Failing' when errors % 20 > 10 then 'Degraded' else 'Healthy' end as status, case when rtt < 50 and thr > 100 and loss < 0.001 then 'Excellent' when rtt > 200 or loss > 0.05 then 'Poor' when rtt < 100 and thr < 10 then 'Congested' else 'Good' end as condition from net)"


def _net(v: Views) -> DataFrame:
    p = F.col("peer_id")
    rows = v.peers().select("peer_id", "n", "bytes", "errors", (p * 7 % 700).alias("rtt_ms"), (p * 13 % 160).cast("double").alias("throughput"), ((p % 11) / 100.0).alias("loss"), (p * 3 % 45).alias("idle"))
    return rows.withColumn("status", scalar.connection_health(F.col("idle"), F.col("rtt_ms"), F.col("loss"), F.col("errors") % 20)).withColumn("condition", scalar.network_condition(F.col("rtt_ms"), F.col("throughput"), F.col("loss")))


@query("select peer_id, condition, case when peer_id % 2 = 0 then s // 2 else s end as streams, case when peer_id % 5 = 0 then b // 2 else b end as buffer_kb, peer_id % 2 <> 0 as compress from (select peer_id, condition, case peer_id % 3 when 0 then s * 2 when 1 then s // 2 else s end as s, b from (select *, case condition when 'Excellent' then 128 when 'Poor' then 16 when 'Congested' then 4 else 64 end::bigint as s, case condition when 'Excellent' then 16384 when 'Poor' then 2048 when 'Congested' then 512 else 8192 end::bigint as b from st) x) y", ["peers"], NET)
def network_condition(v):
    p = F.col("peer_id")
    priority = F.when(p % 3 == 0, "Critical").when(p % 3 == 1, "Low").otherwise("Normal")
    config = scalar.stream_config(F.col("condition"), priority, F.when(p % 2 == 0, 90).otherwise(10), F.when(p % 5 == 0, 2000).otherwise(10))
    return _net(v).select("peer_id", "condition", config.alias("c")).select("peer_id", "condition", "c.*")


@query("select count(*) as connections, count(*) filter (where status = 'Healthy') as healthy, count(*) filter (where status = 'Degraded') as degraded, count(*) filter (where status = 'Unhealthy') as unhealthy, count(*) filter (where status = 'Failing') as failing, round(avg(rtt), 6) as avg_rtt_ms, sum(bytes)::bigint as bytes from st", ["peers"], NET)
def connection_health(v):
    return metrics.connection_summary(_net(v)).withColumn("avg_rtt_ms", F.round("avg_rtt_ms", 6))


@query("select count(*) as peers, sum(thr) as throughput, round(avg(rtt), 6) as avg_rtt_ms, round(avg(loss), 6) as avg_loss from net", ["peers"], NET)
def network_stats(v):
    return metrics.network_stats(_net(v)).select("peers", "throughput", F.round("avg_rtt_ms", 6).alias("avg_rtt_ms"), F.round("avg_loss", 6).alias("avg_loss"))


@query("select count(*) filter (where s = 0) as connected, count(*) filter (where s = 1) as reconnecting, count(*) filter (where s = 2) as disconnected, count(*) filter (where s = 3) as failed, sum(r)::bigint as retries, count(*) filter (where s = 0 and r > 0) as recovered from (select c_custkey % 4 as s, c_custkey % 7 as r from customer) x")
def reconnection_stats(v):
    kind = F.col("c_custkey") % 4
    state = F.when(kind == 0, "Connected").when(kind == 1, "Reconnecting").when(kind == 2, "Disconnected").otherwise("Failed")
    return metrics.reconnection_stats(v.table("customer").select(state.alias("state"), (F.col("c_custkey") % 7).alias("retries")))


@query("select peer_id, count(*) as connections, count(*) filter (where not error) as healthy, count(*) filter (where error) as unhealthy from ops group by peer_id", ["ops"])
def pool_stats(v):
    return metrics.pool_stats(v.ops().select("peer_id", F.when(F.col("error"), "Failing").otherwise("Healthy").alias("status")))


@query("select l_orderkey as stream_id, sum(bytes)::bigint as sent_bytes, count(*) as sent_messages from ops group by 1", ["ops"])
def stream_stats(v):
    return metrics.stream_stats(v.ops().withColumnRenamed("l_orderkey", "stream_id"))


@query("select count(*) filter (where not error) as served, count(*) filter (where error) as not_found, (sum(bytes) filter (where not error))::bigint as bytes, round(avg(ms) filter (where not error and op = 'write'), 6) as avg_ms from ops", ["ops"])
def chunk_server_stats(v):
    return metrics.chunk_server_stats(v.ops().select((~F.col("error")).alias("found"), (F.col("op") == "read").alias("cached"), "bytes", "ms")).withColumn("avg_ms", F.round("avg_ms", 6))


@query("select count(*) as sessions, count(*) filter (where progress < 100 and retries > 0 and status <> 'Completed') as resumable, round(count(*) filter (where progress > 0) * 100.0 / count(*), 6) as success_percent, sum(saved)::bigint as saved_bytes from sessions", ["sessions"])
def resume_stats(v):
    return metrics.resume_stats(v.sessions()).withColumn("success_percent", F.round("success_percent", 6))


@query(f"select outcome, count(*) as n from (select case when ({AS_OF} - updated_s) // 3600 > 240000 then 'abandoned' when retries >= 3 then 'failed' else 'retry' end as outcome from sessions) x group by outcome", ["sessions"])
def recovery_stats(v):
    """Ages are divided by 10,000 so that the 24 hours fall inside the data."""
    hours = F.call_function("div", F.lit(AS_OF) - F.col("updated_s"), F.lit(3600)) / 10000.0
    return v.sessions().select(metrics.recovery_outcome(hours, F.col("retries")).alias("outcome")).groupBy("outcome").agg(F.count("*").alias("n"))


@query("select count(*) filter (where status in ('Interrupted', 'Active')) as active, count(*) as peers from sessions", ["sessions"])
def active_peers(v):
    state = F.when(F.col("status") == "Interrupted", "Negotiating").when(F.col("status") == "Active", "Transferring").otherwise("Idle")
    return metrics.active_peers(v.sessions().select(state.alias("state")))


@query("select session_id as transfer_id, count(*) filter (where line % 2 = 1) as got, count(*) as needed, round(count(*) filter (where line % 2 = 1)::double / count(*), 6) as progress, round(count(*) filter (where line % 2 = 1)::double / count(*) * sum(size), 3) as bytes_done from pending group by session_id", ["pending"])
def transfer_progress(v):
    rows = v.pending()
    total = rows.groupBy("session_id").agg(F.sum("size").alias("total_bytes"))
    out = metrics.transfer_progress(rows.join(total, "session_id").select(F.col("session_id").alias("transfer_id"), (F.col("line") % 2 == 1).alias("received"), "total_bytes"))
    return out.select("transfer_id", "got", "needed", F.round("progress", 6).alias("progress"), F.round("bytes_done", 3).alias("bytes_done"))


@query("select session_id as transfer_id, sum(size)::bigint as total_bytes, count(*) as chunks from pending group by session_id", ["pending"])
def queue_totals(v):
    return metrics.queue_totals(v.pending().withColumnRenamed("session_id", "transfer_id"))


@query("select id, priority, created_s from pending order by priority desc, created_s, id limit 50", ["pending"])
def pending_page(v):
    return transfer.pending_page(v.pending(), 50).select("id", "priority", "created_s")


@query("select part, session_id, id from (select *, row_number() over (partition by part, session_id order by id) as n from pending) x where n = 1", ["pending"])
def insert_or_ignore(v):
    return transfer.insert_or_ignore(v.pending(), ["part", "session_id"], [F.col("id")]).select("part", "session_id", "id")


@query("select request_id, priority from (select part as request_id, priority, row_number() over (partition by part order by id desc) as n from pending) x where n = 1 order by priority desc, request_id limit 8", ["pending"])
def transfer_schedule(v):
    return transfer.scheduled(v.pending().select(F.col("part").alias("request_id"), "priority", F.col("id").alias("seq")), 8).select("request_id", "priority")


@query("select session_id, count(*) filter (where done) as completed, count(*) filter (where last = 'add') as pending, count(*) filter (where last = 'fail') as failed from (select session_id, part, arg_max(event, (line, event)) as last, bool_or(event = 'complete') as done from (select session_id, part % 3 as part, line, case line % 3 when 0 then 'fail' when 1 then 'add' else 'complete' end as event from pending) y group by session_id, part) x group by session_id", ["pending"])
def session_chunk_state(v):
    event = F.when(F.col("line") % 3 == 0, "fail").when(F.col("line") % 3 == 1, "add").otherwise("complete")
    return transfer.chunk_states(v.pending().select("session_id", (F.col("part") % 3).alias("hash"), F.col("line").alias("seq"), event.alias("event")))


@query(f"select session_id from sessions where {EPOCH} - updated_s < 86400 * 9000", ["sessions"])
def peer_ttl(v):
    return retention.present_peers(v.sessions().withColumnRenamed("updated_s", "last_seen_s"), EPOCH, 86400 * 9000).select("session_id")


@query(f"select session_id, status from sessions where not (status = 'Completed' and {EPOCH} - updated_s > 9000 * 86400)", ["sessions"])
def session_retention(v):
    return retention.kept_sessions(v.sessions(), EPOCH, 9000).select("session_id", "status")


@query(f"select session_id, {EPOCH} - updated_s < 9000 * 86400 and progress < 100 as can_resume, status = 'Active' and {EPOCH} - updated_s > 9000 * 86400 as timed_out from sessions", ["sessions"])
def resume_eligibility(v):
    rows = v.sessions()
    can = retention.can_resume(rows, EPOCH, 9000 * 24).select("session_id", F.lit(True).alias("a"))
    out = retention.timed_out(rows, EPOCH, 9000 * 86400).select("session_id", F.lit(True).alias("b"))
    both = rows.select("session_id").join(can, "session_id", "left").join(out, "session_id", "left")
    return both.select("session_id", F.coalesce("a", F.lit(False)).alias("can_resume"), F.coalesce("b", F.lit(False)).alias("timed_out"))


@query("select key, us, id, round(case when l.us > f.us then greatest(l.bytes - f.bytes, 0) / ((l.us - f.us) / 1e6) else 0.0 end, 6) as bandwidth from (select key, us, id, min({'us': us, 'bytes': bytes}) over w as f, max({'us': us, 'bytes': bytes}) over w as l from samples window w as (partition by key order by us range between 86399999999 preceding and current row)) x", ["samples"])
def bandwidth_window(v):
    """Over a day here, because the events of a user are hours apart."""
    return series.bandwidth(v.samples(), span_s=86400).select("key", "us", "id", F.round("bandwidth", 6).alias("bandwidth"))


@query("select key, us, id, round(case when us > lu then greatest(bytes - lb, 0) / ((us - lu) / 1e6) / 1048576 else 0.0 end, 9) as speed from (select *, lag(us) over w as lu, lag(bytes) over w as lb from samples window w as (partition by key order by us, id)) x", ["samples"])
def instant_speed(v):
    return series.instant_speed(v.samples()).select("key", "us", "id", F.round("speed", 9).alias("speed"))


@query("select session_id, case when progress <= 0 then -1 when progress >= 100 then 0 else greatest(retries * 3600 * 100 // progress - retries * 3600, 0) end as eta_s, round(case when retries > 0 then saved / (retries * 3600.0::double) / 1048576 else 0.0 end, 9) as speed from sessions", ["sessions"])
def eta(v):
    elapsed = F.col("retries") * 3600
    return v.sessions().select("session_id", F.coalesce(series.eta_seconds(F.col("progress"), elapsed), F.lit(-1)).alias("eta_s"), F.round(series.average_speed(F.col("saved"), elapsed), 9).alias("speed"))


@query("select path as hash, count(*) as accesses, max(us) as last_access from fsevents group by path", ["fsevents"])
def access_stats(v):
    return series.access_stats(v.fsevents().select(F.col("path").alias("hash"), F.col("us").alias("ts")))


GAP = 6 * 3600 * 1_000_000


@query(f"select user_id, burst, max(us) as us, arg_max(kind, (us, seq)) as kind, count(*) as n_events from (select *, (sum(new) over (partition by user_id order by us, seq rows unbounded preceding))::bigint as burst from (select *, case when us - lag(us) over (partition by user_id order by us, seq) < {GAP} then 0 else 1 end as new from fsevents) y) x group by user_id, burst", ["fsevents"])
def debounce(v):
    return ev.debounced(v.fsevents(), GAP, "user_id")


SPLIT = "split as (select seq, us, old_path as path, 'Removed' as kind from fsevents where kind = 'Renamed' union all select seq, us, path, 'Created' from fsevents where kind = 'Renamed' union all select seq, us, path, kind from fsevents where kind <> 'Renamed')"


@query("select seq, us, path, kind from split", ["fsevents"], SPLIT)
def rename_explode(v):
    return ev.renames_split(v.fsevents()).select("seq", "us", "path", "kind")


@query("select w as window, nth // 100 as batch, nth, path, kind, us, seq from (select *, row_number() over (partition by w order by case kind when 'Created' then 0 when 'Removed' then 2 else 1 end, us, seq, path) - 1 as nth from (select *, us // 86400000000 as w from split) y) x", ["fsevents"], SPLIT)
def event_batches(v):
    """Windows of a day here, so that batches fill."""
    return ev.batches(v.fsevents(), 86_400_000_000, 100).select(F.col("window"), "batch", F.col("nth").cast("long").alias("nth"), "path", "kind", "us", "seq")


FOLDERS = "folders as (select distinct 'u' || user_id as folder from events where user_id % 2 = 0 union select distinct 'u' || user_id || '/k1' from events where user_id % 3 = 0)"


def _folders(v: Views) -> DataFrame:
    rows = v.table("events")
    user = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    return rows.where("user_id % 2 = 0").select(user.alias("folder")).union(rows.where("user_id % 3 = 0").select(F.concat(user, F.lit("/k1")))).distinct()


@query("select e.seq, e.path, arg_max(f.folder, length(f.folder)) as folder from fsevents e left join folders f on e.path = f.folder or starts_with(e.path, f.folder || '/') group by e.seq, e.path", ["fsevents"], FOLDERS)
def folder_lookup(v):
    return ev.folders_of(v.fsevents(), _folders(v))


@query("select distinct folder from (select arg_max(f.folder, length(f.folder)) as folder from fsevents e join folders f on e.path = f.folder or starts_with(e.path, f.folder || '/') where e.kind <> 'Removed' group by e.seq) x", ["fsevents"], FOLDERS)
def reindex_folders(v):
    return ev.folders_to_reindex(v.fsevents(), _folders(v))


@query("select t.cookie, t.path, f.path as old_path, t.us, case when f.path is null then 'Created' else 'Renamed' end as kind from (select seq // 2 as cookie, path, us from fsevents where seq % 2 = 1) t left join (select seq // 2 as cookie, path, us from fsevents where seq % 2 = 0) f on t.cookie = f.cookie and t.us - f.us between 0 and 86400000000", ["fsevents"])
def rename_pairs(v):
    """Even and odd events as the two halves of a move, with a day between them at most."""
    kind = F.when(F.col("seq") % 2 == 0, "MovedFrom").otherwise("MovedTo")
    rows = v.fsevents().select(F.call_function("div", F.col("seq"), F.lit(2)).alias("cookie"), "path", "us", kind.alias("kind"))
    return ev.paired_renames(rows, most_us=86_400_000_000)


@query("select user_id as file_id, path as old_path, nxt as path, us from (select *, row_number() over w as n, lead(path) over w as nxt from fsevents where kind = 'Renamed' window w as (partition by user_id order by us, seq)) x where n % 2 = 1 and nxt is not null", ["fsevents"])
def rename_by_file_id(v):
    return ev.paired_by_file_id(v.fsevents().withColumnRenamed("user_id", "file_id"))


@query("select count(*) filter (where kind = 'Removed') as overflows from fsevents", ["fsevents"])
def overflow_count(v):
    return ev.overflows(v.fsevents().withColumn("kind", F.when(F.col("kind") == "Removed", "Overflow").otherwise(F.col("kind"))))


def _machine_events(v: Views) -> DataFrame:
    event = F.when(F.col("kind") == "Removed", "failure").otherwise("success")
    return v.fsevents().select(F.col("user_id").cast("string").alias("key"), F.row_number().over(_by_time()).cast("long").alias("seq"), (F.col("us") / 1e6).alias("ts"), event.alias("event"), "value", "kind")


def _by_time():
    return Window.partitionBy("user_id").orderBy("us", "seq")


MACHINE = "ev as (select user_id::varchar as key, row_number() over (partition by user_id order by us, seq) as seq, us / 1e6 as ts, case when kind = 'Removed' then 'failure' else 'success' end as event, value from fsevents)"


def _folded_sql(state: str, first: str, step: str, output: str) -> dict:
    """SQL of a fold: ``first`` is the state before the first event, ``step`` makes the next one from s and e."""
    names = ", ".join(f"{x} as {n}" for x, n in zip(first.split("; "), state.split(", "), strict=True))
    start = f"s as (select key, 0::bigint as seq, {names}, '' as output from (select distinct key from ev) k union all select e.key, e.seq, {step}, {output} from s join ev e on e.key = s.key and e.seq = s.seq + 1)"
    return {"sql": "select key, seq, output from s where seq > 0", "views": ["fsevents"], "extra": f"{MACHINE}, {start}"}


# The breaker's state is tried again after a day; two failures open it, two successes close it.
TRIED = "(s.name = 'Open' and e.ts - s.since >= 86400.0)"
BREAKER = f"case when {TRIED} then case when e.event = 'failure' then 'Open' else 'HalfOpen' end when s.name = 'Open' then 'Open' when e.event = 'failure' then case when s.name = 'HalfOpen' or s.n + 1 >= 2 then 'Open' else s.name end when s.name = 'HalfOpen' and s.n + 1 >= 2 then 'Closed' else s.name end"
COUNT = f"case when {TRIED} then case when e.event = 'failure' then 0 else 1 end when s.name = 'Open' then s.n when e.event = 'failure' then case when s.name = 'HalfOpen' or s.n + 1 >= 2 then 0 else s.n + 1 end when s.name = 'HalfOpen' and s.n + 1 < 2 then s.n + 1 else 0 end"
SINCE = f"case when s.name = 'Open' and not {TRIED} then s.since when e.event = 'failure' and ({TRIED} or s.name = 'HalfOpen' or s.n + 1 >= 2) then e.ts else s.since end"


@query(**_folded_sql("name, n, since", "'Closed'; 0; 0.0::double", f"{BREAKER}, {COUNT}, {SINCE}", BREAKER))
def circuit_breaker(v):
    return machines.folded(_machine_events(v), machines.circuit_breaker(failures=2, successes=2, timeout_s=86400.0))


RECENT = "list_filter(s.accepted, lambda t: e.ts - t < 86400.0)"


@query(**_folded_sql("accepted", "[]::double[]", f"case when len({RECENT}) < 2 then list_append({RECENT}, e.ts) else {RECENT} end", f"case when len({RECENT}) < 2 then 'accepted' else 'rejected' end"))
def rate_limit(v):
    return machines.folded(_machine_events(v), machines.rate_limit(most=2, span_s=86400.0))


MESSAGE = "case when e.seq = 1 then 'hello' when e.seq = 2 then 'summary' when e.seq = 3 then 'manifest' when e.seq % 20 = 0 then 'last_chunk' when e.seq = 21 then 'verified' else 'chunk' end"
SESSION = f"case when s.state in ('Completed', 'Failed') then s.state else coalesce(case s.state || ' ' || {MESSAGE} {' '.join(f"when '{a} {b}' then '{c}'" for (a, b), c in machines.SESSION_STEPS.items())} end, 'Failed') end"


@query(**_folded_sql("state", "'Initializing'", SESSION, SESSION))
def session_states(v):
    steps = F.when(F.col("seq") == 1, "hello").when(F.col("seq") == 2, "summary").when(F.col("seq") == 3, "manifest").when(F.col("seq") % 20 == 0, "last_chunk").when(F.col("seq") == 21, "verified").otherwise("chunk")
    return machines.folded(_machine_events(v).withColumn("event", steps), machines.sync_session())


# Kinds by seq % 7: stage, file, chunk, bytes, error, retry, finish.
CHECKPOINT = {"stage": "case when e.seq % 7 = 0 then e.value::varchar else s.stage end", "files": "s.files + (e.seq % 7 = 1)::int", "chunks": "s.chunks + (e.seq % 7 = 2)::int", "bytes": "s.bytes + case when e.seq % 7 = 3 then e.value else 0.0 end", "errors": "s.errors + (e.seq % 7 = 4)::int", "retries": "s.retries + (e.seq % 7 = 5)::int", "done": "s.done or e.seq % 7 = 6"}
SHOWN = " || ', ' || ".join(f"'\"{c}\": ' || ({CHECKPOINT[c]})::varchar" for c in sorted(CHECKPOINT))


@query(**_folded_sql("stage, files, chunks, bytes, errors, retries, done", "'0'; 0; 0; 0.0::double; 0; 0; false", ", ".join(CHECKPOINT.values()), f"'{{' || {SHOWN} || '}}'"))
def checkpoint_updates(v):
    kinds = F.element_at(F.array(*(F.lit(x) for x in ("stage", "file", "chunk", "bytes", "error", "retry", "finish"))), (F.col("seq") % 7 + 1).cast("int"))
    return machines.folded(_machine_events(v).withColumn("event", kinds), machines.checkpoint())


@query("select key, count(*) as failures from (select user_id::varchar as key, us, seq, kind, max(case when kind <> 'Removed' then n end) over (partition by user_id) as since, n from (select *, row_number() over (partition by user_id order by us, seq) as n from fsevents) y) x where kind = 'Removed' and n > coalesce(since, -1) group by key having count(*) < 3", ["fsevents"])
def retry_queue(v):
    return machines.retry_queue(_machine_events(v))


@query("select key, seq, seq % 5 = 0 as saved from ev", ["fsevents"], MACHINE)
def checkpoint_saves(v):
    """Every fifth chunk here, so that saves occur in small tables."""
    done = _machine_events(v).select(F.col("key").alias("session_id"), "seq")
    return transfer.count_saves(done, 5).select(F.col("session_id").alias("key"), "seq", "saved")


SAVED = "case when e.ts - coalesce(s.since, e.ts) >= 86400.0 then {} else {} end"


@query(**_folded_sql("since", "null::double", SAVED.format("e.ts", "coalesce(s.since, e.ts)"), SAVED.format("'saved'", "'kept'")))
def checkpoint_cadence(v):
    """A day between saves here."""
    return machines.folded(_machine_events(v), machines.save_cadence(86400.0))
