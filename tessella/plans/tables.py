"""Queries on stored state: sessions, listings, wire rows, small rules that need no plan of their own."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import manifest, metrics, state_tables, store, transfer
from ..scratch import Scratch
from ..sources.files import as_json, walk_order, walk_ranks
from ..sources.views import EPOCH
from .registry import query


@query("select id, priority from (select id, part % 256 as priority from pending) x order by priority desc, id limit 25", ["pending"])
def stream_queue(v):
    return transfer.stream_queue(v.pending().select("id", (F.col("part") % 256).alias("priority"), F.col("id").alias("seq")), 25).select("id", "priority")


@query(f"select path from files where {EPOCH} + 116400 - mtime_s > 86400", ["files"])
def expired_partials(v):
    return store.expired_partials(v.files(), EPOCH + 116400).select("path")


@query("select path, row_number() over (order by string_split(path, '/')) as rank from files order by string_split(path, '/') limit 50", ["files"])
def walk_page(v):
    """The first 50 paths in the order of a folder walk: a page is the feature."""
    page = walk_order(v.files().select("path")).limit(50)
    return page.select("path", F.row_number().over(Window.orderBy(F.split("path", "/"))).cast("long").alias("rank"))


@query("select id, priority, row_number() over (order by priority desc, id) as rank from (select id, part % 256 as priority from pending) x", ["pending"])
def stream_order(v):
    """The whole queue; stream_queue is its head."""
    requests = v.pending().select("id", (F.col("part") % 256).alias("priority"), F.col("id").alias("seq"))
    return transfer.stream_order(requests, Scratch(v.spark, "stream-order")).select("id", "priority", "rank")


@query("select path, row_number() over (order by string_split(path, '/')) as rank from files", ["files"])
def walk_paths(v):
    """Every path in the order of a folder walk; walk_page is its first page."""
    return walk_ranks(v.files().select("path"), Scratch(v.spark, "walk")).select("path", "rank")


@query("select session_id from sessions where status = 'Interrupted' and retries > 0", ["sessions"])
def resumable_sessions(v):
    pending = F.when(F.col("retries") > 0, F.array(F.lit("c"))).otherwise(F.array().cast("array<string>"))
    return transfer.resumable(v.sessions().withColumn("pending", pending)).select("session_id")


@query("select session_id, case retries when 0 then 'b,c' when 1 then 'a,c' when 2 then 'a,b' else 'a,b,c' end as pending, case retries when 0 then '' else 'a' end as failed, case retries when 0 then 'x,a' when 1 then 'x,b' when 2 then 'x,c' else 'x' end as completed from sessions", ["sessions"])
def session_transitions(v):
    """Chunk a, b, c or x is completed in a session with a, b, c pending, a failed and x completed."""
    item = F.element_at(F.array(*map(F.lit, "abcx")), (F.col("retries") + 1).cast("int"))
    rows = v.sessions().select("session_id", transfer.mark_completed(F.array(*map(F.lit, "abc")), F.array(F.lit("a")), F.array(F.lit("x")), item).alias("s"))
    return rows.select("session_id", *(F.array_join(f"s.{c}", ",").alias(c) for c in ("pending", "failed", "completed")))


@query("select 'objects/zz/' || doc_id as path, hash from objects where doc_id % 40 = 0", ["objects"])
def orphaned_files(v):
    """Stored paths that are none of an object's; every 40th object has such a file beside it."""
    objects = v.objects()
    extra = objects.where("doc_id % 40 = 0").select(F.concat(F.lit("objects/zz/"), F.col("doc_id").cast("string")).alias("path"), "hash")
    listing = objects.select(store.shard_path(F.col("hash")).alias("path"), "hash").unionByName(extra)
    return store.orphans(listing, objects).select("path", "hash")


@query("select arg_max(path, (size, path)) as path, max(size) as size from (select 'src0/a.tmp.' || doc_id as path, size from files where doc_id % 3 = 0) x", ["files"])
def resumable_temp(v):
    listing = v.files().select(F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("src0/a.tmp."), F.col("doc_id").cast("string"))).otherwise(F.col("path")).alias("path"), "size")
    return store.resumable_temp(listing, "src0/a")


@query("select doc_id % 20 as manifest_id, f.path, f.size, f.content_hash from files f", ["files"])
def manifest_entries(v):
    """The join of manifests, their file lists and files."""
    files = v.files().select(F.col("doc_id").alias("file_id"), "path", "size", "content_hash")
    listed = files.select((F.col("file_id") % 20).alias("manifest_id"), "file_id")
    manifests = listed.select("manifest_id").distinct()
    return manifest.entries_of(manifests, listed, files).select("manifest_id", "path", "size", "content_hash")


@query("select path, size from manifest_b where path in (select path from manifest_a where size > 2000)", ["manifest_a", "manifest_b"])
def entry_details(v):
    return manifest.details(v.manifest_b(), v.manifest_a().where("size > 2000")).select("path", "size")


@query("select path, lower(hex(unhex(content_hash))) as content_hash, len(chunk_hashes)::bigint as n_chunks, case when doc_id % 4 = 0 then 7 else mtime_s end as mtime_s from manifest_a", ["manifest_a"])
def wire_round_trip(v):
    rows = state_tables.wire_entry(v.manifest_a().withColumn("mtime_s", F.when(F.col("doc_id") % 4 != 0, F.col("mtime_s"))))
    return state_tables.from_wire(rows, 7).select("path", "content_hash", F.size("chunk_hashes").cast("long").alias("n_chunks"), "mtime_s")


@query("select session_id, case when session_id % 3 = 0 then 'Idle' else status end as tag, case when session_id % 3 = 0 then -1 else progress end::double as progress from sessions", ["sessions"])
def peer_states(v):
    """States as JSON texts; every third is no JSON and reads as Idle."""
    text = F.when(F.col("session_id") % 3 == 0, "{broken").otherwise(F.to_json(F.struct(F.col("status").alias("tag"), F.col("progress").cast("double").alias("progress"))))
    return v.sessions().select("session_id", state_tables.peer_state(text).alias("s")).select("session_id", "s.tag", F.coalesce("s.progress", F.lit(-1.0)).alias("progress"))


@query("select '{\"object_count\":' || count(*) || ',\"total_bytes\":' || sum(size)::bigint || '}' as json from objects", ["objects"])
def metrics_json(v):
    return as_json(store.statistics(v.objects()))


@query("select count(*) as peers, count(*) filter (where acc > 0) as connected, (select count(distinct source) from documents) as folders from (select s_acctbal as acc from supplier) x")
def daemon_status(v):
    peers = v.table("supplier").select((F.col("s_acctbal") > 0).alias("connected"))
    return state_tables.status(peers, v.table("documents").select("source").distinct())


@query("select op, round(count(*) filter (where error)::double / count(*), 9) as hit_rate, round(sum(ms) / sum(bytes), 12) as compression_ratio, round(case when count(*) filter (where not error) + 0 > 0 then count(*) filter (where error)::double / count(*) else 1.0 end, 9) as resume_success from ops group by op", ["ops"])
def ratios(v):
    n = v.ops().groupBy("op").agg(F.count_if("error").alias("a"), F.count_if(~F.col("error")).alias("b"), F.sum("ms").alias("ms"), F.sum("bytes").alias("bytes"))
    a, b = F.col("a"), F.col("b")
    return n.select("op", F.round(metrics.ratio(a, b), 9).alias("hit_rate"), F.round(metrics.compression_ratio(F.col("bytes"), F.col("ms")), 12).alias("compression_ratio"), F.round(metrics.resume_success(a, b), 9).alias("resume_success"))


@query("select session_id, round(case when retries = 0 then 100.0 else progress * 100.0 / (retries * 101) end, 9) as percent from sessions", ["sessions"])
def progress_percent(v):
    return v.sessions().select("session_id", F.round(metrics.progress_percent(F.col("progress").cast("double"), F.col("retries") * 101), 9).alias("percent"))
