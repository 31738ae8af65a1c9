"""Queries on snapshots: differences, hashes, Bloom filters, conflicts, stored objects."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import bloom, chunking, conflict, diff, manifest, series, store, transfer
from ..sources.views import EPOCH, Views
from .registry import query

DIFF = "select coalesce(a.path, b.path) as path, case when a.path is null then 'Added' when b.path is null then 'Deleted' when a.content_hash <> b.content_hash then 'Modified' end as change_type, a.content_hash as old_hash, b.content_hash as new_hash, a.size as old_size, b.size as new_size from manifest_a a full join manifest_b b on a.path = b.path"
#: Changed paths, their chunks, the chunks to fetch, and the change rows.
CHANGES = f"""d as (select * from ({DIFF}) x where change_type is not null),
w as (select b.path, unnest(range(0, len(b.chunk_hashes))) as seq, unnest(b.chunk_hashes) as hash from manifest_b b join d on b.path = d.path where d.change_type <> 'Deleted'),
held as (select distinct path, unnest(chunk_hashes) as hash from manifest_a),
req as (select w.* from w left join held h on w.path = h.path and w.hash = h.hash left join cache c on w.hash = c.hash where h.hash is null and c.hash is null),
n as (select path, count(*) as n, string_agg(hash, ',' order by seq) as required from req group by path),
changes as (select d.path, case when change_type = 'Modified' and n.n is null and old_size = new_size then 'MetadataOnly' else change_type end as change_type, coalesce(n.n, 0)::bigint as n_required, coalesce(n.required, '') as required, old_size, new_size from d left join n on d.path = n.path),
prio as (select path, change_type, n_required * 524288 as transfer_size, case when change_type = 'Modified' then 100 when change_type = 'Added' and n_required * 524288 < 1000000 then 80 when change_type = 'Added' then 50 when change_type = 'MetadataOnly' then 20 else 10 end as priority from changes)"""
SIDES = ["manifest_a", "manifest_b", "cache"]


def changes(v: Views) -> DataFrame:
    return diff.chunk_diff(v.manifest_a(), v.manifest_b(), v.cache())


def _known(*columns: str) -> list:
    """Numbers that may be null, as -1 where they are, so that every engine gives whole numbers."""
    return [F.coalesce(c, F.lit(-1)).alias(c) for c in columns]


@query(f"select path, change_type, old_hash, new_hash, coalesce(old_size, -1) as old_size, coalesce(new_size, -1) as new_size from ({DIFF}) x where change_type is not null", ["manifest_a", "manifest_b"])
def manifest_diff(v):
    return diff.manifest_diff(v.manifest_a(), v.manifest_b()).select("path", "change_type", "old_hash", "new_hash", *_known("old_size", "new_size"))


@query("select path, change_type, n_required, required, n_required * 524288 as transfer_size from changes", SIDES, CHANGES)
def chunk_diff(v):
    out = changes(v)
    return out.select("path", "change_type", F.size("required").cast("long").alias("n_required"), F.array_join("required", ",").alias("required"), diff.transfer_size(F.col("required")).alias("transfer_size"))


@query("select path, seq::int as seq, hash from req", SIDES, CHANGES)
def required_chunks(v):
    return diff.required_chunks(v.manifest_a(), v.manifest_b(), v.cache())


@query("select count(*) filter (where change_type = 'Added') as files_added, count(*) filter (where change_type = 'Modified') as files_modified, count(*) filter (where change_type = 'Deleted') as files_deleted, count(*) filter (where change_type = 'MetadataOnly') as metadata_only, coalesce(sum(new_size) filter (where change_type = 'Added'), 0)::bigint as bytes_to_add, coalesce(sum(new_size) filter (where change_type = 'Modified'), 0)::bigint as bytes_to_modify, coalesce(sum(old_size) filter (where change_type = 'Deleted'), 0)::bigint as bytes_to_delete, sum(n_required)::bigint as total_chunks, (select count(distinct hash) from req) as unique_chunks from changes", SIDES, CHANGES)
def diff_stats(v):
    return diff.stats(changes(v))


@query("select * from prio", SIDES, CHANGES)
def change_priority(v):
    return diff.prioritised(changes(v)).select("path", "change_type", "transfer_size", "priority")


@query("select path, change_type, priority, row_number() over (order by priority desc, transfer_size, path)::int as rank from prio order by priority desc, transfer_size, path limit 100", SIDES, CHANGES)
def change_priority_page(v):
    """The first 100 changes to carry out: a page is the feature."""
    page = diff.prioritised(changes(v)).orderBy(*diff.priority_order()).limit(100)
    return page.select("path", "change_type", "priority", F.row_number().over(Window.orderBy(*diff.priority_order())).alias("rank"))


@query("select path, change_type, count(*) as n_left from (select d.path, c.change_type, r.hash from req r join d on r.path = d.path join changes c on c.path = d.path where substr(r.hash, 1, 1) > '7') x group by path, change_type", SIDES, CHANGES)
def diff_ack(v):
    out = changes(v)
    acked = v.manifest_b().select(F.explode("chunk_hashes").alias("hash")).where(F.substring("hash", 1, 1) <= "7")
    return diff.acknowledged(out, acked)


@query("select peer_id, change_type, count(*) as n from (select 'p0' as peer_id, 'Added' as change_type from manifest_b union all select 'p1', change_type from (" + DIFF + ") x where change_type is not null) y group by peer_id, change_type", ["manifest_a", "manifest_b"])
def incremental_diff(v):
    """What brings a new peer, one with the old and one with the current version up to date."""
    peers = v.spark.createDataFrame([("p0", 0), ("p1", 1), ("p2", 2)], "peer_id string, version int")
    versions = v.manifest_a().select(F.lit(1).alias("version"), "path", "content_hash").unionByName(v.manifest_b().select(F.lit(2).alias("version"), "path", "content_hash"))
    return diff.for_peers(peers, versions, v.manifest_b()).groupBy("peer_id", "change_type").agg(F.count("*").alias("n"))


def _le(value: str, size: int) -> str:
    text = f"lpad(printf('%x', ({value})::bigint), 16, '0')"
    return "unhex(" + " || ".join(f"substr({text}, {17 - 2 * (i + 1)}, 2)" for i in range(size)) + ")"


LEAVES = f"leaves as (select path, sha256(encode(path) || {_le('size', 8)} || unhex(content_hash) || {_le('mode', 4)} || {_le('mtime_s', 8)} || unhex(array_to_string(chunk_hashes, ''))) as leaf from manifest_a)"


def _root_sql(levels: int = 24) -> str:
    out = [LEAVES, "l0 as (select (row_number() over (order by path) - 1) as i, leaf as h from leaves)"]
    for k in range(1, levels + 1):
        out.append(f"l{k} as (select i // 2 as i, case when (select count(*) from l{k - 1}) = 1 then max(h) else sha256(unhex(max(case when i % 2 = 0 then h end)) || unhex(coalesce(max(case when i % 2 = 1 then h end), max(case when i % 2 = 0 then h end)))) end as h from l{k - 1} group by i // 2)")
    return ", ".join(out)


@query("select path, leaf from leaves", ["manifest_a"], LEAVES)
def merkle_leaves(v):
    return manifest.merkle_leaves(v.manifest_a())


@query("select coalesce(max(h), sha256('')) as root from l24", ["manifest_a"], _root_sql())
def merkle_root(v):
    return manifest.merkle_root(manifest.merkle_leaves(v.manifest_a()))


@query("select max(h) as stored, max(h) = max(h) as verified from l24", ["manifest_a"], _root_sql())
def merkle_verify(v):
    """A stored root against a recomputation."""
    stored = manifest.merkle_root(manifest.merkle_leaves(v.manifest_a())).withColumnRenamed("root", "stored")
    again = manifest.merkle_root(manifest.merkle_leaves(v.manifest_a()))
    return stored.crossJoin(again).select("stored", manifest.verified(F.col("stored"), F.col("root")).alias("verified"))  # one row each


@query("select path, sha256(array_to_string(chunk_hashes, '')) as file_hash, sha256(path) as folder_id from manifest_a", ["manifest_a"])
def file_hash(v):
    return v.manifest_a().select("path", manifest.file_hash(F.col("chunk_hashes")).alias("file_hash"), manifest.folder_id(F.col("path")).alias("folder_id"))


@query("select subtree, case when count(*) = 1 then max(h) else sha256(string_agg(h, '' order by b)) end as hash from (select subtree, i // 1024 as b, sha256(string_agg(r, '' order by i)) as h from (select split_part(path, '/', 1) as subtree, row_number() over (partition by split_part(path, '/', 1) order by path) - 1 as i, path || size || content_hash as r from manifest_a) x group by subtree, i // 1024) y group by subtree", ["manifest_a"])
def subtree_hash(v):
    return manifest.subtree_hashes(v.manifest_a())


@query("select count(*) as file_count, sum(size)::bigint as total_size, least(ceil(log2(count(*))), 10)::bigint as depth from manifest_a", ["manifest_a"])
def manifest_totals(v):
    return manifest.totals(v.manifest_a()).withColumn("depth", manifest.tree_depth(F.col("file_count")))


N_A = "(select count(*) from manifest_a)"
MK = f"mk as (select ceil(-greatest({N_A}, 100) * ln(0.01) / (ln(2) * ln(2)))::bigint as m, greatest(1, floor(ceil(-greatest({N_A}, 100) * ln(0.01) / (ln(2) * ln(2))) / greatest({N_A}, 100) * ln(2) + 0.5))::bigint as k)"


def _bits(items: str) -> str:
    return f"select item, ('0x' || substr(md5(i || ':' || item), 1, 8))::bigint % m as bit from (select item, unnest(range(0, k)) as i, m from ({items}) q, mk) z"


BITS = MK + ", bits as (select distinct bit from (" + _bits("select path as item from manifest_a") + ") y)"


def _mk(v: Views) -> tuple[int, int, int]:
    n = v.manifest_a().count()
    return n, *bloom.parameters(n)


@query("select bit from bits", ["manifest_a"], BITS)
def bloom_build(v):
    _, m, k = _mk(v)
    return bloom.build(v.manifest_a(), "path", m, k)


@query("select item, count(b.bit) = count(*) as maybe from (" + _bits("select distinct path as item from manifest_b") + ") a left join bits b on a.bit = b.bit group by item", ["manifest_a", "manifest_b"], BITS)
def bloom_probe(v):
    _, m, k = _mk(v)
    return bloom.probe(v.manifest_b(), "path", bloom.build(v.manifest_a(), "path", m, k), m, k)


@query("select b.path, 'Added' as change_type from manifest_b b join (select item, count(x.bit) = count(*) as maybe from (" + _bits("select distinct path as item from manifest_b") + ") a left join bits x on a.bit = x.bit group by item) p on b.path = p.item join (select item, count(x.bit) = count(*) as maybe from (" + _bits("select distinct content_hash as item from manifest_b") + ") a left join hbits x on a.bit = x.bit group by item) h on b.content_hash = h.item where not (p.maybe and h.maybe)", ["manifest_a", "manifest_b"], BITS + ", hbits as (select distinct bit from (" + _bits("select content_hash as item from manifest_a") + ") y)")
def bloom_changes(v):
    n, m, k = _mk(v)
    a = v.manifest_a()
    return bloom.reported_changes(v.manifest_b(), bloom.build(a, "path", m, k), bloom.build(a, "content_hash", m, k), n)


@query("select item as path from (select item, count(b.bit) = count(*) as maybe from (" + _bits("select distinct path as item from manifest_b") + ") a left join bits b on a.bit = b.bit group by item) x where not maybe", ["manifest_a", "manifest_b"], BITS)
def bloom_suspects(v):
    n, m, k = _mk(v)
    return bloom.suspected_paths(v.manifest_b(), bloom.build(v.manifest_a(), "path", m, k), n)


@query(f"select m, k, round(pow(1 - exp(-k * {N_A}::double / m), k), 9) as fpp from mk", ["manifest_a"], MK)
def bloom_fpp(v):
    n, m, k = _mk(v)
    return v.spark.createDataFrame([(m, k, round(bloom.false_positive_rate(m, k, n), 9))], "m long, k long, fpp double")


@query("select round(case when a.n = 0 or b.n = 0 then 0.0 when a.h = b.h then 1.0 else least(a.n, b.n)::double / greatest(a.n, b.n) end, 9) as similarity, a.n as count_a, b.n as count_b from (select count(*) as n, max(content_hash) as h from manifest_a) a, (select count(*) as n, max(content_hash) || '-' as h from manifest_b) b", ["manifest_a", "manifest_b"])
def similarity(v):
    """Roots differ here, so the ratio of the counts decides; merkle_root tests the roots."""
    a = v.manifest_a().agg(F.count("*").alias("count_a"), F.max("content_hash").alias("root_a"))
    b = v.manifest_b().agg(F.count("*").alias("count_b"), F.concat(F.max("content_hash"), F.lit("-")).alias("root_b"))
    both = a.crossJoin(b)  # one row each
    return both.select(F.round(bloom.similarity(*(F.col(c) for c in ("count_a", "count_b", "root_a", "root_b"))), 9).alias("similarity"), "count_a", "count_b")


@query("select sum(greatest(size - n * 36, 0))::bigint as bytes_saved, round(avg(greatest(size - n * 36, 0)), 6) as mean_saved, round(sum(greatest(size - n * 36, 0)) * 100.0 / sum(size), 6) as savings_percent, round(sum(n * 36)::double / sum(size), 6) as compression_ratio from (select size, len(chunk_hashes) as n from manifest_a) x", ["manifest_a"])
def bloom_sync_stats(v):
    rows = v.manifest_a().select(F.col("size").alias("plain_bytes"), (F.size("chunk_hashes") * 36).cast("long").alias("sent_bytes"))
    out = bloom.sync_stats(rows)
    return out.select("bytes_saved", *(F.round(c, 6).alias(c) for c in ("mean_saved", "savings_percent", "compression_ratio")))


SYNCED = EPOCH + 60 * 300
CONFLICTS = f"c as (select coalesce(a.path, b.path) as path, case when a.path is not null and b.path is not null then case when a.content_hash <> b.content_hash and a.mtime_s > {SYNCED} and b.mtime_s > {SYNCED} then 'BothModified' end when coalesce(a.mtime_s, b.mtime_s) > {SYNCED} then 'DeletedModified' end as conflict_type, a.mtime_s as local_mtime, b.mtime_s as remote_mtime, a.size as local_size, b.size as remote_size from manifest_a a full join rb b on a.path = b.path)"
REMOTE = "rb as (select path, content_hash, mtime_s + doc_id % 3 - 1 as mtime_s, size from manifest_b), "


def _conflicts(v: Views) -> DataFrame:
    return conflict.conflicts(v.manifest_a(), v.manifest_b().withColumn("mtime_s", F.col("mtime_s") + F.col("doc_id") % 3 - 1), SYNCED)


@query("select path, conflict_type, coalesce(local_mtime, -1) as local_mtime, coalesce(remote_mtime, -1) as remote_mtime, coalesce(local_size, -1) as local_size, coalesce(remote_size, -1) as remote_size from c where conflict_type is not null", ["manifest_a", "manifest_b"], REMOTE + CONFLICTS)
def conflicts(v):
    return _conflicts(v).select("path", "conflict_type", *_known("local_mtime", "remote_mtime", "local_size", "remote_size"))


@query("select path, conflict_type, case when conflict_type = 'BothModified' then case when remote_mtime > local_mtime then 'KeepRemote' else 'KeepLocal' end when local_mtime is not null then 'KeepLocal' else 'KeepRemote' end as resolution, case when coalesce(remote_mtime, -1) > coalesce(local_mtime, -1) then 'remote' else 'local' end as newer, case when coalesce(remote_size, -1) > coalesce(local_size, -1) then 'remote' else 'local' end as larger from c where conflict_type is not null", ["manifest_a", "manifest_b"], REMOTE + CONFLICTS)
def conflict_resolution(v):
    cols = [F.col(c) for c in ("local_mtime", "remote_mtime", "local_size", "remote_size")]
    return _conflicts(v).select("path", "conflict_type", conflict.auto_resolution(F.col("conflict_type"), *cols[:2]).alias("resolution"), conflict.winner("NewerWins", *cols).alias("newer"), conflict.winner("LargerWins", *cols).alias("larger"))


@query("select resolved, count(*) as n from (select path, path like 'src1%' as resolved from c where conflict_type is not null) x group by resolved", ["manifest_a", "manifest_b"], REMOTE + CONFLICTS)
def conflict_log(v):
    log = _conflicts(v).select("path", F.lit(False).alias("resolved"))
    return conflict.marked_resolved(log, log.where("path like 'src1%'")).groupBy("resolved").agg(F.count("*").alias("n"))


@query("select hash, count(*) as ref_count, min(length) as size from fchunks group by hash", ["fchunks"])
def dedup_refcount(v):
    return store.ref_counts(v.fchunks())


@query("select count(*) as unique_chunks, (sum(n) - count(*))::bigint as duplicate_chunks, round((sum(n) - count(*))::double / sum(n), 9) as dedup_ratio, sum(n * size)::bigint as logical_bytes, sum(size)::bigint as stored_bytes from (select hash, count(*) as n, min(length) as size from fchunks group by hash) x", ["fchunks"])
def dedup_ratio(v):
    return store.dedup_ratio(v.fchunks()).withColumn("dedup_ratio", F.round("dedup_ratio", 9))


@query("select path, seq, coalesce(sum(length) over (partition by path order by seq rows between unbounded preceding and 1 preceding), 0)::bigint as offset, length, hash from fchunks", ["fchunks"])
def chunk_offsets(v):
    return v.fchunks()


@query("select count(*) as broken from fchunks where 1 = 0", ["fchunks"])
def chunk_contiguity(v):
    return series.gaps(v.fchunks()).agg(F.count("*").alias("broken"))


@query("select f.hash, min(f.length) as size from fchunks f left join cache c on f.hash = c.hash where c.hash is null group by f.hash", ["fchunks", "cache"])
def store_new_objects(v):
    return store.new_objects(v.fchunks().withColumnRenamed("length", "size"), v.cache())


@query("select count(*) as object_count, sum(size)::bigint as total_bytes from objects", ["objects"])
def storage_stats(v):
    return store.statistics(v.objects())


@query("select count(*) as total, count(*) filter (where sha256(data) = hash) as verified, count(*) filter (where sha256(data) <> hash) as corrupt, count(*) filter (where data is null) as error, round(count(*) filter (where sha256(data) = hash) * 100.0 / count(*), 6) as health_percent, false as healthy from objects", ["objects"])
def integrity_report(v):
    return store.integrity(v.objects()).withColumn("health_percent", F.round("health_percent", 6))


@query("select hash from objects where data is null or sha256(data) <> hash", ["objects"])
def corrupt_objects(v):
    return store.corrupt(v.objects())


@query("select count(*) as checked, count(*) filter (where data is null or sha256(data) <> hash) as corrupt, round(1 - count(*) filter (where data is null or sha256(data) <> hash)::double / count(*), 9) as integrity_score from objects", ["objects"])
def corruption_report(v):
    return store.corruption_score(v.objects()).withColumn("integrity_score", F.round("integrity_score", 9))


@query("select path, sha256(text) = case when doc_id % 50 = 0 then sha256(text || '?') else sha256(text) end as checksum_ok from files", ["files"])
def file_checksum(v):
    expected = F.when(F.col("doc_id") % 50 == 0, F.concat("text", F.lit("?"))).otherwise(F.col("text"))
    return v.files().select("path", (F.sha2(F.col("text").cast("binary"), 256) == F.sha2(expected.cast("binary"), 256)).alias("checksum_ok"))


@query("select 'objects/' || substr(hash, 1, 2) || '/' || substr(hash, 3, 2) || '/' || substr(hash, 5) as path, hash from objects", ["objects"])
def shard_paths(v):
    return v.objects().select(store.shard_path(F.col("hash")).alias("path"), "hash")


@query("select substr(hash, 1, 2) as shard, count(*) as objects, sum(size)::bigint as bytes from objects group by 1", ["objects"])
def shard_counts(v):
    return store.shard_counts(v.objects())


@query("select count(*) as shards, min(n) as fewest, max(n) as most, max(n) > 3 * min(n) as unbalanced from (select count(*) as n from objects group by substr(hash, 1, 2)) x", ["objects"])
def shard_balance(v):
    return store.shard_balance(v.objects())


@query("select hash, size from objects where size > 4096 order by size desc, hash limit 20", ["objects"])
def largest_objects(v):
    return store.largest(v.objects().select("hash", "size"), 20, 4096)


SMALL = "small as (select distinct hash, size, substr(hash, 1, 2) as shard from objects where size <= 65536)"


def _small(v: Views) -> DataFrame:
    return v.objects().select("hash", "size").distinct()


@query("select shard, hash, size, (n - 1) // 2 as flush, (n - 1) // 5 as pack from (select *, row_number() over (partition by shard order by hash) as n from small) x", ["objects"], SMALL)
def pack_assignment(v):
    return store.pack_batches(_small(v), per_pack=5, per_flush=2)


@query("select shard, hash, size, pack, coalesce(sum(size) over (partition by shard, pack order by hash rows between unbounded preceding and 1 preceding), 0)::bigint as offset from (select *, (row_number() over (partition by shard order by hash) - 1) // 4 as pack from small) x", ["objects"], SMALL)
def pack_by_size(v):
    """Closed here by count (4), which SQL can say; tests hold the rule by size against a plain fold."""
    return store.pack_index(store.pack_by_size(_small(v), most_objects=4))


@query("select hash, min(strlen(data))::bigint as size, sha256(min(data)) = hash as sound, 4 as per_pack from objects where data is not null and strlen(data) <= 65536 group by hash", ["objects"])
def pack_round_trip(v):
    """Objects written into packs of 4 and read back by the index; those whose bytes are not their hash's are told."""
    rows = v.objects().where("data is not null").groupBy("hash").agg(F.min("data").alias("data"))
    rows = rows.select("hash", F.col("data").cast("binary").alias("data"), F.octet_length("data").cast("long").alias("size"))
    index = store.pack_index(store.pack_by_size(rows, most_objects=4))
    packs = store.pack_bytes(index.join(rows.select("hash", "data"), "hash"))
    return store.read_packed(packs, index, rows).select("hash", "size", "sound", F.lit(4).alias("per_pack"))


@query("select o.hash, o.size, coalesce(sha256(o.data) = o.hash and strlen(o.data) = o.size, false) as sound from objects o where o.hash in (select content_hash from manifest_a)", ["objects", "manifest_a"])
def checked_read(v):
    rows = v.objects().withColumn("data", F.col("data").cast("binary"))
    return store.checked_read(rows, v.manifest_a().select(F.col("content_hash").alias("hash"))).select("hash", "size", "sound")


@query("select path, row_number() over (order by path) - 1 as index, true as proven from manifest_a", ["manifest_a"])
def merkle_inclusion(v):
    """Every file's proof leads to the root."""
    leaves = manifest.merkle_leaves(v.manifest_a())
    proofs = manifest.inclusion_proof(leaves, leaves.select("path"))
    root = manifest.merkle_root(leaves).first()[0]
    return proofs.select("path", "index", (manifest.proven_root(F.col("leaf"), F.col("siblings")) == root).alias("proven"))


@query("select count(c.hash) as kept, count(*) - count(c.hash) as removable, coalesce(sum(case when c.hash is null then f.size end), 0)::bigint as reclaimed_bytes from (select hash, min(length) as size from fchunks group by hash) f left join cache c on f.hash = c.hash", ["fchunks", "cache"])
def gc_plan(v):
    chunks = v.fchunks().groupBy("hash").agg(F.min("length").alias("size"))
    return store.garbage(chunks, v.cache())


@query("select shard, pack, round(coalesce(sum(case when c.hash is not null then p.size end), 0)::double / sum(p.size), 9) as live_share from (select substr(hash, 1, 2) as shard, (row_number() over (partition by substr(hash, 1, 2) order by hash) - 1) // 100 as pack, hash, size from (select hash, min(length) as size from fchunks group by hash) f) p left join cache c on p.hash = c.hash group by shard, pack having coalesce(sum(case when c.hash is not null then p.size end), 0)::double / sum(p.size) < 0.5", ["fchunks", "cache"])
def repack_plan(v):
    chunks = v.fchunks().groupBy("hash").agg(F.min("length").alias("size"))
    return store.repack(store.pack_batches(chunks, per_pack=100), v.cache()).withColumn("live_share", F.round("live_share", 9))


@query(f"select path, case when mtime_s < {EPOCH} + 6000 then 'expired' when got > size then 'size_mismatch' when got < size then 'open' when doc_id % 5 = 0 then 'hash_mismatch' else 'complete' end as state from (select doc_id, path, size, mtime_s, case when doc_id % 3 = 0 then size - 1 when doc_id % 7 = 0 then size + 1 else size end as got from files) x", ["files"])
def partial_transfers(v):
    got = F.when(F.col("doc_id") % 3 == 0, F.col("size") - 1).when(F.col("doc_id") % 7 == 0, F.col("size") + 1).otherwise(F.col("size"))
    actual = F.when(F.col("doc_id") % 5 == 0, F.lit("?")).otherwise(F.col("content_hash"))
    rows = v.files().select("path", F.col("size").alias("total_size"), got.alias("bytes_received"), F.col("mtime_s").alias("expires_s"), F.col("content_hash").alias("expected_hash"), actual.alias("actual_hash"))
    return store.partial_state(rows, EPOCH + 6000).select("path", "state")


VERSIONS = "versions as (select 'dev' || doc_id % 7 as device_id, source as folder_path, doc_id as version, sha256(text) as manifest_hash, n_chars as total_size from documents)"


def _versions(v: Views) -> DataFrame:
    return v.table("documents").select(F.concat(F.lit("dev"), (F.col("doc_id") % 7).cast("string")).alias("device_id"), F.col("source").alias("folder_path"), F.col("doc_id").alias("version"), F.sha2(F.col("text").cast("binary"), 256).alias("manifest_hash"), F.col("n_chars").alias("total_size"))


@query("select device_id, folder_path, version, manifest_hash, total_size from (select *, row_number() over (partition by device_id, folder_path order by version desc) as n from versions) x where n = 1", [], VERSIONS)
def latest_manifest(v):
    return manifest.latest(_versions(v))


@query("select device_id, folder_path, max(version) + 1 as next_version from versions group by 1, 2", [], VERSIONS)
def next_version(v):
    return manifest.next_versions(_versions(v))


@query("select path, size, content_hash from (select *, row_number() over (partition by path order by doc_id desc) as n from (select source || '/' || doc_id % 10 as path, size, content_hash, f.doc_id from files f join (select doc_id as id, source from documents) d on f.doc_id = d.id) y) x where n = 1", ["files"])
def file_upsert(v):
    rows = v.files().select(F.concat(F.element_at(F.split("path", "/"), 1), F.lit("/"), (F.col("doc_id") % 10).cast("string")).alias("path"), "size", "content_hash", "doc_id")
    return series.last_write(rows, ["path"], [F.col("doc_id")]).select("path", "size", "content_hash")


@query("select distinct unnest(chunk_hashes) as hash from manifest_b", ["manifest_b"])
def want_all(v):
    return transfer.all_wanted(v.manifest_b())


WANT = CHANGES + ", want as (select distinct hash from req order by hash limit 100)"


@query("select hash from want", SIDES, WANT)
def want_page(v):
    """The first 100 hashes to ask a peer for: a message is the feature."""
    return transfer.wanted(diff.required_chunks(v.manifest_a(), v.manifest_b(), v.cache()), v.cache())


@query("select w.hash, o.size from want w join (select hash, min(length) as size from fchunks group by hash) o on w.hash = o.hash where substr(w.hash, 3, 1) <> '0' order by w.hash limit 10", [*SIDES, "fchunks"], WANT)
def serve_wants(v):
    wants = transfer.wanted(diff.required_chunks(v.manifest_a(), v.manifest_b(), v.cache()), v.cache())
    objects = v.fchunks().groupBy("hash").agg(F.min("length").alias("size"))
    return transfer.served(wants, wants.where(F.substring("hash", 3, 1) == "0"), objects)


@query("select count(*) as wanted, count(*) - count(r.hash) as missing, count(*) = count(r.hash) as complete from (select distinct hash from req) q left join (select distinct hash from fchunks) r on q.hash = r.hash", [*SIDES, "fchunks"], CHANGES)
def verify_transfer(v):
    return transfer.complete(diff.required_chunks(v.manifest_a(), v.manifest_b(), v.cache()), v.fchunks())


@query("select path, seq, hash from fchunks where hash in (select hash from req)", [*SIDES, "fchunks"], CHANGES)
def receive_match(v):
    return transfer.accepted(v.fchunks().select("path", "seq", "hash"), diff.required_chunks(v.manifest_a(), v.manifest_b(), v.cache()))


@query("select path, seq::int as seq, hash from req where hash not in (select hash from fchunks)", [*SIDES, "fchunks"], CHANGES)
def remaining_chunks(v):
    return transfer.remaining(diff.required_chunks(v.manifest_a(), v.manifest_b(), v.cache()), v.fchunks())


@query(None)
def cdc_chunks(v):
    """Content-defined chunks with the documented boundaries."""
    return chunking.chunks(v.files(), chunking.SMALL, data="text")


@query(None)
def cdc_dedup(v):
    """Duplicate share of the three chunkers over the same files."""
    out = None
    for mode in ("compat", "resync", "fixed"):
        one = store.dedup_ratio(chunking.chunks(v.files(), replace(chunking.SMALL, mode=mode), data="text")).withColumn("mode", F.lit(mode))
        out = one if out is None else out.unionByName(one)
    return out
