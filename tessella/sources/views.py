"""Domain tables derived from the test tables. VIEWS holds the same definitions as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.chunking import fixed_slices, slice_hashes

EPOCH = 1_704_067_200  # 2024-01-01
AS_OF = EPOCH + 30 * 86_400


class Views:
    """The domain tables of one folder of test tables; all lazy."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def files(self) -> DataFrame:
        path = F.concat("source", F.lit("/"), "lang", F.lit("/d"), F.col("doc_id").cast("string"), F.lit(".txt"))
        content = F.col("text").cast("binary")
        return self.table("documents").select("doc_id", path.alias("path"), F.octet_length(content).cast("long").alias("size"), F.sha2(content, 256).alias("content_hash"), (F.lit(EPOCH) + F.col("doc_id") * 60).alias("mtime_s"), F.when(F.col("doc_id") % 7 == 0, 493).otherwise(420).alias("mode"), "text")

    def manifest_a(self) -> DataFrame:
        return self.files().where("doc_id % 10 <> 0").withColumn("chunk_hashes", slice_hashes(F.col("text"))).drop("text")

    def manifest_b(self) -> DataFrame:
        changed = F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
        hashed = F.when((F.col("doc_id") % 5 != 0) & (F.col("doc_id") % 13 == 0), F.sha2(F.concat("content_hash", F.lit("m")).cast("binary"), 256)).otherwise(F.sha2(F.col("text").cast("binary"), 256))
        rows = self.files().where("doc_id % 11 <> 0").withColumn("text", changed)
        return rows.withColumn("content_hash", hashed).withColumn("size", F.octet_length("text").cast("long")).withColumn("chunk_hashes", slice_hashes(F.col("text"))).drop("text")

    def cache(self) -> DataFrame:
        return self.files().where("doc_id % 17 = 0").select(F.explode(slice_hashes(F.col("text"))).alias("hash")).distinct()

    def fchunks(self) -> DataFrame:
        return fixed_slices(self.files(), 512)

    def objects(self) -> DataFrame:
        """Contents as stored; every 50th is damaged, every 97th unreadable."""
        content = F.col("text").cast("binary")
        data = F.when(F.col("doc_id") % 97 == 0, F.lit(None).cast("binary")).when(F.col("doc_id") % 50 == 0, F.concat("text", F.lit("?")).cast("binary")).otherwise(content)
        return self.table("documents").select("doc_id", F.sha2(content, 256).alias("hash"), F.octet_length(content).cast("long").alias("size"), data.alias("data"))

    def fsevents(self) -> DataFrame:
        kind = F.when(F.col("event_type") == "signup", "Created").when(F.col("event_type") == "click", "Modified").when(F.col("event_type") == "view", "AttributeChanged").when(F.col("event_type") == "purchase", "Renamed").otherwise("Removed")
        k = F.get_json_object("props", "$.k")
        user = F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("/k"))
        return self.table("events").select(F.col("event_id").alias("seq"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "user_id", F.concat(user, k).alias("path"), F.concat(user, k, F.lit(".old")).alias("old_path"), kind.alias("kind"), "value")

    def samples(self) -> DataFrame:
        """(key, us, id, bytes): cumulative values of each user, in thousandths, whole."""
        w = Window.partitionBy("user_id").orderBy("us", "seq")
        step = F.floor(F.col("value") * 1000).cast("long")
        return self.fsevents().select(F.col("user_id").alias("key"), "us", F.col("seq").alias("id"), F.sum(step).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("bytes"))

    def ops(self) -> DataFrame:
        rows = self.table("lineitem")
        return rows.select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("ms"), F.floor("l_extendedprice").cast("long").alias("bytes"), F.when(F.col("l_linestatus") == "O", "read").otherwise("write").alias("op"), (F.col("l_returnflag") == "R").alias("error"), F.col("l_suppkey").alias("peer_id"))

    def peers(self) -> DataFrame:
        rows = self.ops().groupBy("peer_id").agg(F.count("*").alias("n"), F.sum("bytes").cast("long").alias("bytes"), F.sum("ms").alias("total_ms"), F.count_if("error").alias("errors"))
        named = self.table("supplier").join(F.broadcast(self.table("nation")), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("peer_id"), F.col("s_name").alias("name"), F.col("n_name").alias("nation"), "s_acctbal")
        return named.join(rows, "peer_id")

    def sessions(self) -> DataFrame:
        """Orders as sync sessions."""
        rows = self.table("orders")
        status = F.when(F.col("o_orderstatus") == "F", "Completed").when(F.col("o_orderstatus") == "O", "Interrupted").otherwise("Active")
        return rows.select(F.col("o_orderkey").alias("session_id"), F.col("o_custkey").alias("peer_id"), status.alias("status"), (F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1_000_000).cast("long").alias("updated_s"), (F.floor("o_totalprice").cast("long") % 101).alias("progress"), F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"), (F.col("o_orderkey") % 4).alias("retries"), F.floor("o_totalprice").cast("long").alias("saved"))

    def pending(self) -> DataFrame:
        """Lines of orders as chunks that wait for transfer."""
        lines = self.table("lineitem").select(F.col("l_orderkey").alias("session_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.floor("l_extendedprice").cast("long").alias("size"))
        return lines.join(self.sessions().select("session_id", "priority", F.col("updated_s").alias("created_s")), "session_id").withColumn("id", F.col("session_id") * 10 + F.col("line"))


VIEWS = {
    "files": f"select doc_id, source||'/'||lang||'/d'||doc_id||'.txt' as path, strlen(text)::bigint as size, sha256(text) as content_hash, {EPOCH} + doc_id * 60 as mtime_s, case when doc_id % 7 = 0 then 493 else 420 end as mode, text from documents",
    "sliced": "select *, case when length(text) > 0 then list_transform(range(0, (length(text) - 1) // 512 + 1), lambda i: sha256(substr(text, (i * 512 + 1)::bigint, 512))) else [] end as chunk_hashes from files",
    "manifest_a": "select * exclude (text) from sliced where doc_id % 10 <> 0",
    "b_files": "select doc_id, path, mtime_s, mode, case when doc_id % 5 = 0 then text || 'x' else text end as text, content_hash as old from files where doc_id % 11 <> 0",
    "manifest_b": "select doc_id, path, strlen(text)::bigint as size, case when doc_id % 5 <> 0 and doc_id % 13 = 0 then sha256(old || 'm') else sha256(text) end as content_hash, mtime_s, mode, case when length(text) > 0 then list_transform(range(0, (length(text) - 1) // 512 + 1), lambda i: sha256(substr(text, (i * 512 + 1)::bigint, 512))) else [] end as chunk_hashes from b_files",
    "cache": "select distinct unnest(chunk_hashes) as hash from sliced where doc_id % 17 = 0",
    "pieces": "select path, unnest(range(0, (length(text) - 1) // 512 + 1)) as seq, text from files where length(text) > 0",
    "fchunks": "select path, seq::int as seq, strlen(substr(text, (seq * 512 + 1)::bigint, 512))::bigint as length, sha256(substr(text, (seq * 512 + 1)::bigint, 512)) as hash from pieces",
    "objects": "select doc_id, sha256(text) as hash, strlen(text)::bigint as size, case when doc_id % 97 = 0 then null when doc_id % 50 = 0 then text || '?' else text end as data from documents",
    "fsevents": "select event_id as seq, epoch_us(ts) as us, user_id, 'u'||user_id||'/k'||(props->>'$.k') as path, 'u'||user_id||'/k'||(props->>'$.k')||'.old' as old_path, case event_type when 'signup' then 'Created' when 'click' then 'Modified' when 'view' then 'AttributeChanged' when 'purchase' then 'Renamed' else 'Removed' end as kind, value from events",
    "samples": "select user_id as key, us, seq as id, (sum(floor(value * 1000)::bigint) over (partition by user_id order by us, seq rows unbounded preceding))::bigint as bytes from fsevents",
    "ops": "select l_orderkey, l_linenumber, l_quantity as ms, floor(l_extendedprice)::bigint as bytes, case when l_linestatus = 'O' then 'read' else 'write' end as op, l_returnflag = 'R' as error, l_suppkey as peer_id from lineitem",
    "peers": "select s_suppkey as peer_id, s_name as name, n_name as nation, s_acctbal, n, bytes, total_ms, errors from supplier join nation on s_nationkey = n_nationkey join (select peer_id, count(*) as n, sum(bytes)::bigint as bytes, sum(ms) as total_ms, count(*) filter (where error) as errors from ops group by peer_id) o on s_suppkey = o.peer_id",
    "sessions": "select o_orderkey as session_id, o_custkey as peer_id, case o_orderstatus when 'F' then 'Completed' when 'O' then 'Interrupted' else 'Active' end as status, epoch_us(o_orderdate) // 1000000 as updated_s, floor(o_totalprice)::bigint % 101 as progress, substr(o_orderpriority, 1, 1)::int as priority, o_orderkey % 4 as retries, floor(o_totalprice)::bigint as saved from orders",
    "pending": "select l.l_orderkey as session_id, l.l_linenumber as line, l.l_partkey as part, floor(l.l_extendedprice)::bigint as size, s.priority, s.updated_s as created_s, l.l_orderkey * 10 + l.l_linenumber as id from lineitem l join sessions s on l.l_orderkey = s.session_id",
}
NEEDS = {"sliced": ["files"], "manifest_a": ["sliced"], "b_files": ["files"], "manifest_b": ["b_files"], "cache": ["sliced"], "pieces": ["files"], "fchunks": ["pieces"], "samples": ["fsevents"], "peers": ["ops"], "pending": ["sessions"]}


def with_views(names: list[str], sql: str, extra: str = "") -> str:
    """The SQL with the definitions of the named views, and of those that they need, before it."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS.get(name, []):
            add(n)
        if name not in order:
            order.append(name)

    for n in names:
        add(n)
    parts = [f"{n} as ({VIEWS[n]})" for n in order]
    if extra:
        parts.append(extra)
    return (f"with recursive {', '.join(parts)} " if parts else "") + sql
