"""Registered queries and their DuckDB equivalents, over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import functions as fn
from ..operators import batch, files, lineage, log, namespace, telemetry
from ..sources import journal
from ..streaming import group_commit

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_LOG = """SELECT event_id, user_id, event_type, CAST(sum(strlen(props) + 12) OVER (ORDER BY event_id) AS BIGINT) AS next_lsn, CAST(strlen(props) + 12 AS BIGINT) AS fl
  FROM events"""


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.assign_lsn(_t(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "props"), ["event_id"], "props")


@_query(f"SELECT event_id, next_lsn - fl AS lsn, next_lsn FROM ({_LOG})")
def log_lsn_assign(spark, sf_dir):
    return _log(spark, sf_dir).select("event_id", "lsn", "next_lsn")


@_query("""SELECT conv_id, records, bytes, end_lsn - bytes AS start_lsn, end_lsn FROM (SELECT *, CAST(sum(bytes) OVER (ORDER BY conv_id) AS BIGINT) AS end_lsn
  FROM (SELECT conv_id, count(*) AS records, CAST(sum(strlen(text) + 12) AS BIGINT) AS bytes FROM conversations GROUP BY conv_id))""")
def log_batch_append(spark, sf_dir):
    return log.append_batches(_t(spark, sf_dir, "conversations"), "conv_id", "text").select("conv_id", "records", "bytes", "start_lsn", "end_lsn")


def _stored(spark, sf_dir):
    return log.stored(_log(spark, sf_dir).select("event_id", "lsn", "next_lsn"), f"{lineage.folder(spark)}/log-{uuid.uuid4().hex}")


@_query(f"SELECT event_id, next_lsn - fl AS lsn FROM ({_LOG}) WHERE next_lsn - fl >= 32768")
def log_range_scan(spark, sf_dir):
    return log.scan(_stored(spark, sf_dir), 32768).select("event_id", "lsn")


@_query(f"""WITH l AS (SELECT event_id, next_lsn - fl AS lsn, next_lsn FROM ({_LOG})), w AS (SELECT CAST(unnest(range(0, 40)) * 997 AS BIGINT) AS lsn UNION SELECT lsn FROM l WHERE event_id % 100 = 0)
SELECT w.lsn, l.event_id, l.next_lsn, CASE WHEN l.lsn IS NOT NULL THEN 'Ok' WHEN w.lsn >= (SELECT max(next_lsn) FROM l) THEN 'UnexpectedEof' ELSE 'InvalidData' END AS state FROM w LEFT JOIN l USING (lsn)""")
def log_point_lookup(spark, sf_dir):
    """Positions of every hundredth record, and some that are no record's."""
    stored = _stored(spark, sf_dir)
    wanted = spark.range(40).select((F.col("id") * 997).alias("lsn")).union(stored.where("event_id % 100 = 0").select("lsn")).distinct()
    return log.lookup(stored, wanted).select("lsn", "event_id", "next_lsn", "state")


@_query(f"SELECT max(next_lsn) AS lsn FROM ({_LOG})")
def log_frontier(spark, sf_dir):
    return log.frontier(_log(spark, sf_dir))


@_query("""SELECT conv_id, records, rejected, bytes, CASE WHEN NOT rejected THEN e - bytes END AS start_lsn, CASE WHEN NOT rejected THEN e END AS end_lsn
  FROM (SELECT *, CAST(sum(bytes) OVER (ORDER BY conv_id) AS BIGINT) AS e
  FROM (SELECT conv_id, count(*) AS records, max(strlen(text)) > 400 AS rejected, CAST(CASE WHEN max(strlen(text)) > 400 THEN 0 ELSE sum(strlen(text) + 12) END AS BIGINT) AS bytes
  FROM conversations GROUP BY conv_id))""")
def log_batch_reject(spark, sf_dir):
    """With a cap of 400 bytes: a batch with a record over it is refused whole."""
    return log.append_batches(_t(spark, sf_dir, "conversations"), "conv_id", "text", 400).select("conv_id", "records", "rejected", "bytes", "start_lsn", "end_lsn")


@_query("""SELECT event_id, strlen(props) > 40 AS rejected, CASE WHEN strlen(props) <= 40 THEN CAST(sum(CASE WHEN strlen(props) <= 40 THEN strlen(props) + 12 ELSE 0 END) OVER (ORDER BY event_id) AS BIGINT) END AS next_lsn
  FROM events""")
def log_record_reject(spark, sf_dir):
    return log.assign_lsn(_t(spark, sf_dir, "events").select("event_id", "props"), ["event_id"], "props", 40).select("event_id", "rejected", "next_lsn")


@_query(f"""WITH l AS ({_LOG}), c AS (SELECT CAST(unnest([0, 5, 100, 1000, 4096, 65536]) AS BIGINT) AS cut), e AS (SELECT max(next_lsn) AS total FROM l)
SELECT cut, records, clean_end, CASE WHEN least(cut, total) = clean_end THEN 'CleanEnd' WHEN least(cut, total) - clean_end < 8 THEN 'TruncatedHeader' ELSE 'TruncatedPayload' END AS state
FROM (SELECT cut, count(*) FILTER (WHERE next_lsn <= cut) AS records, coalesce(max(next_lsn) FILTER (WHERE next_lsn <= cut), 0) AS clean_end FROM c LEFT JOIN l ON next_lsn - fl < cut GROUP BY cut), e""")
def log_torn_tail(spark, sf_dir):
    cuts = spark.createDataFrame([(x,) for x in (0, 5, 100, 1000, 4096, 65536)], "cut long")
    return log.torn_tails(_log(spark, sf_dir), cuts).select("cut", "records", "clean_end", "state")


@_query(f"""SELECT event_id, user_id, lsn, previous_end
  FROM (SELECT event_id, user_id, next_lsn - fl AS lsn, lag(next_lsn) OVER (PARTITION BY user_id ORDER BY event_id) AS previous_end FROM ({_LOG}))
  WHERE previous_end <> lsn""")
def log_gap_detect(spark, sf_dir):
    return log.gaps(_log(spark, sf_dir), "event_id", "user_id").select("event_id", "user_id", "lsn", "previous_end")


@_query("""SELECT event_id, user_id, min(CASE WHEN event_type = 'purchase' THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS durable_at
  FROM events""")
def log_durable_asof(spark, sf_dir):
    return log.durable_at(_t(spark, sf_dir, "events"), "user_id", "event_id", F.col("event_type") == "purchase").select("event_id", "user_id", "durable_at")


@_query("""SELECT user_id, CAST(coalesce(sum(size) FILTER (WHERE whole = 1), 0) AS BIGINT) AS frontier, CAST(sum(whole) AS BIGINT) AS finished
  FROM (SELECT user_id, strlen(props) + 12 AS size, min(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS whole
  FROM events) GROUP BY user_id""")
def log_contiguous_frontier(spark, sf_dir):
    return log.contiguous_frontier(_t(spark, sf_dir, "events"), "user_id", "event_id", F.col("event_type") != "error", log.frame_len(F.col("props")))


@_query("""SELECT user_id, CAST(sum(1 - bad) AS BIGINT) AS accepted, CAST(sum(bad) AS BIGINT) AS rejected
  FROM (SELECT user_id, coalesce(max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bad
  FROM events) GROUP BY user_id""")
def log_poison(spark, sf_dir):
    return log.poisoned(_t(spark, sf_dir, "events"), "user_id", "event_id", F.col("event_type") == "error")


@_query("""SELECT doc_id, lower('46535901' || lpad(hex(strlen(text) & 255), 2, '0') || lpad(hex((strlen(text) >> 8) & 255), 2, '0') || lpad(hex((strlen(text) >> 16) & 255), 2, '0') || lpad(hex((strlen(text) >> 24) & 255), 2, '0')) AS header
  FROM documents""")
def frame_header_hex(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", log.frame_header_hex(F.col("text")).alias("header"))


_CRC_TABLE = """list_transform(range(256), lambda n: list_reduce([n, 0, 1, 2, 3, 4, 5, 6, 7], lambda r, k: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 2197175160) ELSE r >> 1 END))"""


@_query(f"""WITH t AS (SELECT {_CRC_TABLE} AS t), b AS (SELECT event_id, '46535901' || printf('%02x%02x0000', strlen(props) % 256, strlen(props) // 256) || hex(encode(props)) AS h FROM events),
f AS (SELECT event_id, list_transform(range(strlen(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT)) AS f FROM b)
SELECT event_id, xor(list_reduce(list_prepend(4294967295, f), lambda c, x: xor(t[CAST(xor(c, x) & 255 AS INTEGER) + 1], c >> 8)), 4294967295) AS crc32c FROM f, t""")
def frame_crc32c(spark, sf_dir):
    """The checksum of every event's frame."""
    return _t(spark, sf_dir, "events").select("event_id", journal.frame_crc(F.col("props").cast("binary")).alias("crc32c"))


def _logged(spark, sf_dir):
    """The events' payloads appended to a log of files, in two commits."""
    path = f"{lineage.folder(spark)}/log-{uuid.uuid4().hex}"
    events = _t(spark, sf_dir, "events").select("event_id", "props")
    for half in (events.where("event_id < 500"), events.where("event_id >= 500")):
        journal.append(half, ["event_id"], "props", path)
    return path


_FILE_LOG = "SELECT event_id, props, CAST(sum(strlen(props) + 12) OVER (ORDER BY event_id) AS BIGINT) AS next_lsn, strlen(props) + 12 AS fl FROM events"


@_query(f"SELECT next_lsn - fl AS lsn, next_lsn, md5(props) AS digest FROM ({_FILE_LOG})")
def log_read_frames(spark, sf_dir):
    """A log written to files and read back, in ranges of 64 KiB."""
    return journal.read_segments(spark, _logged(spark, sf_dir), 1 << 16).select("lsn", "next_lsn", F.md5("payload").alias("digest"))


def _broken_logs(spark, sf_dir):
    """Three logs of the regions' names: whole, torn and with a byte wrong."""
    names = [r["r_name"].encode() for r in _t(spark, sf_dir, "region").orderBy("r_regionkey").collect()]  # five rows
    whole = b"".join(map(journal.encode_frame, names))
    broken = bytearray(whole)
    broken[len(journal.encode_frame(names[0])) + 8] ^= 1
    path = f"{lineage.folder(spark)}/log-{uuid.uuid4().hex}"
    for name, data in (("0.log", whole + bytes(77)), ("1.log", whole[:-3]), ("2.log", bytes(broken))):
        journal.put(f"{path}/{name}", data)
    return path


_LENGTHS = """SELECT CAST(sum(strlen(r_name) + 12) AS BIGINT) AS whole, CAST(sum(CASE WHEN r_regionkey < 4 THEN strlen(r_name) + 12 END) AS BIGINT) AS four, CAST(sum(CASE WHEN r_regionkey < 1 THEN strlen(r_name) + 12 END) AS BIGINT) AS one
  FROM region"""


@_query(f"""SELECT unnest([0, 1, 2]) AS log, unnest([whole + 77, whole - 3, whole]) AS file_len, unnest([whole, four, one]) AS clean_end, CAST(unnest([5, 4, 1]) AS BIGINT) AS records, unnest(['CleanEnd', 'TruncatedPayload', 'ChecksumMismatch']) AS state
  FROM ({_LENGTHS})""")
def log_tails(spark, sf_dir):
    tails = journal.log_tails(spark, _broken_logs(spark, sf_dir))
    return tails.select(F.regexp_extract("path", r"(\d)\.log$", 1).cast("int").alias("log"), "file_len", "clean_end", "records", "state")


@_query(f"""SELECT unnest([0, 1, 2]) AS log, unnest([whole, four, one]) AS clean_end, unnest(['Zeros', 'Preserved', 'Preserved']) AS tail, unnest([NULL, '1.log.corrupt-' || four, '2.log.corrupt-' || one]) AS sidecar, unnest([whole, four, one]) AS new_len
  FROM ({_LENGTHS})""")
def log_repair(spark, sf_dir):
    """Logs cut back to their clean ends, tails saved; and what the logs look like then."""
    path = _broken_logs(spark, sf_dir)
    done, after = journal.repair(spark, path), journal.log_tails(spark, path).select("path", F.col("file_len").alias("new_len"))
    return done.join(after, "path").select(F.regexp_extract("path", r"(\d)\.log$", 1).cast("int").alias("log"), "clean_end", "tail", "sidecar", "new_len")


@_query(f"""SELECT unnest([0, 0, 0]) AS log, unnest([0, one, whole]) AS lsn, unnest(['Ok', 'Ok', 'InvalidData']) AS state, unnest([(SELECT r_name FROM region
  WHERE r_regionkey = 0), (SELECT r_name FROM region WHERE r_regionkey = 1), NULL]) AS payload FROM ({_LENGTHS})""")
def log_read_at(spark, sf_dir):
    """Two records by their positions, and the zeros behind the last."""
    path = _broken_logs(spark, sf_dir) + "/0.log"
    ends = [r["r_name"] for r in _t(spark, sf_dir, "region").orderBy("r_regionkey").collect()]
    places = (0, 12 + len(ends[0]), sum(12 + len(n) for n in ends))
    out = [journal.read_at(spark, path, lsn) for lsn in places]
    return out[0].union(out[1]).union(out[2]).select(F.lit(0).alias("log"), "lsn", "state", F.col("payload").cast("string").alias("payload"))


@_query("""WITH RECURSIVE p AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events WHERE event_type = 'purchase'),
w AS (SELECT user_id, event_id, r, event_id AS leader_id, ts AS lead, 0 AS n FROM p WHERE r = 1
  UNION ALL SELECT p.user_id, p.event_id, p.r, CASE WHEN p.ts >= w.lead + INTERVAL 3600 SECOND OR w.n >= 8 THEN p.event_id ELSE w.leader_id END, CASE WHEN p.ts >= w.lead + INTERVAL 3600 SECOND OR w.n >= 8 THEN p.ts ELSE w.lead END, CASE WHEN p.ts >= w.lead + INTERVAL 3600 SECOND OR w.n >= 8 THEN 0 ELSE w.n + 1 END FROM w JOIN p ON p.user_id = w.user_id AND p.r = w.r + 1)
SELECT user_id, event_id, leader_id, CAST(n AS BIGINT) AS followers_before FROM w""")
def log_group_commit(spark, sf_dir):
    """Sync requests (purchases) of a user gathered into commits: 3600 s or 8 followers, whichever is first."""
    return group_commit.commits(_t(spark, sf_dir, "events").where("event_type = 'purchase'").select("user_id", "event_id", "ts"), window_s=3600.0, most_followers=8)


@_query("""SELECT l_orderkey, count(*) AS ops, min(i) FILTER (WHERE l_returnflag = 'R') AS failed_at, coalesce(min(i) FILTER (WHERE l_returnflag = 'R'), count(*)) AS completed
  FROM (SELECT l_orderkey, l_returnflag, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_returnflag) - 1 AS i
  FROM lineitem) GROUP BY l_orderkey""")
def batch_partial_failure(spark, sf_dir):
    order = [F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag")]
    return batch.outcomes(_t(spark, sf_dir, "lineitem"), "l_orderkey", order, F.col("l_returnflag") == "R").select("l_orderkey", "ops", "failed_at", "completed")


@_query("""SELECT conv_id, count(*) AS ops, min(i) FILTER (WHERE turn % 5 = 3) AS failed_at, coalesce(min(i) FILTER (WHERE turn % 5 = 3), count(*)) AS completed, CASE WHEN count(*) FILTER (WHERE turn % 5 = 3) > 0 THEN 'FS-00001' END AS error_code
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations) GROUP BY conv_id""")
def batch_error_codes(spark, sf_dir):
    """Two kinds of operations from builders; the fourth of a batch's turns fails."""
    turns = _t(spark, sf_dir, "conversations")
    path = F.col("role")
    ops = batch.build(turns.where("role = 'user'"), "write", path, data=F.col("text")).union(batch.build(turns.where("role <> 'user'"), "delete", path))
    return batch.outcomes(ops, "conv_id", [F.col("turn")], F.col("turn") % 5 == 3, F.lit("FS-00001")).select("conv_id", "ops", "failed_at", "completed", "error_code")


@_query("""SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events)
  WHERE r = 1 AND event_type <> 'error'""")
def batch_last_write_wins(spark, sf_dir):
    return batch.last_write_wins(_t(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id", F.col("event_type") == "error")


@_query("SELECT lang, count(*) AS ops, count(DISTINCT source) AS parents FROM documents GROUP BY lang")
def batch_grouped_parents(spark, sf_dir):
    return batch.grouped_parents(_t(spark, sf_dir, "documents"), "lang", "source")


_URL = "regexp_replace(url, '^[a-z]+://', '')"


@_query("""SELECT batch, count(*) AS ops, min(page_id) FILTER (WHERE url LIKE '%#%') AS first_escape, count(*) FILTER (WHERE url LIKE '%#%') > 0 AS rejected, CASE WHEN count(*) FILTER (WHERE url LIKE '%#%') > 0 THEN 0 ELSE count(*) END AS completed
  FROM (SELECT page_id, url, page_id // 10 AS batch FROM pages) GROUP BY batch""")
def batch_preflight_reject(spark, sf_dir):
    """A fragment stands for two steps up, so a url with one leaves the root."""
    ops = _t(spark, sf_dir, "pages").select(
        "page_id", F.expr("page_id div 10").alias("batch"), F.when(F.col("url").contains("#"), F.lit("a/../..")).otherwise(F.lit("a/b")).alias("path")
    )
    return batch.preflight(ops, "batch", "page_id", fn.escapes_root(F.col("path"))).select("batch", "ops", "first_escape", "rejected", "completed")


_NEW = "SELECT l_orderkey AS o_orderkey, max(l_extendedprice) AS o_totalprice FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey"


def _priced(spark, sf_dir, keep):
    new = _t(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_extendedprice").alias("o_totalprice"))
    return files.upsert(_t(spark, sf_dir, "orders"), new, "o_orderkey", "o_totalprice", keep)


@_query(f"SELECT o_orderkey, coalesce(n.o_totalprice, o.o_totalprice) AS o_totalprice FROM orders o FULL JOIN ({_NEW}) n USING (o_orderkey)")
def file_upsert(spark, sf_dir):
    return _priced(spark, sf_dir, [])


@_query(f"""SELECT o_orderkey, coalesce(n.o_totalprice, o.o_totalprice) AS o_totalprice, o_orderstatus, o_orderpriority FROM orders o FULL
  JOIN ({_NEW}) n USING (o_orderkey)""")
def file_write_copy(spark, sf_dir):
    return _priced(spark, sf_dir, ["o_orderstatus", "o_orderpriority"])


@_query("SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49)")
def file_delete_anti(spark, sf_dir):
    gone = _t(spark, sf_dir, "lineitem").where("l_quantity >= 49").select(F.col("l_partkey").alias("p_partkey")).distinct()
    return files.delete(_t(spark, sf_dir, "part"), gone, "p_partkey").select("p_partkey", "p_name")


@_query("SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AS \"exists\" FROM customer")
def file_exists(spark, sf_dir):
    tree = _t(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return files.exists(_t(spark, sf_dir, "customer").select("c_custkey"), tree, "c_custkey", F.col("o_orderstatus") == "F")


@_query("SELECT doc_id, CASE WHEN lang = 'en' THEN strlen(text) ELSE 0 END AS size, lang = 'en' AS is_file, lang <> 'en' AS is_dir FROM documents")
def file_meta(spark, sf_dir):
    return files.meta(_t(spark, sf_dir, "documents"), "doc_id", F.col("text"), F.col("lang") == "en")


def _bytes(spark, sf_dir, change):
    content = F.col("text").cast("binary")
    return _t(spark, sf_dir, "documents").select("doc_id", F.md5(F.hex(change(content)).cast("binary")).alias("digest"))


_HEX = "hex(encode(text))"


@_query(f"SELECT doc_id, md5(substr({_HEX}, 33, 128)) AS digest FROM documents")
def bytes_read_at(spark, sf_dir):
    return _bytes(spark, sf_dir, lambda c: files.read_at(c, 16, 64))


@_query(f"""SELECT doc_id, md5(substr({_HEX}, 1, 32) || repeat('00', greatest(0, 16 - strlen(text))) || '6162636465' || substr({_HEX}, 43)) AS digest
  FROM documents""")
def bytes_write_at(spark, sf_dir):
    return _bytes(spark, sf_dir, lambda c: files.write_at(c, 16, b"abcde"))


@_query(f"SELECT doc_id, md5(substr({_HEX}, 1, 2000) || repeat('00', greatest(0, 1000 - strlen(text)))) AS digest FROM documents")
def bytes_truncate(spark, sf_dir):
    return _bytes(spark, sf_dir, lambda c: files.truncate(c, 1000))


@_query(f"SELECT doc_id, md5(substr({_HEX}, 1, 40) || repeat('00', greatest(0, least(50, strlen(text) - 20))) || substr({_HEX}, 141)) AS digest FROM documents")
def bytes_zero_range(spark, sf_dir):
    return _bytes(spark, sf_dir, lambda c: files.zero_range(c, 20, 50))


_TREE = """SELECT r_name AS path, false AS is_file FROM region UNION ALL SELECT r_name || '/' || n_name, false FROM nation
  JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT r_name || '/' || n_name || '/' || c_name, true FROM customer
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""


def _tree(spark, sf_dir):
    region, nation, customer = (_t(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    nations = nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))  # 5 and 25 rows at any scale
    people = customer.join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey"))
    dirs = region.select(F.col("r_name").alias("path")).union(nations.select(F.concat_ws("/", "r_name", "n_name"))).withColumn("is_file", F.lit(False))
    return dirs.union(people.select(F.concat_ws("/", "r_name", "n_name", "c_name"), F.lit(True)))


@_query(f"SELECT path, is_file FROM ({_TREE}) WHERE path LIKE 'ASIA/%' AND path NOT LIKE 'ASIA/%/%'")
def ns_list(spark, sf_dir):
    return namespace.list_dir(_tree(spark, sf_dir), "ASIA")


@_query(f"SELECT path, is_file FROM ({_TREE}) WHERE path LIKE 'ASIA/%'")
def ns_scan_all(spark, sf_dir):
    return namespace.scan_all(_tree(spark, sf_dir), "ASIA")


@_query(f"""WITH f AS (SELECT string_split(path, '/') AS p FROM ({_TREE}) WHERE is_file), d AS (SELECT p, unnest(range(0, len(p))) AS k
  FROM f) SELECT array_to_string(p[1:k], '/') AS dir, CAST(sum(CASE WHEN k = len(p) - 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_direct, count(*) AS n_all
  FROM d GROUP BY 1""")
def ns_count_all(spark, sf_dir):
    return namespace.count_all(_tree(spark, sf_dir), F.col("is_file"))


@_query(f"""WITH f AS (SELECT string_split(path, '/') AS p FROM ({_TREE}) WHERE is_file), d AS (SELECT p, unnest(range(1, len(p))) AS k
  FROM f) SELECT DISTINCT array_to_string(p[1:k], '/') AS path FROM d""")
def ns_mkdir_all(spark, sf_dir):
    return namespace.missing_ancestors(_tree(spark, sf_dir).where("is_file").select("path"))


@_query(f"SELECT page_id, path FROM (SELECT page_id, {_URL} AS path FROM pages) WHERE regexp_full_match(path, '[^/]*/en/[^/]*\\.html')")
def ns_find_glob(spark, sf_dir):
    return namespace.find(_t(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://", "").alias("path")), "*/en/*.html")


@_query(f"SELECT page_id, path FROM (SELECT page_id, {_URL} AS path FROM pages) WHERE regexp_full_match(path, '(.*/)?(de|fr)/[^/]*')")
def ns_brace_find(spark, sf_dir):
    return namespace.find(_t(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://", "").alias("path")), "**/{de,fr}/*")


@_query(f"SELECT page_id, path FROM (SELECT page_id, {_URL} AS path FROM pages) WHERE regexp_full_match(path, '[^/]*/[^a-e/][^/]*/[^/]*[0-4]\\.[a-z][^/]*')")
def ns_class_find(spark, sf_dir):
    return namespace.find(_t(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://", "").alias("path")), "./*/[!a-e]*/*[0-4].[a-z]*")


@_query(f"SELECT path, is_file FROM ({_TREE}) WHERE NOT is_file AND path LIKE 'A%/%'")
def ns_find_dirs(spark, sf_dir):
    """A pattern that ends in ** finds directories only."""
    return namespace.find(_tree(spark, sf_dir), "A*/**", ~F.col("is_file"))


@_query(f"""WITH t AS ({_TREE}), w AS (SELECT n_name AS path FROM nation UNION ALL SELECT r_name || '/NEW' FROM region UNION ALL SELECT r_name || '/NEW' FROM region WHERE r_regionkey = 1 UNION ALL SELECT r_name || '/NEW/SUB' FROM region UNION ALL SELECT r_name FROM region),
o AS (SELECT path, count(*) AS asked FROM w GROUP BY path),
s AS (SELECT path, asked, CASE WHEN path IN (SELECT path FROM t) THEN 'AlreadyExists' WHEN path LIKE '%/%' AND regexp_replace(path, '/[^/]*$', '') NOT IN (SELECT path FROM t WHERE NOT is_file) THEN 'NotFound' ELSE 'made' END AS state FROM o)
SELECT path, state, CASE WHEN state = 'made' THEN asked - 1 ELSE asked END AS errors FROM s""")
def ns_mkdir(spark, sf_dir):
    region, nation = _t(spark, sf_dir, "region"), _t(spark, sf_dir, "nation")
    new = region.select(F.concat("r_name", F.lit("/NEW")))
    wanted = nation.select("n_name").union(new).union(region.where("r_regionkey = 1").select(F.concat("r_name", F.lit("/NEW")))).union(region.select(F.concat("r_name", F.lit("/NEW/SUB")))).union(region.select("r_name"))
    return namespace.make_dirs(_tree(spark, sf_dir), wanted.toDF("path"))


@_query(f"""SELECT path, path IN ('ASIA/JAPAN', 'ASIA/INDIA') AS failed FROM ({_TREE})
  WHERE path LIKE 'ASIA/%' AND path NOT LIKE 'ASIA/JAPAN/%' AND path NOT LIKE 'ASIA/INDIA/%'""")
def ns_scan_partial(spark, sf_dir):
    unreadable = spark.createDataFrame([("ASIA/JAPAN",), ("ASIA/INDIA",), ("EUROPE",)], "path string")
    return namespace.scan_partial(_tree(spark, sf_dir), "ASIA", unreadable).select("path", "failed")


@_query(r"SELECT page_id, array_to_string(list_filter(regexp_split_to_array(url, '[/\\]'), lambda x: x <> ''), '/') AS path FROM pages")
def path_normalize(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", fn.normalize_path(F.col("url")).alias("path"))


@_query(r"""SELECT page_id, regexp_replace(regexp_replace(chr(160) || ' .' || url || chr(133) || chr(8195) || '. ', '[/\\<>:"|?*\x00-\x1F\x7F-\x{9F}]', '_', 'g'), '^[\pZ.]+|[\pZ.]+$', '', 'g') AS segment FROM pages""")
def path_sanitize(spark, sf_dir):
    """Around each url a no-break space, a dot, a C1 control character and an em space."""
    framed = F.concat(F.lit("\u00a0 ."), F.col("url"), F.lit("\u0085\u2003. "))
    return _t(spark, sf_dir, "pages").select("page_id", fn.sanitize_segment(framed).alias("segment"))


@_query("""SELECT s_suppkey, lpad(lower(hex(s_suppkey % 65536)), 4, '0') || ':' || lpad(lower(hex(s_suppkey % 256)), 2, '0') || ':' || lpad(lower(hex(s_suppkey % 32)), 2, '0') || '.' || lower(hex(s_suppkey % 8)) AS address,
CASE WHEN s_suppkey % 5 = 0 THEN 0 WHEN s_suppkey % 5 < 4 THEN s_suppkey % 65536 END AS domain, CASE WHEN s_suppkey % 5 < 4 THEN s_suppkey % 256 END AS bus, CASE WHEN s_suppkey % 5 < 4 THEN s_suppkey % 32 END AS device, CASE WHEN s_suppkey % 5 < 4 THEN s_suppkey % 8 END AS function FROM supplier""")
def pci_round_trip(spark, sf_dir):
    """Every fifth address is read without its domain, every fifth is broken."""
    k = F.col("s_suppkey")
    out = _t(spark, sf_dir, "supplier").select("s_suppkey", fn.pci_format(k % 65536, k % 256, k % 32, k % 8).alias("address"))
    raw = F.when(k % 5 == 0, F.regexp_replace("address", "^[^:]*:", "")).when(k % 5 == 4, F.concat("address", F.lit("x"))).otherwise(F.col("address"))
    read = fn.pci_parse(raw)
    return out.select("s_suppkey", "address", *(read[c].cast("long").alias(c) for c in ("domain", "bus", "device", "function")))


@_query("SELECT p_partkey, CASE WHEN p_size % 4 = 0 AND p_size > 25 THEN 'direct' WHEN p_size % 4 IN (0, 1) THEN 'data' ELSE 'sync' END AS method FROM part")
def auto_method(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, ("nvme", "ssd", "hdd", "unknown"))), (F.col("p_size") % 4 + 1).cast("int"))
    return _t(spark, sf_dir, "part").select("p_partkey", fn.auto_method(kind, F.col("p_size") > 25).alias("method"))


@_query("SELECT p_partkey, (p_size & 9) = 9 AS has FROM part")
def cpu_feature_contains(spark, sf_dir):
    return _t(spark, sf_dir, "part").select("p_partkey", fn.has_flags(F.col("p_size"), 9).alias("has"))


@_query("SELECT doc_id, CASE WHEN n_chars % 512 = 0 THEN n_chars ELSE n_chars + 512 - n_chars % 512 END AS aligned FROM documents")
def align_up(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", fn.align_up(F.col("n_chars"), 512).alias("aligned"))


@_query("""SELECT o_orderkey, o_orderkey % 11 <> 3 OR o_orderpriority <> '1-URGENT' OR o_orderstatus <> 'F' OR o_custkey % 2 = 0 OR date_diff('second', o_orderdate, TIMESTAMP '1995-08-02') >= 30 * 86400 AS stale
  FROM orders""")
def capability_stale(spark, sf_dir):
    found = {"schema": F.col("o_orderkey") % 11, "version": F.col("o_orderpriority"), "kernel": F.col("o_orderstatus"), "system": F.col("o_custkey") % 2}
    current = {"schema": F.lit(3), "version": F.lit("1-URGENT"), "kernel": F.lit("F"), "system": F.lit(1)}
    seconds = lambda c: c.cast("timestamp").cast("long")
    return _t(spark, sf_dir, "orders").select("o_orderkey", fn.is_stale(found, current, seconds(F.col("o_orderdate")), seconds(F.lit("1995-08-02"))).alias("stale"))


@_query("""SELECT p_partkey, array_to_string(r, ',') AS reasons, r[1] AS first FROM (SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN ['NotLinux'] ELSE list_filter([CASE WHEN p_size * 10 < 256 THEN 'HugepagesNotConfigured' END, CASE WHEN p_retailprice < 1000 THEN 'InsufficientPrivileges' END,
CASE WHEN p_partkey % 4 = 0 THEN 'NoNvmeDevices' END, CASE WHEN p_partkey % 4 > 0 AND p_partkey % 4 - p_partkey % 3 <= 0 THEN 'AllDevicesInUse' END, CASE WHEN p_partkey % 2 = 1 THEN 'IommuNotConfigured' END, CASE WHEN p_size % 8 < 4 THEN 'InsufficientCores' END], lambda x: x IS NOT NULL) END AS r FROM part)""")
def skip_reasons(spark, sf_dir):
    k, size = F.col("p_partkey"), F.col("p_size")
    reasons = fn.skip_reasons(
        F.when(k % 9 == 0, "macos").otherwise("linux"), size * 10, F.col("p_retailprice") >= 1000, k % 4, F.greatest(k % 4 - k % 3, F.lit(0)),
        k % 2 == 0, size % 8
    )
    return _t(spark, sf_dir, "part").select("p_partkey", F.array_join(reasons, ",").alias("reasons"), fn.first_reason(reasons).alias("first"))


@_query("""SELECT p_partkey, CASE m WHEN 'mmap' THEN 'mmap + msync' WHEN 'sync' THEN CASE s WHEN 'macos' THEN 'F_FULLFSYNC' ELSE 'fsync' END
WHEN 'data' THEN CASE s WHEN 'linux' THEN 'fdatasync' WHEN 'macos' THEN 'F_FULLFSYNC' ELSE 'fsync' END
WHEN 'direct' THEN CASE WHEN s = 'linux' AND nvme THEN 'io_uring + NVMe FLUSH' WHEN s = 'linux' AND ring THEN 'io_uring + fdatasync' WHEN s = 'linux' THEN 'O_DIRECT + pwrite + fdatasync' WHEN s = 'macos' THEN 'F_NOCACHE + F_FULLFSYNC' WHEN s = 'windows' AND nvme THEN 'FILE_FLAG_WRITE_THROUGH + NVMe IOCTL' WHEN s = 'windows' THEN 'FILE_FLAG_WRITE_THROUGH' ELSE 'fsync' END ELSE 'fsync' END AS primitive,
CASE WHEN m = 'journal' THEN 'UnsupportedMethod' WHEN m = 'spdk' AND NOT ring THEN 'FeatureNotEnabled' WHEN m = 'spdk' THEN 'SpdkUnavailable' END AS error
FROM (SELECT p_partkey, ['mmap', 'sync', 'data', 'direct', 'journal', 'spdk'][p_partkey % 6 + 1] AS m, ['linux', 'macos', 'windows', 'bsd'][p_size % 4 + 1] AS s, p_retailprice > 1200 AS nvme, p_size > 25 AS ring FROM part)""")
def durability_ladder(spark, sf_dir):
    pick = lambda names, k: F.element_at(F.array(*map(F.lit, names)), (k + 1).cast("int"))
    method, system = pick(("mmap", "sync", "data", "direct", "journal", "spdk"), F.col("p_partkey") % 6), pick(("linux", "macos", "windows", "bsd"), F.col("p_size") % 4)
    nvme, ring = F.col("p_retailprice") > 1200, F.col("p_size") > 25
    return _t(spark, sf_dir, "part").select("p_partkey", fn.durability_primitive(method, system, nvme, ring).alias("primitive"), fn.method_error(method, ring).alias("error"))


_DRIVES = [
    "Intel SSDSC2KB019", "samsung pm9a3", "Samsung 990 PRO", "WDC Ultrastar DC SN640", "KIOXIA CD6", "Intel 660p", "Micron_7450",
    "Seagate Nytro 5050", "Toshiba PX05", "none"
]


@_query("SELECT p_partkey, CASE WHEN p_partkey % 10 IN (0, 1, 3, 4, 6, 7, 8) THEN 'yes' ELSE 'unknown' END AS protection FROM part")
def power_loss_protection(spark, sf_dir):
    name = F.element_at(F.array(*map(F.lit, _DRIVES)), (F.col("p_partkey") % 10 + 1).cast("int"))
    return _t(spark, sf_dir, "part").select("p_partkey", fn.power_loss_protection(name, name).alias("protection"))


@_query("""SELECT p_partkey, CAST(CASE p_size % 5 WHEN 0 THEN p_size * 1024 WHEN 1 THEN p_size * 1048576 WHEN 2 THEN p_size END AS BIGINT) AS cache, CASE WHEN p_size % 3 = 0 THEN 'nvme' WHEN p_size % 4 = 0 THEN 'ssd' WHEN p_size % 4 = 1 THEN 'hdd' ELSE 'unknown' END AS drive,
CASE WHEN p_size % 3 = 0 THEN 'dev' WHEN p_size % 3 = 1 THEN 'prod' WHEN p_size % 2 = 0 THEN 'dev' ELSE 'prod' END AS mode, CAST(CASE WHEN p_size % 2 = 0 THEN p_size * 1024 ELSE 0 END AS BIGINT) AS kib, CAST(CASE WHEN p_size % 2 = 0 THEN p_size END AS BIGINT) AS total,
CAST(CASE WHEN p_size % 7 > 0 THEN (p_size + 1) * 512 END AS BIGINT) AS atomic_unit, replace(replace(p_name, ' ', chr(92) || 'n'), 'e', chr(92) || '"') AS escaped FROM part""")
def word_parsers(spark, sf_dir):
    """Cache sizes, drives, modes, sizes with units, fields, atomic units and escapes, read from texts made of each part."""
    n, k = F.col("p_size"), F.col("p_size").cast("string")
    cache = F.when(n % 5 == 0, F.concat(k, F.lit("K"))).when(n % 5 == 1, F.concat(k, F.lit("M"))).when(n % 5 == 2, k).otherwise(F.concat(F.lit("x"), k))
    first = F.when(n % 3 == 0, " Debug ").when(n % 3 == 1, "RELEASE").otherwise("staging")
    second = F.when(n % 2 == 0, "development").otherwise("?")
    line = F.when(n % 2 == 0, F.concat(F.lit("MemTotal:   "), k, F.lit(" kB"))).otherwise(F.concat(F.lit("MemFree: "), k, F.lit(" kB")))
    raw = F.replace(F.replace("p_name", F.lit(" "), F.lit("\n")), F.lit("e"), F.lit('\x01"'))
    return _t(spark, sf_dir, "part").select(
        "p_partkey", fn.cache_size(cache).alias("cache"), fn.drive_kind(
            F.when(n % 3 == 0, "nvme0n1").otherwise("sda"), n % 4
        ).alias("drive"), fn.current_mode(first, second).alias("mode"),
        fn.kib(F.when(n % 2 == 0, F.concat(k, F.lit(" kB"))).otherwise("many")).alias("kib"), fn.field_of(line, "MemTotal").alias("total"),
        fn.atomic_write_unit(F.when(n % 7 > 0, n), F.lit(512)).alias("atomic_unit"), fn.escape_quoted(raw).alias("escaped"),
    )


@_query("""SELECT p_partkey, CASE WHEN w > 0 THEN least(w, 100000) END AS window_us, greatest(1, least(p_size * 200 - 1000, 4096)) AS most, greatest(1, least(p_size * 2 - 5, 64)) AS shards, p_size * 100 >= 4096 AS write_mapped, p_size % 2 = 0 AND p_size * 100 >= 4096 AS read_mapped
FROM (SELECT p_partkey, p_size, (p_partkey % 4) * 50000 AS w FROM part)""")
def option_clamps(spark, sf_dir):
    n, window = F.col("p_size"), F.col("p_partkey") % 4 * 50000
    return _t(spark, sf_dir, "part").select(
        "p_partkey", fn.commit_window_us(window).alias("window_us"), fn.clamp(n * 200 - 1000, 1, 4096).alias("most"), fn.clamp(n * 2 - 5, 1, 64).alias("shards"),
        fn.fits_mapping(n * 100, 4096).alias("write_mapped"), fn.fits_mapping(n * 100, 4096, n % 2 == 0).alias("read_mapped"),
    )


@_query("""SELECT event_id, CASE WHEN event_id % 10 < 9 THEN ['fast_poll', 'register_buffers', 'register_files', 'uring_cmd', 'submit_all', 'coop_taskrun', 'single_issuer', 'defer_taskrun', 'sqpoll'][event_id % 10 + 1] END AS name, CASE WHEN event_id % 10 < 9 THEN event_id % 10 END AS place
  FROM events""")
def ring_features(spark, sf_dir):
    k = F.col("event_id") % 10
    feature = F.element_at(F.array(*map(F.lit, [*fn.RING_FEATURES, "Other"])), (k + 1).cast("int"))
    back = fn.ring_feature(fn.ring_feature_name(feature))
    return _t(spark, sf_dir, "events").select("event_id", fn.ring_feature_name(feature).alias("name"), F.when(back.eqNullSafe(feature) & back.isNotNull(), k).alias("place"))


@_query("SELECT page_id, strlen(url) * 4 + 5 + strlen(lower(hex(page_id))) + 18 <= 255 AS kept, true AS fits, true AS known FROM pages")
def temp_names(spark, sf_dir):
    """Of names four urls long: kept or hashed, never over 255 bytes."""
    name = F.repeat("url", 4)
    made = fn.temp_name(name, F.col("page_id"), F.xxhash64("url"))
    return _t(spark, sf_dir, "pages").select("page_id", made.endswith(name).alias("kept"), (F.octet_length(made) <= 255).alias("fits"), fn.is_temp_name(made).alias("known"))


@_query("SELECT conv_id, count(DISTINCT s) = 1 AND min(s) >= 0 AND max(s) < 7 AS whole FROM (SELECT conv_id, 0 AS s FROM conversations) GROUP BY conv_id")
def batch_shards(spark, sf_dir):
    """All operations of a batch are in the shard of its first path."""
    ops = _t(spark, sf_dir, "conversations")
    first = ops.groupBy("conv_id").agg(F.min_by("text", "turn").alias("path"))
    dealt = ops.join(first, "conv_id").withColumn("s", batch.shard(F.col("path"), 7))
    return dealt.groupBy("conv_id").agg(((F.count_distinct("s") == 1) & (F.min("s") >= 0) & (F.max("s") < 7)).alias("whole"))


@_query("""SELECT event_type, count(*) AS calls, CAST(sum(strlen(props)) AS BIGINT) AS bytes, CAST(sum(CASE WHEN value > 100 THEN 1 ELSE 0 END) AS BIGINT) AS errors
  FROM events GROUP BY event_type""")
def tel_rollup(spark, sf_dir):
    return telemetry.rollup(_t(spark, sf_dir, "events"), "event_type", F.octet_length("props"), F.col("value") > 100)


_RANK = """SELECT event_type, CAST(max(n) AS BIGINT) AS n, max(value) FILTER (WHERE i = floor(0.5 * (n - 1) + 0.5)) AS p50, max(value) FILTER (WHERE i = floor(0.999 * (n - 1) + 0.5)) AS p999
  FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n
  FROM events) GROUP BY event_type"""


def _ranked(spark, sf_dir):
    return telemetry.nearest_rank(_t(spark, sf_dir, "events"), "event_type", "value", {"p50": 0.5, "p999": 0.999})


@_query(_RANK)
def tel_percentile_nearest(spark, sf_dir):
    return _ranked(spark, sf_dir)


@_query(f"SELECT event_type, CASE WHEN p999 / greatest(p50, 0.001) <= 10.0 THEN 'OK' ELSE 'INVESTIGATE' END AS status FROM ({_RANK})")
def tel_tail_verdict(spark, sf_dir):
    return telemetry.tail_verdict(_ranked(spark, sf_dir)).select("event_type", "status")


@_query("""SELECT year, strictness, CASE WHEN pct IS NULL THEN 'skipped' WHEN strictness = 'critical' THEN CASE WHEN pct > 5 THEN 'fail' ELSE 'pass' END WHEN strictness = 'standard' THEN CASE WHEN pct > 10 THEN 'fail' ELSE 'pass' END ELSE CASE WHEN pct > 25 THEN 'warn' ELSE 'pass' END END AS gate
FROM (SELECT year, 100.0 * (n - lag(n) OVER (ORDER BY year)) / lag(n) OVER (ORDER BY year) AS pct FROM (SELECT CAST(year(l_shipdate) AS INTEGER) AS year, count(*) AS n FROM lineitem GROUP BY 1)), (SELECT unnest(['critical', 'standard', 'loose']) AS strictness)""")
def tel_regression_gate(spark, sf_dir):
    """Years against the year before, once as a benchmark of each class."""
    years = _t(spark, sf_dir, "lineitem").groupBy(F.year("l_shipdate").alias("year")).agg(F.count("*").alias("n"))
    before = years.select((F.col("year") + 1).alias("year"), F.col("n").alias("base"))
    pct = 100.0 * (F.col("n") - F.col("base")) / F.col("base")
    each = years.join(before, "year", "left").select("year", pct.alias("pct"), F.explode(F.array(*map(F.lit, telemetry.LIMITS))).alias("strictness"))
    return each.select("year", "strictness", telemetry.regression(F.col("pct"), F.col("strictness")).alias("gate"))


@_query("SELECT p_partkey, CASE WHEN p_size % 4 < 2 THEN 'write_' || p_size END AS name, CASE WHEN p_size % 4 = 0 THEN p_size + 0.5 END AS value FROM part")
def tel_baselines(spark, sf_dir):
    """Lines of a file of baselines: numbers, null, other words, and keys that begin with an underscore."""
    n, k = F.col("p_size"), F.col("p_size").cast("string")
    value = F.when(n % 4 == 0, F.concat(k, F.lit(".5"))).when(n % 4 == 1, F.lit("null")).otherwise('"text"')
    line = F.concat(F.lit('    "'), F.when(n % 4 == 3, "_").otherwise(""), F.lit("write_"), k, F.lit('": '), value, F.lit(","))
    got = telemetry.baselines(line)
    return _t(spark, sf_dir, "part").select("p_partkey", got["name"].alias("name"), got["value"].alias("value"))


@_query("""SELECT conv_id, records, CASE WHEN error THEN 0 ELSE bytes END AS bytes, error
  FROM (SELECT conv_id, count(*) AS records, CAST(sum(strlen(text) + 12) AS BIGINT) AS bytes, max(strlen(text)) > 400 AS error FROM conversations
  GROUP BY conv_id)""")
def tel_append_events(spark, sf_dir):
    return telemetry.append_events(_t(spark, sf_dir, "conversations"), "conv_id", "text", F.octet_length("text") > 400)


@_query("""SELECT event_type AS kind, CAST(sum(CASE WHEN value > 100 THEN 0 ELSE strlen(props) END) AS BIGINT) AS bytes, CAST(sum(event_id % 1000) AS BIGINT) AS duration_ns, CAST(count(*) FILTER (WHERE value > 100) AS BIGINT) AS errors
  FROM (SELECT event_id, value, props, CASE event_type WHEN 'click' THEN 'read' WHEN 'view' THEN 'write' ELSE 'read_at' END AS event_type FROM events)
  WHERE event_type IN ('read', 'write') GROUP BY 1""")
def tel_io_events(spark, sf_dir):
    op = F.when(F.col("event_type") == "click", "read").when(F.col("event_type") == "view", "write").otherwise("read_at")
    events = telemetry.io_events(_t(spark, sf_dir, "events"), op, F.octet_length("props"), F.col("event_id") % 1000, F.col("value") > 100)
    return events.groupBy("kind").agg(F.sum("bytes").alias("bytes"), F.sum("duration_ns").alias("duration_ns"), F.count_if("error").alias("errors"))


@_query("SELECT event_id, lsn, previous_end FROM (SELECT event_id, next_lsn - fl AS lsn, lag(next_lsn) OVER (ORDER BY event_id) AS previous_end FROM (" + _LOG + ") WHERE event_id % 1000 <> 7) WHERE previous_end <> lsn")
def log_gap_scan(spark, sf_dir):
    return log.gaps(_log(spark, sf_dir).where("event_id % 1000 <> 7"), "event_id").select("event_id", "lsn", "previous_end")


_OPS = """WITH RECURSIVE o AS (SELECT conv_id, turn, role AS path, CASE role WHEN 'user' THEN 'assistant' ELSE 'user' END AS src, CASE WHEN turn % 3 = 2 THEN 'copy' WHEN turn % 7 = 5 THEN 'delete' ELSE 'write' END AS kind,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations),
p AS (SELECT a.conv_id, a.turn, a.path, a.kind, a.i, max(b.turn) AS prev FROM o a LEFT JOIN o b ON a.conv_id = b.conv_id AND b.path = a.src AND b.turn < a.turn AND a.kind = 'copy' GROUP BY ALL),
chase AS (SELECT conv_id, turn, kind AS k, turn AS cur, prev FROM p
  UNION ALL SELECT c.conv_id, c.turn, coalesce(q.kind, 'nothing'), coalesce(q.turn, c.turn), q.prev FROM chase c LEFT JOIN p q ON q.conv_id = c.conv_id AND q.turn = c.prev WHERE c.k = 'copy'),
r AS (SELECT p.conv_id, p.path, p.kind, p.i, c.k, c.cur FROM p JOIN chase c ON p.conv_id = c.conv_id AND p.turn = c.turn WHERE c.k <> 'copy'),
f AS (SELECT conv_id, count(*) AS ops, min(i) FILTER (WHERE kind = 'copy' AND k IN ('nothing', 'delete')) AS failed_at FROM r GROUP BY conv_id)
"""


def _ops(spark, sf_dir):
    kind = F.when(F.col("turn") % 3 == 2, "copy").when(F.col("turn") % 7 == 5, "delete").otherwise("write")
    ops = _t(spark, sf_dir, "conversations").select(
        "conv_id", "turn", kind.alias("kind"), F.col("role").alias("path"),
        F.when(F.col("role") == "user", "assistant").otherwise("user").alias("src"), F.col("text").alias("data")
    )
    return batch.apply_ops(ops, "conv_id", "turn")


@_query(_OPS + "SELECT x.conv_id, x.path, x.origin, md5(t.text) AS digest FROM (SELECT r.conv_id, path, arg_max(k, i) AS k, arg_max(cur, i) AS origin FROM r JOIN f ON r.conv_id = f.conv_id WHERE i < coalesce(failed_at, ops) GROUP BY 1, 2) x JOIN conversations t ON t.conv_id = x.conv_id AND t.turn = x.origin WHERE k = 'write'")
def batch_apply_files(spark, sf_dir):
    return _ops(spark, sf_dir)[0].select("conv_id", "path", "origin", F.md5(F.col("data").cast("binary")).alias("digest"))


@_query(_OPS + "SELECT conv_id, ops, failed_at, coalesce(failed_at, ops) AS completed FROM f")
def batch_apply_outcomes(spark, sf_dir):
    return _ops(spark, sf_dir)[1].select("conv_id", "ops", "failed_at", "completed")


@_query("SELECT conv_id, md5(string_agg(text, '' ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id")
def file_append(spark, sf_dir):
    turns = _t(spark, sf_dir, "conversations")
    grown = files.append_all(turns.where("turn = 0"), turns.where("turn > 0"), "conv_id", "turn", "text")
    return grown.select("conv_id", F.md5(F.col("text").cast("binary")).alias("digest"))


_MOVED = """WITH a AS (SELECT p_partkey AS src, (p_partkey // 7) * 7 AS dst, p_name FROM part
  WHERE p_size < 4), m AS (SELECT dst AS d, arg_max(p_name, src) AS p_name FROM a GROUP BY dst) SELECT p_partkey, p_name FROM part
  WHERE p_partkey NOT IN (SELECT d FROM m)"""


def _moves(spark, sf_dir):
    """Several parts go to one number, some to their own."""
    return _t(spark, sf_dir, "part").select("p_partkey", "p_name"), _t(spark, sf_dir, "part").where("p_size < 4").select(
        F.col("p_partkey").alias("src"), F.expr("p_partkey div 7 * 7").alias("dst")
    )


@_query(f"{_MOVED} UNION ALL SELECT d, p_name FROM m")
def file_copy(spark, sf_dir):
    return files.copy(*_moves(spark, sf_dir), "p_partkey")


@_query(f"{_MOVED} AND p_size >= 4 UNION ALL SELECT d, p_name FROM m")
def file_rename(spark, sf_dir):
    return files.rename(*_moves(spark, sf_dir), "p_partkey")


@_query(f"SELECT path, is_file FROM ({_TREE}) WHERE NOT regexp_matches(path, '^(ASIA|EUROPE)(/|$)')")
def ns_rmdir_all(spark, sf_dir):
    return namespace.remove_trees(_tree(spark, sf_dir), spark.createDataFrame([("ASIA",), ("EUROPE",), ("NOWHERE",)], "path string"))


@_query(f"SELECT path, is_file FROM ({_TREE}) t WHERE is_file OR EXISTS (SELECT 1 FROM ({_TREE}) u WHERE starts_with(u.path, t.path || '/'))")
def ns_rmdir(spark, sf_dir):
    """Every directory is doomed; those that hold something stay."""
    tree = _tree(spark, sf_dir)
    return namespace.remove_empty(tree, tree.where("not is_file").select("path"), F.col("is_file"))


@_query(f"""SELECT page_id, CASE WHEN page_id % 3 <> 1 THEN array_to_string(list_filter(string_split({_URL}, '/'), lambda x: x <> ''), '/') END AS path FROM pages""")
def path_confine(spark, sf_dir):
    lead = F.when(F.col("page_id") % 3 == 0, "a/./../").when(F.col("page_id") % 3 == 1, "a/../../").otherwise("./")
    return _t(spark, sf_dir, "pages").select("page_id", fn.confine(F.concat(lead, F.regexp_replace("url", "^[a-z]+://", ""))).alias("path"))


@_query(f"SELECT event_id, {list(fn.ERROR_CODES.values())}[event_id % 25] AS name FROM events")
def err_code_dim(spark, sf_dir):
    code = F.concat(F.lit("FS-"), F.lpad((F.col("event_id") % 25).cast("string"), 5, "0"))
    return _t(spark, sf_dir, "events").select("event_id", fn.error_name(code).alias("name"))


@_query("""SELECT event_type, CAST(max(n) AS BIGINT) AS n, max(value) FILTER (WHERE i = n // 2) AS p50, max(value) FILTER (WHERE i = least(n - 1, n * 99 // 100)) AS p99
  FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n
  FROM events) GROUP BY event_type""")
def tel_truncated_rank(spark, sf_dir):
    return telemetry.truncated_rank(_t(spark, sf_dir, "events"), "event_type", "value")


@_query("SELECT event_type, count(*) AS ops, count(*) / sum(event_id % 7 + 1) AS per_second FROM events GROUP BY event_type")
def tel_throughput(spark, sf_dir):
    return telemetry.throughput(_t(spark, sf_dir, "events"), "event_type", F.col("event_id") % 7 + 1)
