"""Ledger operators over a ledger made of orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ledger as op
from .registry import query, table


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("task_id"), F.expr("o_orderkey % 20").alias("batch_id"), F.col("o_orderkey").alias("excel_row"),
        F.expr("CASE WHEN o_orderkey % 7 = 3 THEN 'waiting_dependency' WHEN o_orderkey % 11 = 5 THEN 'cancelled' WHEN o_orderkey % 13 = 2 THEN 'retry_wait' WHEN o_orderkey % 17 = 1 THEN 'tts_done' WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderstatus = 'O' THEN 'pending' ELSE 'failed' END").alias("status"),
        F.expr("CASE WHEN o_orderkey % 7 <> 3 THEN NULL WHEN o_custkey % 5 = 0 THEN o_orderkey - 1 ELSE o_orderkey - 20 * (1 + o_custkey % 3) END").alias("leader_task_id"),
        F.expr("concat('fp-', o_custkey % 500)").alias("fingerprint"), F.expr("concat('/v/', o_custkey, '.mp4')").alias("input_video"), F.col("o_orderpriority").alias("text"),
        F.expr("concat('/out/', o_orderkey % 300, '.mp4')").alias("output_path"), F.expr("o_totalprice / 1000").alias("video_duration"), F.expr("CAST(o_orderkey % 40 AS DOUBLE)").alias("tts_duration"),
        F.expr("CAST(timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01', o_orderdate) AS DOUBLE)").alias("created_at"),
        F.expr("CAST(timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01', o_orderdate) + o_orderkey % 1000 AS DOUBLE)").alias("updated_at"),
        F.expr("CAST(o_orderkey % 100 AS DOUBLE)").alias("next_attempt_at"), F.expr("CASE WHEN o_orderkey % 9 = 0 THEN 'client_error' WHEN o_orderkey % 9 = 1 THEN 'excel_invalid' ELSE '' END").alias("error_type"),
    ).withColumn("finished_at", F.expr("CASE WHEN status = 'completed' THEN updated_at ELSE 0.0D END"))


LEDGER = """
WITH base AS (SELECT o_orderkey AS task_id, o_orderkey % 20 AS batch_id, o_orderkey AS excel_row,
  CASE WHEN o_orderkey % 7 = 3 THEN 'waiting_dependency' WHEN o_orderkey % 11 = 5 THEN 'cancelled' WHEN o_orderkey % 13 = 2 THEN 'retry_wait' WHEN o_orderkey % 17 = 1 THEN 'tts_done' WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderstatus = 'O' THEN 'pending' ELSE 'failed' END AS status,
  CASE WHEN o_orderkey % 7 <> 3 THEN NULL WHEN o_custkey % 5 = 0 THEN o_orderkey - 1 ELSE o_orderkey - 20 * (1 + o_custkey % 3) END AS leader_task_id,
  'fp-' || (o_custkey % 500) AS fingerprint, '/v/' || o_custkey || '.mp4' AS input_video, o_orderpriority AS text, '/out/' || (o_orderkey % 300) || '.mp4' AS output_path,
  o_totalprice / 1000 AS video_duration, CAST(o_orderkey % 40 AS DOUBLE) AS tts_duration,
  CAST(epoch_us(o_orderdate) // 1000000 AS DOUBLE) AS created_at, CAST(epoch_us(o_orderdate) // 1000000 + o_orderkey % 1000 AS DOUBLE) AS updated_at,
  CAST(o_orderkey % 100 AS DOUBLE) AS next_attempt_at, CASE WHEN o_orderkey % 9 = 0 THEN 'client_error' WHEN o_orderkey % 9 = 1 THEN 'excel_invalid' ELSE '' END AS error_type FROM orders),
ledger AS (SELECT *, CASE WHEN status = 'completed' THEN updated_at ELSE 0.0 END AS finished_at FROM base)
"""
STATUS_DOMAIN = ", ".join(f"('{s}')" for s in op.STATUSES)


@query("f01_list_tasks", LEDGER + "SELECT task_id, batch_id, status, input_video FROM ledger WHERE batch_id = 7 AND (input_video ILIKE '%/V/1%' OR text ILIKE '%/V/1%' OR CAST(task_id AS VARCHAR) ILIKE '%/V/1%') ORDER BY batch_id, excel_row LIMIT 200 OFFSET 5")
def list_tasks(spark, sf_dir):
    return op.list_tasks(ledger(spark, sf_dir), batch_id=7, text="/V/1", limit=200, offset=5).select("task_id", "batch_id", "status", "input_video")


@query("f02_get_task", LEDGER + "SELECT task_id, status, fingerprint FROM ledger WHERE task_id = 42")
def get_task(spark, sf_dir):
    return ledger(spark, sf_dir).where("task_id = 42").select("task_id", "status", "fingerprint")


@query("f03_safe_ids", "SELECT doc_id, regexp_matches(md5(text), '^[a-f0-9]{6,32}$') AS safe_hash, regexp_matches(source, '^[a-f0-9]{6,32}$') AS safe_source FROM documents")
def safe_ids(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", op.is_safe_id(F.md5("text")).alias("safe_hash"), op.is_safe_id(F.col("source")).alias("safe_source"))


@query("a01_count_by_status", LEDGER + f"SELECT d.status, count(l.task_id) AS n FROM (VALUES {STATUS_DOMAIN}) d(status) LEFT JOIN ledger l ON l.status = d.status GROUP BY d.status")
def count_by_status(spark, sf_dir):
    return op.count_by_status(ledger(spark, sf_dir))


_BATCHES = "batches AS (SELECT batch_id, min(created_at) AS created_at FROM ledger GROUP BY batch_id), top AS (SELECT * FROM batches ORDER BY created_at DESC, batch_id LIMIT 10)"


@query("a02_list_batches", LEDGER + f", {_BATCHES} SELECT t.batch_id, count(*) AS total, " + ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS n_{s}" for s in op.STATUSES) + " FROM top t JOIN ledger l ON l.batch_id = t.batch_id GROUP BY t.batch_id")
def list_batches(spark, sf_dir):
    led = ledger(spark, sf_dir)
    return op.batch_status_counts(led, led.groupBy("batch_id").agg(F.min("created_at").alias("created_at")), 10)


_SUMMARY = """, s AS (SELECT batch_id, count(*) AS total, count(*) FILTER (WHERE status IN ('pending', 'retry_wait')) AS pending, count(*) FILTER (WHERE status = 'tts_done') AS to_render,
  count(*) FILTER (WHERE status = 'completed') AS done, count(*) FILTER (WHERE status = 'failed') AS failed, coalesce(avg(tts_duration) FILTER (WHERE status = 'completed' AND tts_duration > 0), 0) AS a
  FROM ledger GROUP BY batch_id) SELECT batch_id, total, pending, to_render, done, failed, greatest(pending * a / 2, (pending + to_render) * a / 2) AS eta_seconds FROM s"""


@query("ledger_batch_summary", LEDGER + _SUMMARY)
def batch_summary(spark, sf_dir):
    """A03; both queues take the whole-second speech durations, whose mean no order of summing changes."""
    led = ledger(spark, sf_dir)
    return op.batch_summary(led.withColumn("video_duration", F.col("tts_duration")))


@query("r01_changed_since", LEDGER + ", p AS (SELECT * FROM ledger WHERE updated_at > 860000000 OR (updated_at = 860000000 AND task_id > 5) ORDER BY updated_at, task_id LIMIT 501) SELECT task_id, status, updated_at, (SELECT count(*) FROM p) > 500 AS has_more, printf('%.9f', updated_at) || '|' || task_id AS cursor FROM p ORDER BY updated_at, task_id LIMIT 500")
def changed_since(spark, sf_dir):
    return op.changed_since(ledger(spark, sf_dir), 860000000.0, 5, 500).select("task_id", "status", "updated_at", "has_more", "cursor")


@query("r02_iter_all", LEDGER + "SELECT task_id, status FROM ledger")
def iter_all(spark, sf_dir):
    return ledger(spark, sf_dir).select("task_id", "status").orderBy("task_id")


@query("r04_next_claim", LEDGER + "SELECT task_id, batch_id, status FROM ledger WHERE status IN ('pending', 'retry_wait') AND next_attempt_at <= 50 AND batch_id NOT IN (3, 4) ORDER BY created_at, excel_row, task_id LIMIT 1")
def next_claim(spark, sf_dir):
    paused = spark.range(3, 5).withColumnRenamed("id", "batch_id")
    return op.next_claim(ledger(spark, sf_dir), ("pending", "retry_wait"), 50.0, paused).select("task_id", "batch_id", "status")


@query("r05_newest_by_fingerprint", LEDGER + "SELECT fingerprint, task_id, finished_at FROM (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY finished_at DESC, task_id DESC) AS k FROM ledger WHERE status = 'completed') WHERE k = 1")
def newest_by_fingerprint(spark, sf_dir):
    return op.newest_by_fingerprint(ledger(spark, sf_dir))


@query("j04_completed_by_fingerprints", LEDGER + "SELECT fingerprint, task_id, finished_at FROM (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY finished_at DESC, task_id DESC) AS k FROM ledger WHERE status = 'completed' AND fingerprint IN (SELECT 'fp-' || c_custkey FROM customer WHERE c_nationkey < 5)) WHERE k = 1")
def completed_by_fingerprints(spark, sf_dir):
    wanted = table(spark, sf_dir, "customer").where("c_nationkey < 5").select(F.concat(F.lit("fp-"), "c_custkey").alias("fingerprint"))
    return op.newest_by_fingerprint(ledger(spark, sf_dir), wanted=wanted)


_RECON = """, f AS (SELECT f.task_id, f.batch_id, f.output_path, l.output_path AS lo, l.status AS ls, l.status IS NULL OR l.batch_id <> f.batch_id AS orphan FROM ledger f LEFT JOIN ledger l ON f.leader_task_id = l.task_id WHERE f.status = 'waiting_dependency'),
r AS (SELECT task_id, batch_id, CASE WHEN orphan THEN 'failed' WHEN ls IN ('completed', 'failed', 'cancelled') THEN ls ELSE 'waiting_dependency' END AS new_status,
  CASE WHEN orphan THEN 'orphan_dependency' WHEN ls = 'failed' THEN 'leader_terminated' WHEN ls = 'cancelled' THEN 'cancelled' ELSE '' END AS error_type, CASE WHEN NOT orphan AND ls = 'completed' THEN lo ELSE output_path END AS output_path FROM f)"""


@query("j01_reconcile", LEDGER + _RECON + " SELECT * FROM r")
def reconcile(spark, sf_dir):
    return op.reconcile(ledger(spark, sf_dir)).select("task_id", "batch_id", "new_status", "error_type", "output_path")


@query("j01_reconcile_stats", LEDGER + _RECON + " SELECT count(*) FILTER (WHERE new_status = 'completed') AS follower_completed, count(*) FILTER (WHERE new_status = 'failed' AND error_type <> 'orphan_dependency') AS follower_failed, count(*) FILTER (WHERE new_status = 'cancelled') AS follower_cancelled, count(*) FILTER (WHERE error_type = 'orphan_dependency') AS follower_orphan_failed FROM r")
def reconcile_stats(spark, sf_dir):
    return op.reconcile_stats(ledger(spark, sf_dir))


@query("j02_followers", LEDGER + "SELECT task_id, leader_task_id FROM ledger WHERE leader_task_id IN (SELECT task_id FROM ledger WHERE status = 'completed')")
def followers(spark, sf_dir):
    led = ledger(spark, sf_dir)
    return op.followers(led, led.where("status = 'completed'")).select("task_id", "leader_task_id")


_PLAN = """, done AS (SELECT fingerprint, max(task_id) AS reused_task FROM ledger WHERE status = 'completed' AND task_id % 31 = 0 GROUP BY fingerprint),
j AS (SELECT l.batch_id, l.excel_row, l.fingerprint, l.task_id % 23 <> 0 AS valid, d.reused_task, min(CASE WHEN l.task_id % 23 <> 0 THEN l.excel_row END) OVER (PARTITION BY l.batch_id, l.fingerprint) AS first_row FROM ledger l LEFT JOIN done d USING (fingerprint)),
r AS (SELECT *, CASE WHEN NOT valid THEN 'invalid' WHEN reused_task IS NOT NULL THEN 'reused' WHEN excel_row = first_row THEN 'leader' ELSE 'follower' END AS role FROM j)"""


def _plan(spark, sf_dir):
    led = ledger(spark, sf_dir)
    done = led.where("status = 'completed' AND task_id % 31 = 0").groupBy("fingerprint").agg(F.max("task_id").alias("task_id"))
    return op.plan_batch(led.withColumn("valid", F.expr("task_id % 23 <> 0")), done)


@query("j25_plan_batch", LEDGER + _PLAN + " SELECT batch_id, excel_row, fingerprint, role, CASE WHEN role = 'follower' THEN first_row END AS leader_row, CASE WHEN role = 'reused' THEN reused_task END AS reused_task FROM r")
def plan_batch(spark, sf_dir):
    return _plan(spark, sf_dir)


@query("a09_start_batch_counts", LEDGER + _PLAN + " SELECT batch_id, count(*) FILTER (WHERE role = 'leader') AS added, count(*) FILTER (WHERE role = 'reused') AS reused, count(*) FILTER (WHERE role = 'follower') AS followers, count(*) FILTER (WHERE role = 'invalid') AS invalid FROM r GROUP BY batch_id")
def start_batch_counts(spark, sf_dir):
    return _plan(spark, sf_dir).groupBy("batch_id").agg(*[F.count_if(F.col("role") == r).alias(n) for r, n in (("leader", "added"), ("reused", "reused"), ("follower", "followers"), ("invalid", "invalid"))])


@query("m03_cancel", LEDGER + "SELECT task_id, status AS old_status, CASE WHEN status = 'tts_done' THEN 'cancelling' ELSE 'cancelled' END AS new_status FROM ledger WHERE status IN ('pending', 'retry_wait', 'waiting_dependency', 'tts_done')")
def cancel(spark, sf_dir):
    return op.cancel(ledger(spark, sf_dir))


@query("m02_advance", LEDGER + "SELECT task_id, CASE WHEN status = 'pending' AND task_id % 2 = 0 THEN 'validating' WHEN status = 'tts_done' AND task_id % 3 = 0 THEN 'video_running' ELSE status END AS status FROM ledger")
def advance(spark, sf_dir):
    led = ledger(spark, sf_dir)
    moves = led.select("task_id", F.explode(F.expr("array(named_struct('seq', 1, 'from_status', 'pending', 'to_status', CASE WHEN task_id % 2 = 0 THEN 'validating' END), named_struct('seq', 2, 'from_status', 'tts_done', 'to_status', CASE WHEN task_id % 3 = 0 THEN 'video_running' END), named_struct('seq', 3, 'from_status', 'completed', 'to_status', 'pending'))")).alias("m")).select("task_id", "m.*").where("to_status is not null")
    return op.advance(led, moves).select("task_id", "status")


@query("m05_recover", LEDGER + "SELECT task_id, status AS old_status, CASE WHEN task_id % 4 < 2 THEN 'tts_done' ELSE 'pending' END AS new_status FROM ledger WHERE status = 'tts_done'")
def recover(spark, sf_dir):
    led = ledger(spark, sf_dir)
    return op.recover(led, led.select("task_id", F.expr("task_id % 8 = 0").alias("has_output"), F.expr("task_id % 4 < 2").alias("has_speech")))


@query("m09_route_http_errors", "SELECT event_id, CASE WHEN c = 429 THEN 'retryable_429' WHEN c BETWEEN 500 AND 599 THEN 'retryable_5xx' WHEN c BETWEEN 400 AND 499 THEN 'client_4xx' ELSE 'other' END AS kind, CASE WHEN (c BETWEEN 400 AND 499 AND c <> 429) OR a >= 5 THEN 'failed' ELSE 'retry_wait' END AS new_status, CASE WHEN (c BETWEEN 400 AND 499 AND c <> 429) OR a >= 5 THEN 0.0 ELSE 100.0 + least(30.0, pow(2.0, greatest(a - 1, 0))) END AS next_attempt_at FROM (SELECT event_id, 380 + event_id % 150 AS c, event_id % 7 AS a FROM events)")
def route_http_errors(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.expr("380 + event_id % 150").alias("c"), F.expr("event_id % 7").alias("a"))
    kind, status, at = op.route_http_error(F.col("c"), F.col("a"), F.lit(100.0))
    return e.select("event_id", kind.alias("kind"), status.alias("new_status"), at.alias("next_attempt_at"))


@query("m10_retry_failed", LEDGER + "SELECT task_id, CASE WHEN leader_task_id IS NULL THEN 'pending' ELSE 'waiting_dependency' END AS new_status FROM ledger WHERE status = 'failed' AND error_type NOT IN ('excel_invalid', 'client_error', 'video_error')")
def retry_failed(spark, sf_dir):
    return op.retry_failed(ledger(spark, sf_dir))


@query("m12_reserve_paths", LEDGER + "SELECT task_id, CASE WHEN k = 1 THEN output_path ELSE regexp_replace(output_path, '\\.mp4$', '') || '_' || k || '.mp4' END AS path FROM (SELECT task_id, output_path, row_number() OVER (PARTITION BY output_path ORDER BY task_id) AS k FROM ledger)")
def reserve_paths(spark, sf_dir):
    return op.reserve_paths(ledger(spark, sf_dir).withColumnRenamed("output_path", "base_path"))


@query("u03_pending_ids", LEDGER + "SELECT task_id FROM ledger WHERE task_id NOT IN (SELECT task_id FROM ledger WHERE status = 'completed')")
def pending_ids(spark, sf_dir):
    led = ledger(spark, sf_dir)
    return led.join(led.where("status = 'completed'").select("task_id"), "task_id", "left_anti").select("task_id")


@query("k01_export_rows", LEDGER + "SELECT task_id, batch_id, status, text, CASE WHEN finished_at > 0 THEN strftime(make_timestamp(CAST(finished_at AS BIGINT) * 1000000), '%Y-%m-%d %H:%M:%S') ELSE '' END AS finished, printf('%.3f', tts_duration / 8) AS video_seconds FROM ledger")
def export_rows(spark, sf_dir):
    return op.export_rows(ledger(spark, sf_dir).withColumn("video_duration", F.col("tts_duration") / 8))
