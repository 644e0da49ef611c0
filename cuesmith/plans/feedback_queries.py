"""Feedback operators over events: a user is an account, a type a platform, the
value's whole part its plays."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import feedback as op
from ..operators import matching as mt
from ..operators import similarity as sim
from .registry import query, table

RECORDS = """
WITH records AS (SELECT event_id AS seq, user_id AS account, event_type AS platform, 'clip_' || (event_id % 400) || '.mp4' AS file, CASE WHEN event_id % 3 = 0 THEN '' ELSE 'imp' || lpad(CAST(event_id % 50 AS VARCHAR), 3, '0') END AS import_id,
  CAST(floor(value) AS BIGINT) AS plays, CASE WHEN event_id % 10 = 0 THEN 'yes' ELSE 'no' END AS flag, CASE event_type WHEN 'error' THEN 'rejected_duplicate' WHEN 'signup' THEN 'pending' ELSE 'published' END AS status FROM events),
latest AS (SELECT *, min(seq) OVER (PARTITION BY file, platform) AS first_seen, row_number() OVER (PARTITION BY file, platform ORDER BY import_id <> '' DESC, import_id DESC, seq DESC) AS k FROM records QUALIFY k = 1)
"""


def records(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), F.col("user_id").alias("account"), F.col("event_type").alias("platform"), F.expr("concat('clip_', event_id % 400, '.mp4')").alias("file"),
        F.expr("CASE WHEN event_id % 3 = 0 THEN '' ELSE concat('imp', lpad(CAST(event_id % 50 AS STRING), 3, '0')) END").alias("import_id"), F.expr("CAST(floor(value) AS BIGINT)").alias("plays"),
        F.expr("CASE WHEN event_id % 10 = 0 THEN 'yes' ELSE 'no' END").alias("flag"), F.expr("CASE event_type WHEN 'error' THEN 'rejected_duplicate' WHEN 'signup' THEN 'pending' ELSE 'published' END").alias("status"),
    )


def latest(spark, sf_dir):
    return op.latest_records(records(spark, sf_dir), ["file", "platform"])


@query("t01_latest_records", RECORDS + "SELECT file, platform, first_seen, seq, import_id, plays FROM latest")
def latest_records(spark, sf_dir):
    return latest(spark, sf_dir).select("file", "platform", "first_seen", "seq", "import_id", "plays")


@query("a04_review_counts", RECORDS + "SELECT 'status' AS dimension, status AS value, count(*) AS n FROM latest GROUP BY status UNION ALL SELECT 'platform', platform, count(*) FROM latest GROUP BY platform UNION ALL SELECT 'account', CAST(account AS VARCHAR), count(*) FROM latest GROUP BY account UNION ALL SELECT 'flag', flag, count(*) FROM latest GROUP BY flag")
def review_counts(spark, sf_dir):
    return op.review_counts(latest(spark, sf_dir), ["status", "platform", "account", "flag"])


@query("a04_account_plays", RECORDS + "SELECT account, CAST(sum(plays) AS BIGINT) AS play_total, count(plays) AS play_count, avg(plays) AS play_avg FROM latest GROUP BY account")
def account_plays(spark, sf_dir):
    return op.account_plays(latest(spark, sf_dir), "account", "plays")


@query("f10_duplicates", RECORDS + "SELECT seq, file FROM latest WHERE flag = 'yes' OR status = 'rejected_duplicate'")
def duplicates(spark, sf_dir):
    return latest(spark, sf_dir).where(op.is_duplicate(F.col("flag"), F.col("status"))).select("seq", "file")


@query("a05_number_stats", RECORDS + "SELECT platform, count(plays) AS n, min(plays) AS least, median(plays) AS middle, max(plays) AS most FROM latest GROUP BY platform")
def number_stats(spark, sf_dir):
    return op.number_stats(latest(spark, sf_dir), ["platform"], "plays")


@query("a06_calibration", RECORDS + "SELECT count(*) FILTER (WHERE flag = 'yes') AS n_duplicate, count(*) FILTER (WHERE flag <> 'yes') AS n_normal, count(*) FILTER (WHERE flag = 'yes') >= 5 AND count(*) FILTER (WHERE flag <> 'yes') >= 10 AS enough, median(plays) FILTER (WHERE flag = 'yes') AS duplicate_median, median(plays) FILTER (WHERE flag <> 'yes') AS normal_median FROM latest")
def calibration(spark, sf_dir):
    return op.calibration(latest(spark, sf_dir), F.col("flag") == "yes", "plays")


@query("a07_top_recipes", RECORDS + "SELECT platform || '|' || (account % 9) AS recipe, count(*) AS n, round(avg(plays), 1) AS avg_play, round(avg(seq % 100), 4) AS avg_finish FROM records GROUP BY 1 HAVING count(*) >= 3 ORDER BY avg_finish DESC, avg_play DESC, recipe LIMIT 5")
def top_recipes(spark, sf_dir):
    r = records(spark, sf_dir).withColumns({"recipe": F.expr("concat(platform, '|', account % 9)"), "finish": F.expr("seq % 100")})
    return op.top_recipes(r, "recipe", "plays", "finish", 5, 3)


@query("a08_account_health", RECORDS + ", h AS (SELECT account, count(*) AS published, count(*) FILTER (WHERE p = 0) AS zero, sum(p) / count(*) AS avg_play FROM (SELECT account, CASE WHEN account % 4 = 0 AND seq % 3 > 0 THEN 0 ELSE plays END AS p FROM records) GROUP BY account) SELECT account, published, zero, avg_play, CASE WHEN published >= 3 AND zero / published >= 0.6 THEN 'risk' WHEN round(avg_play, 1) < 100 THEN 'warn' ELSE 'ok' END AS level FROM h")
def account_health(spark, sf_dir):
    r = records(spark, sf_dir).withColumn("p", F.expr("CASE WHEN account % 4 = 0 AND seq % 3 > 0 THEN 0 ELSE plays END"))
    return op.account_health(r, "account", "p")


_CHECKS = RECORDS + ", checks AS (SELECT seq AS entry_id, 'plays' AS rule, CASE WHEN plays < 5 THEN 'risk' ELSE 'ok' END AS level FROM records UNION ALL SELECT seq, 'status', CASE WHEN status = 'pending' THEN 'warn' ELSE 'ok' END FROM records UNION ALL SELECT seq, 'flag', CASE WHEN flag = 'yes' THEN 'warn' ELSE 'ok' END FROM records)"


def _checks(spark, sf_dir):
    r = records(spark, sf_dir).withColumn("entry_id", F.col("seq"))
    return op.checklist(r, {"plays": (F.col("plays") < 5, "risk"), "status": (F.col("status") == "pending", "warn"), "flag": (F.col("flag") == "yes", "warn")})


@query("a11_checklist", _CHECKS + " SELECT entry_id, rule, level FROM checks")
def checklist(spark, sf_dir):
    return _checks(spark, sf_dir)


@query("a11_overall_level", _CHECKS + " SELECT entry_id, CASE max(CASE level WHEN 'risk' THEN 2 WHEN 'warn' THEN 1 ELSE 0 END) WHEN 2 THEN 'risk' WHEN 1 THEN 'warn' ELSE 'ok' END AS level FROM checks GROUP BY entry_id")
def overall_level(spark, sf_dir):
    return op.overall_level(_checks(spark, sf_dir), ["entry_id"])


@query("a20_level_histogram", _CHECKS + " SELECT d.level, count(c.level) AS n FROM (VALUES ('ok'), ('warn'), ('risk'), ('error')) d(level) LEFT JOIN checks c ON c.level = d.level GROUP BY d.level")
def level_histogram(spark, sf_dir):
    return op.histogram(_checks(spark, sf_dir), "level", ("ok", "warn", "risk", "error"))


@query("a18_compare_versions", "SELECT a.user_id, CASE WHEN (a.f, a.p) > (b.f, b.p) THEN 'a' WHEN (a.f, a.p) < (b.f, b.p) THEN 'b' ELSE 'tie' END AS winner FROM (SELECT user_id, count(*) AS f, CAST(sum(floor(value)) AS BIGINT) AS p FROM events WHERE event_type = 'click' GROUP BY user_id) a JOIN (SELECT user_id, count(*) AS f, CAST(sum(floor(value)) AS BIGINT) AS p FROM events WHERE event_type = 'view' GROUP BY user_id) b USING (user_id)")
def compare_versions(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(*[f(F.col("event_type") == t).alias(f"{n}_{t}") for t in ("click", "view") for n, f in (("f", F.count_if), ("p", lambda c: F.sum(F.when(c, F.floor("value")))))])
    return e.where("f_click > 0 AND f_view > 0").select("user_id", op.compare_versions(F.col("p_click"), F.col("p_view"), F.col("f_click"), F.col("f_view")).alias("winner"))


PAIRS = "pairs AS (SELECT l_partkey AS left_id, 100000 + l_suppkey AS right_id, l_quantity / 50 AS similarity, l_orderkey * 10 + l_linenumber AS seq, CASE WHEN l_quantity / 50 >= 0.92::DOUBLE THEN 'high' WHEN l_quantity / 50 >= 0.92::DOUBLE - 0.1::DOUBLE THEN 'medium' ELSE 'low' END AS level FROM lineitem)"


def pairs(spark, sf_dir):
    from ..functions.similar import level

    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("left_id"), (F.col("l_suppkey") + 100000).alias("right_id"), (F.col("l_quantity") / 50).alias("similarity"), F.expr("l_orderkey * 10 + l_linenumber").alias("seq")).withColumn("level", level(F.col("similarity"), 0.92))


@query("j14_max_similarity", f"WITH {PAIRS}, e AS (SELECT left_id AS item, right_id AS partner, similarity FROM pairs UNION ALL SELECT right_id, left_id, similarity FROM pairs) SELECT item, similarity AS most, partner FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY similarity DESC, partner) AS k FROM e) WHERE k = 1")
def max_similarity(spark, sf_dir):
    return op.max_similarity(pairs(spark, sf_dir))


@query("a16_worst_level", f"WITH {PAIRS}, e AS (SELECT left_id AS item, level FROM pairs UNION ALL SELECT right_id, level FROM pairs) SELECT item, CASE max(CASE level WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END) WHEN 2 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS level FROM e GROUP BY item")
def worst_level(spark, sf_dir):
    return sim.worst_level(pairs(spark, sf_dir))


@query("a10_risk_histogram", f"WITH {PAIRS} SELECT d.level, count(p.level) AS n FROM (VALUES ('high'), ('medium'), ('low')) d(level) LEFT JOIN pairs p ON p.level = d.level GROUP BY d.level")
def risk_histogram(spark, sf_dir):
    return op.histogram(pairs(spark, sf_dir), "level", ("high", "medium", "low"))


@query("u02_without_similar", f"WITH {PAIRS}, h AS (SELECT left_id AS i FROM pairs WHERE level = 'high' UNION SELECT right_id FROM pairs WHERE level = 'high') SELECT p_partkey AS item FROM part WHERE p_partkey NOT IN (SELECT i FROM h)")
def without_similar(spark, sf_dir):
    return sim.without_similar(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item")), "item", pairs(spark, sf_dir))


@query("j09_pair_lookup", f"WITH {PAIRS}, k AS (SELECT left_id, right_id, arg_max(similarity, seq) AS similarity FROM pairs GROUP BY ALL) SELECT w.a, w.b, k.similarity FROM (SELECT 100000 + s_suppkey AS a, s_suppkey * 3 AS b FROM supplier) w LEFT JOIN k ON k.left_id = least(w.a, w.b) AND k.right_id = greatest(w.a, w.b)".replace("GROUP BY ALL", "GROUP BY left_id, right_id"))
def pair_lookup(spark, sf_dir):
    wanted = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 100000).alias("a"), (F.col("s_suppkey") * 3).alias("b"))
    return sim.pair_lookup(pairs(spark, sf_dir), wanted)


@query("j10_sources_of_similar", f"WITH {PAIRS}, e AS (SELECT left_id AS o FROM pairs WHERE similarity >= 0.92 UNION SELECT right_id FROM pairs WHERE similarity >= 0.92) SELECT coalesce(p.p_size, CAST(e.o AS BIGINT)) AS source, count(*) AS outputs FROM e LEFT JOIN (SELECT p_partkey, CAST(p_size AS BIGINT) AS p_size FROM part WHERE p_partkey % 5 > 0) p ON p.p_partkey = e.o GROUP BY 1")
def sources_of_similar(spark, sf_dir):
    manifest = table(spark, sf_dir, "part").where("p_partkey % 5 > 0").select(F.col("p_partkey").alias("output"), F.col("p_size").cast("long").alias("source"))
    return sim.sources_of_similar(pairs(spark, sf_dir), manifest, 0.92)


_MATCH = """WITH q AS (SELECT o_orderkey AS ord, 'x' || (o_orderkey % 700) AS ext, lower(o_orderpriority || (o_orderkey % 90)) AS title, '/v/' || o_custkey || '.mp4' AS path FROM orders),
s AS (SELECT event_id AS id, CASE WHEN event_id % 4 = 0 THEN 'x' || (event_id % 900) ELSE '' END AS ext, '/v/' || (event_id % 2000) || '.mp4' AS path, '1-urgent' || (event_id % 120) AS title FROM events),
c AS (SELECT s.id, 1 AS no, q.ord, q.title FROM s JOIN q ON s.ext = q.ext WHERE s.ext <> '' UNION ALL SELECT s.id, 2, q.ord, q.title FROM s JOIN q ON s.path = q.path UNION ALL SELECT s.id, 3, q.ord, q.title FROM s JOIN q ON s.title = q.title),
b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY no, ord) AS k FROM c)
SELECT s.id, b.no AS key_no, b.ord AS queue_ord, b.title AS queue_title FROM s LEFT JOIN b ON b.id = s.id AND b.k = 1"""


@query("j11_prioritised_match", _MATCH)
def prioritised_match(spark, sf_dir):
    q = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ord"), F.col("o_orderkey").alias("queue_ord"), F.expr("concat('x', o_orderkey % 700)").alias("q_ext"), F.expr("lower(concat(o_orderpriority, o_orderkey % 90))").alias("queue_title"), F.expr("concat('/v/', o_custkey, '.mp4')").alias("q_path"))
    s = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.expr("CASE WHEN event_id % 4 = 0 THEN concat('x', event_id % 900) ELSE '' END").alias("ext"), F.expr("concat('/v/', event_id % 2000, '.mp4')").alias("path"), F.expr("concat('1-urgent', event_id % 120)").alias("title"))
    keys = [(F.col("ext"), F.col("q_ext")), (F.col("path"), F.col("q_path")), (F.col("title"), F.col("queue_title"))]
    return mt.prioritised_match(s, q, "id", "ord", keys, ["queue_ord", "queue_title"]).select("id", "key_no", "queue_ord", "queue_title")


@query("j15_caption_map", "WITH e AS (SELECT 'k' || (o_custkey % 800) AS key, 0 AS no, o_orderkey AS ord, o_orderpriority AS caption FROM orders UNION ALL SELECT 'k' || c_custkey, 1, c_custkey, c_mktsegment FROM customer) SELECT key, ord, caption FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY no, ord) AS k FROM e) WHERE k = 1")
def caption_map(spark, sf_dir):
    a = table(spark, sf_dir, "orders").select(F.expr("concat('k', o_custkey % 800)").alias("key"), F.col("o_orderkey").alias("ord"), F.col("o_orderpriority").alias("caption"))
    b = table(spark, sf_dir, "customer").select(F.expr("concat('k', c_custkey)").alias("key"), F.col("c_custkey").alias("ord"), F.col("c_mktsegment").alias("caption"))
    return mt.first_of_tables([a, b], "key", "ord")


@query("s17_prefer_source", "WITH f AS (SELECT c_custkey AS id, 'first' AS origin FROM customer WHERE c_acctbal > 9000), s AS (SELECT o_orderkey AS id, 'second' AS origin FROM orders) SELECT * FROM f UNION ALL SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM f)")
def prefer_source(spark, sf_dir):
    """The first table that has rows: well-filled accounts, else all orders."""
    rich = table(spark, sf_dir, "customer").where("c_acctbal > 9000").select(F.col("c_custkey").alias("id"), F.lit("first").alias("origin"))
    none = rich.where("id < 0")
    return mt.prefer_source([none, rich, table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.lit("second").alias("origin"))])


_ALLOC = "WITH a AS (SELECT c_nationkey AS g, c_custkey AS account, c_custkey % 3 AS n FROM customer WHERE c_custkey % 3 > 0), s AS (SELECT g, account, row_number() OVER (PARTITION BY g ORDER BY account, i) AS slot FROM a, unnest(range(n)) t(i)), v AS (SELECT s_nationkey AS g, s_suppkey AS video, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS slot, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier)"


def _alloc(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("g"), F.col("c_custkey").alias("account"), F.expr("CAST(c_custkey % 3 AS INT)").alias("n")).where("n > 0")
    return a, table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("g"), F.col("s_suppkey").alias("video"))


@query("j23_build_queue", _ALLOC + " SELECT s.g, s.account, s.slot, v.video FROM s JOIN v ON v.g = s.g AND v.slot = s.slot")
def build_queue(spark, sf_dir):
    return mt.allocate(*_alloc(spark, sf_dir), "account", "n", "video", "g").select("g", "account", "slot", "video")


@query("j23_build_queue_reuse", _ALLOC + " SELECT s.g, s.account, s.slot, v.video FROM s JOIN v ON v.g = s.g AND v.slot = (s.slot - 1) % v.n + 1")
def build_queue_reuse(spark, sf_dir):
    return mt.allocate(*_alloc(spark, sf_dir), "account", "n", "video", "g", reuse=True).select("g", "account", "slot", "video")


@query("j26_title_candidates", "SELECT p_partkey, style, score, selected FROM part, (VALUES ('plain', 90.0::DOUBLE, true), ('question', 87.0::DOUBLE, false), ('number', 84.0::DOUBLE, false)) s(style, score, selected)")
def title_candidates(spark, sf_dir):
    return mt.styled(table(spark, sf_dir, "part"), "p_partkey", [("plain", 90.0), ("question", 88.0), ("number", 86.0)])


@query("j27_titles_with_default", "SELECT p_partkey, CASE WHEN p_size > 25 THEN p_name ELSE ['first', 'second', 'third'][1 + (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1) % 3] END AS title FROM part")
def titles_with_default(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.expr("CASE WHEN p_size > 25 THEN p_name END").alias("title"))
    return mt.with_default(p, "title", "p_partkey", "p_brand", ["first", "second", "third"]).select("p_partkey", "title")


@query("w05_merge_status", "WITH u AS (SELECT event_id % 3000 AS id, event_id AS seq, event_type AS status, CASE WHEN event_id % 2 = 0 THEN props END AS note FROM events), l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS k FROM u) WHERE k = 1) SELECT o_orderkey AS id, coalesce(l.status, o_orderstatus) AS status, coalesce(l.note, o_orderpriority) AS note FROM orders LEFT JOIN l ON l.id = o_orderkey")
def merge_status(spark, sf_dir):
    q = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("note"))
    u = table(spark, sf_dir, "events").select(F.expr("event_id % 3000").alias("id"), F.col("event_id").alias("seq"), F.col("event_type").alias("status"), F.expr("CASE WHEN event_id % 2 = 0 THEN props END").alias("note"))
    return mt.merge_status(q, u, "id", "seq", ["status", "note"])


@query("w08_remember_pairs", "SELECT user_id AS slot, event_type AS platform FROM events WHERE event_id % 2 = 0 GROUP BY 1, 2 UNION SELECT user_id, event_type FROM events")
def remember_pairs(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("slot"), F.col("event_type").alias("platform"))
    return mt.remember_pairs(e.where("event_id % 2 = 0").select("slot", "platform").distinct(), e.select("slot", "platform"), ["slot", "platform"])


@query("r08_selected_titles", "SELECT p_brand, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_size = 7 DESC, p_retailprice DESC, p_partkey) AS k FROM part) WHERE k = 1")
def selected_titles(spark, sf_dir):
    return op.latest_per_group(table(spark, sf_dir, "part"), ["p_brand"], [(F.col("p_size") == 7).desc(), F.desc("p_retailprice"), F.asc("p_partkey")]).select("p_brand", "p_partkey")


@query("r09_priority_candidates", "SELECT p_partkey, p_type FROM part ORDER BY CASE p_type WHEN 'PROMO' THEN 0 WHEN 'ECONOMY' THEN 1 ELSE 99 END, p_retailprice DESC, p_partkey LIMIT 20")
def priority_candidates(spark, sf_dir):
    rank = F.coalesce(F.try_element_at(F.create_map(F.lit("PROMO"), F.lit(0), F.lit("ECONOMY"), F.lit(1)), F.col("p_type")), F.lit(99))
    return table(spark, sf_dir, "part").orderBy(rank, F.desc("p_retailprice"), "p_partkey").limit(20).select("p_partkey", "p_type")


@query("u01_union_distinct", "SELECT text_key, min(ord) AS ord FROM (SELECT o_orderpriority AS text_key, o_orderkey AS ord FROM orders UNION ALL SELECT c_mktsegment, 1000000 + c_custkey FROM customer) GROUP BY text_key")
def union_distinct(spark, sf_dir):
    a = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("text_key"), F.col("o_orderkey").alias("ord"))
    b = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("text_key"), (F.col("c_custkey") + 1000000).alias("ord"))
    return a.unionByName(b).groupBy("text_key").agg(F.min("ord").alias("ord"))


@query("a13_counts_by_role", "SELECT source, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS size FROM documents GROUP BY source")
def counts_by_role(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("files"), F.sum("n_chars").alias("size"))


@query("a17_rows_by_query", "SELECT n_nationkey, count(c_custkey) AS n, coalesce(list(c_custkey ORDER BY c_custkey) FILTER (WHERE c_custkey IS NOT NULL), CAST([] AS BIGINT[])) AS customers FROM nation LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 9000) ON c_nationkey = n_nationkey GROUP BY n_nationkey")
def rows_by_query(spark, sf_dir):
    c = table(spark, sf_dir, "customer").where("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list("c_custkey")).alias("customers"))
    return table(spark, sf_dir, "nation").join(c, "n_nationkey", "left").select("n_nationkey", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("customers", F.array().cast("array<bigint>")).alias("customers"))
