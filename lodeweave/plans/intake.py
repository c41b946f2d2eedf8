"""Queries of ways into and out of a collection, of jobs after a stop, and of numbering scopes."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import functions as F

from ..operators import merge, ordering, segmentation
from ..sources import bundles, imports
from ..sources import tables as sources
from ..streaming import jobs
from .registry import query
from .text import _now


@query("""WITH p AS (SELECT conv_id AS set_id, turn AS selected, 2000 + turn * 700 AS width, 4500 - turn * 500 AS height, CASE WHEN turn % 2 = 0 THEN turn * 7 % 5 END AS taken, turn * 13 % 11 AS no FROM conversations),
o AS (SELECT *, CASE WHEN set_id % 3 = 0 THEN -selected ELSE row_number() OVER (PARTITION BY set_id ORDER BY taken NULLS LAST, no, selected) END AS place FROM p),
s AS (SELECT set_id, CAST(row_number() OVER (PARTITION BY set_id ORDER BY place, selected) AS INTEGER) AS page, selected, format('photo_{:02d}.page.jpg', selected + 1) AS file,
CAST(CASE WHEN greatest(width, height) > 3000 THEN round(width * 3000 / greatest(width, height)) ELSE width END AS INTEGER) AS width, CAST(CASE WHEN greatest(width, height) > 3000 THEN round(height * 3000 / greatest(width, height)) ELSE height END AS INTEGER) AS height FROM o WHERE set_id % 3 > 0 OR selected <> 1)
SELECT *, round(width * 0.36, 2)::DOUBLE AS width_pt, round(height * 0.36, 2)::DOUBLE AS height_pt FROM s""")
def src8_photo_pages(env):
    turn = F.col("turn")
    files = env.table("conversations").select(F.col("conv_id").alias("set_id"), turn.alias("selected"), (turn * 700 + 2000).alias("width"), (F.lit(4500) - turn * 500).alias("height"), F.when(turn % 2 == 0, turn * 7 % 5).alias("taken"), F.concat(F.lit("img"), turn * 13 % 11, F.lit(".jpg")).alias("name"))
    # A third of the sets were put in order by hand: backwards, without the second photo.
    told = files.where("set_id % 3 = 0 and selected <> 1").select("set_id", "selected", (-F.col("selected")).alias("place"))
    return imports.photo_pages(ordering.natural_order(files), told)


@query("""SELECT d.doc_id AS id, CASE WHEN d.doc_id % 4 = 0 THEN NULL WHEN d.doc_id % 6 = 1 THEN d.doc_id * 10 END AS paper_id, CASE WHEN d.doc_id % 4 <> 0 THEN concat('paper-', d.doc_id) END AS filename, CASE WHEN d.doc_id % 4 <> 0 THEN d.lang END AS kind,
CASE WHEN d.doc_id % 4 <> 0 THEN sha256(d.text) END AS sha256, CASE WHEN d.doc_id % 4 = 0 THEN 'missing' WHEN d.doc_id % 6 = 1 THEN 'known' ELSE 'new' END AS state FROM documents d WHERE d.doc_id % 3 < 2""")
def src9_sibling_import(env):
    d = env.table("documents")
    sibling = d.where("doc_id % 4 <> 0").select(F.col("doc_id").alias("id"), F.concat(F.lit("paper-"), F.col("doc_id")).alias("filename"), F.col("lang").alias("kind"), "text")
    papers = d.where("doc_id % 6 = 1").select((F.col("doc_id") * 10).alias("paper_id"), F.col("doc_id").alias("imported_from"))
    return imports.import_parsed(papers, sibling, d.where("doc_id % 3 < 2").select(F.col("doc_id").alias("id")), F.col("text"))


@query("""SELECT CAST(pos AS INTEGER) AS pos, title, parent FROM (VALUES (0, 'Numbers', NULL), (1, 'Whole numbers', 'Numbers'), (2, 'Place value', 'Whole numbers'), (3, 'Divisibility', 'Whole numbers'), (4, 'Fractions', 'Numbers'), (5, 'Common denominators', 'Fractions'), (6, 'Geometry', NULL),
(7, 'Plane figures', 'Geometry'), (8, 'Triangles', 'Plane figures'), (9, 'Circles', 'Plane figures'), (10, 'Solids', 'Geometry'), (11, 'Data', NULL), (12, 'Averages', 'Data'), (13, 'Charts', 'Data')) v(pos, title, parent)""")
def src17_template(env):
    topics = sources.outline(imports.template_lines(env.spark))
    above = topics.select(F.col("pos").alias("parent"), F.col("title").alias("name"))
    return topics.join(above, "parent", "left").select("pos", "title", F.col("name").alias("parent"))


@query("""WITH k AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'), l AS (SELECT * FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM k)), c AS (SELECT * FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'))
SELECT 'orders' AS name, count(*) AS rows, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'lineitem', count(*), CAST(sum(l_orderkey) AS BIGINT) FROM l UNION ALL SELECT 'customer', count(*), CAST(sum(c_custkey) AS BIGINT) FROM c""")
def snk1_bundle(env):
    orders = env.table("orders").withColumn("id", F.col("o_orderkey"))
    kept = orders.where("o_orderstatus = 'F'").select("id")
    chosen = {"orders": orders.join(kept, "id", "left_semi")}
    chosen |= merge.closed_subset({"orders": orders, "lineitem": env.table("lineitem"), "customer": env.table("customer")}, kept, [("lineitem", "l_orderkey", "orders", "o_orderkey"), ("customer", "c_custkey", "orders", "o_custkey")])
    at = f"{_folder(env.spark)}/bundle-{uuid.uuid4().hex}"
    written, keys = bundles.write_bundle(chosen, at), {"orders": "o_orderkey", "lineitem": "l_orderkey", "customer": "c_custkey"}
    back = bundles.read_bundle(env.spark, at)
    sums = [back[n].agg(F.lit(n).alias("name"), F.count("*").alias("rows"), F.sum(k).alias("keys")) for n, k in keys.items()]
    read = [tuple(r) for r in sums[0].unionAll(sums[1]).unionAll(sums[2]).collect()]  # a row a table
    bundles.drop_bundle(env.spark, at)
    if {n: rows for n, rows, _ in read} != written:
        raise ValueError("the bundle does not hold what was written")
    return env.rows(read, "name string, rows long, keys long")


def _folder(spark) -> str:
    """The cluster's shared folder; a session without one, as in tests, gets a temporary one that is deleted at its end."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("a bundle needs a folder that executors share: set spark.checkpoint.dir")
    here = tempfile.mkdtemp(prefix="lodeweave-")
    atexit.register(shutil.rmtree, here, True)
    return f"file://{here}"


def _left_jobs(env):
    """Jobs of two kinds of workers in three states, created in the hour before the last event."""
    n, ts = F.col("event_id"), F.lit(_now(env)).cast("timestamp") - F.make_dt_interval(mins=F.col("event_id") % 60)
    state = F.element_at(F.array(*map(F.lit, ("queued", "running", "done"))), (n % 3 + 1).cast("int"))
    return env.table("events").select(n.alias("job_id"), F.when(n % 5 < 3, "api").otherwise("agent").alias("executor"), state.alias("status"), ts.alias("created_at"), (ts + F.make_dt_interval(mins=n % 7)).alias("claimed_at"))


LEFT = """l AS (SELECT event_id AS job_id, CASE WHEN event_id % 5 < 3 THEN 'api' ELSE 'agent' END AS executor, CASE event_id % 3 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' ELSE 'done' END AS status,
CAST(event_id % 60 AS BIGINT) AS age, CAST(event_id % 60 - event_id % 7 AS BIGINT) AS held FROM events)"""


@query(f"WITH {LEFT} SELECT job_id, executor, CASE WHEN executor = 'api' AND ((status = 'queued' AND age >= 30) OR (status = 'running' AND held >= 4)) THEN 'failed' WHEN executor = 'api' AND status = 'running' THEN 'queued' ELSE status END AS status FROM l")
def str4_recovered_jobs(env):
    return jobs.recovered(_left_jobs(env), _now(env)).select("job_id", "executor", "status")


@query(f"WITH {LEFT} SELECT job_id, greatest(0, 1800 - held * 60) AS lease_left, CASE status WHEN 'queued' THEN (30 - age) * 60 WHEN 'running' THEN (4 - held) * 60 END AS fails_in FROM l")
def dat1_lease_times(env):
    now = _now(env)
    timed = jobs.lease_times(_left_jobs(env), now)
    return timed.select("job_id", "lease_left", (F.unix_timestamp("fails_at") - F.unix_timestamp(F.lit(now).cast("timestamp"))).alias("fails_in"))


@query("""WITH c AS (SELECT event_id, event_id % 67 / 2 AS a, event_id % 11 <> 0 AS ok, event_id % 23 + 1 AS b, event_id % 4 <> 0 AS ok2, event_id % 5 <> 0 AND event_id % 67 / 2 > 18 AS sent FROM events),
e AS (SELECT *, CASE WHEN ok THEN a END AS one, CASE WHEN sent AND ok2 THEN b + 18 END AS two FROM c)
SELECT event_id AS call_id, sent AS hedged, CASE WHEN one <= coalesce(two, one) THEN 'first' WHEN two IS NOT NULL THEN 'second' END AS answered_by, CAST(coalesce(least(one, two), CASE WHEN sent THEN greatest(a, b + 18) ELSE a END) AS DOUBLE) AS seconds FROM e""")
def str7_hedged_calls(env):
    n = F.col("event_id")
    calls = env.table("events").select(n.alias("call_id"), (n % 67 / 2).alias("first_s"), (n % 11 != 0).alias("first_ok"), (n % 23 + 1).cast("double").alias("second_s"), (n % 4 != 0).alias("second_ok"), (n % 5 != 0).alias("spare"))
    return jobs.hedged(calls).select("call_id", "hedged", "answered_by", "seconds")


# Books of sixteen orders: each order's lines are numbered anew, two or three orders a page, some
# lines read twice, some numbers that belong to none.
_BOOK = """b AS (SELECT CAST(l_orderkey // 16 AS BIGINT) AS paper_id, l_orderkey % 16 AS part, l_linenumber AS line, CAST(CASE WHEN min(l_partkey) % 13 = 0 THEN 9 ELSE l_linenumber END AS INTEGER) AS number, min(l_partkey) % 11 = 0 AS twice FROM lineitem GROUP BY 1, 2, 3, l_orderkey),
s AS (SELECT paper_id, CAST(part * 20 + line * 2 + k AS INTEGER) AS seq, CAST(part * 2 // 5 AS INTEGER) AS page, number, CAST((part * 20 + line * 2) * 40 + k * 12 AS DOUBLE) AS y FROM b, (VALUES (0), (1)) v(k) WHERE k = 0 OR twice)"""


@query(f"""WITH RECURSIVE {_BOOK}, q AS (SELECT *, coalesce(lag(number) OVER w = number AND lag(page) OVER w = page AND y - lag(y) OVER w < 60, false) AS again FROM s WINDOW w AS (PARTITION BY paper_id ORDER BY page, y, seq)),
n AS (SELECT *, row_number() OVER w AS k, lead(number) OVER w AS after FROM q WHERE NOT again WINDOW w AS (PARTITION BY paper_id ORDER BY page, y, seq)),
r AS (SELECT paper_id, CAST(0 AS BIGINT) AS k, 0 AS run, CAST([] AS INTEGER[]) AS held, CAST(NULL AS INTEGER) AS seq, CAST(NULL AS INTEGER) AS page, CAST(NULL AS INTEGER) AS number, false AS used FROM (SELECT DISTINCT paper_id FROM n)
UNION ALL SELECT paper_id, k, CASE WHEN back AND NOT stray THEN run + 1 ELSE run END, CASE WHEN stray THEN held WHEN back THEN [number] ELSE list_append(held, number) END, seq, page, number, NOT stray FROM (
  SELECT *, back AND coalesce(after > top AND after <= top + 3, false) AS stray FROM (
    SELECT n.paper_id, n.k, run, held, n.seq, n.page, n.number, after, coalesce(list_max(held), 0) AS top, n.number <= coalesce(list_max(held), 0) AND (n.number <= 3 OR list_contains(held, n.number)) AS back FROM r JOIN n ON n.paper_id = r.paper_id AND n.k = r.k + 1))),
g AS (SELECT paper_id, run, count(*) AS size, arg_min(number, k) AS number, arg_min(page, k) AS page, arg_min(seq, k) AS seq, arg_max(page, k) AS last FROM r WHERE used GROUP BY 1, 2),
o AS (SELECT *, sum(CASE WHEN run = 0 OR size > 1 OR number <= 3 THEN 1 ELSE 0 END) OVER (PARTITION BY paper_id ORDER BY run) - 1 AS scope FROM g),
e AS (SELECT paper_id, CAST(scope AS INTEGER) AS scope, arg_min(number, run) AS number, arg_min(page, run) AS page, arg_min(seq, run) AS seq, arg_max(last, run) AS last FROM o GROUP BY 1, 2),
f AS (SELECT *, lead(page) OVER w AS np, lead(seq) OVER w AS ns, min(p.a) OVER w2 AS a, min(p.z) OVER w2 AS z FROM e JOIN (SELECT paper_id, min(page) AS a, max(page) AS z FROM s GROUP BY 1) p USING (paper_id) WINDOW w AS (PARTITION BY paper_id ORDER BY scope), w2 AS (PARTITION BY paper_id))
SELECT paper_id, scope, number AS first_number, CASE WHEN scope = 0 THEN a ELSE page END AS first_page, CASE WHEN np IS NULL THEN z WHEN np = last THEN np ELSE np - 1 END AS last_page, CASE WHEN scope > 0 THEN seq END AS seq_start, ns - 1 AS seq_end FROM f""")
def win4_numbering_scopes(env):
    t = env.table("lineitem").groupBy("l_orderkey", F.col("l_linenumber").alias("line")).agg(F.min("l_partkey").alias("part"))
    key, at = F.col("l_orderkey"), F.col("l_orderkey") % 16 * 20 + F.col("line") * 2
    k = F.explode(F.when(F.col("part") % 11 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("k")
    number = F.when(F.col("part") % 13 == 0, 9).otherwise(F.col("line")).cast("int")
    read = t.select(F.floor(key / 16).alias("paper_id"), at.alias("at"), F.floor(key % 16 * 2 / 5).cast("int").alias("page"), number.alias("number"), k)
    starts = read.select("paper_id", (F.col("at") + F.col("k")).cast("int").alias("seq"), "page", F.lit(0).alias("column"), (F.col("at") * 40 + F.col("k") * 12).cast("double").alias("y"), "number", F.lit(3.0).alias("score"), F.lit(True).alias("at_start"))
    return segmentation.numbering_scopes(starts.select("paper_id", "page"), starts)
