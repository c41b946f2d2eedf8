"""Further rows of the inventory that share operators with other queries."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import markup, text
from ..operators import cards, evaluation, facets, figures, ordering, related, taxonomy
from ..operators.filters import FilterSpec
from ..sources import bundles
from ..streaming import jobs, pool
from .registry import query


@query("SELECT doc_id, CAST(k AS INTEGER) AS seq, concat('b', CAST(k AS VARCHAR)) AS text FROM (SELECT doc_id, unnest(range(3)) AS k FROM documents) WHERE (doc_id + k) % 3 = 0")
def src6_ocr_tables(env):
    block = lambda k: F.concat(F.lit('{"type":"'), F.when((F.col("doc_id") + k) % 3 == 0, "table").otherwise("text"), F.lit(f'","page":{k},"bbox":[1,2,3,4],"text":"b{k}","width":1000,"height":1500}}'))
    content = F.concat(F.lit("["), F.concat_ws(",", *[block(k) for k in range(3)]), F.lit("]"))
    return bundles.ocr_tables(env.table("documents").select("doc_id", content.alias("content"))).select("doc_id", "seq", "text")


@query("SELECT 'customer' AS name, count(*) AS rows FROM customer UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'part', count(*) FROM part")
def snk3_manifest_counts(env):
    return facets.manifest({n: env.table(n) for n in ("customer", "orders", "part")})


@query("SELECT id, kind, CAST(row_number() OVER (PARTITION BY paper_id ORDER BY kind ASC NULLS LAST, number, id) AS INTEGER) AS place, stem FROM pub WHERE status = 'published'")
def snk5_export_rows(env):
    by = Window.partitionBy("paper_id").orderBy(F.asc_nulls_last("kind"), "number", "id")
    return env("pub").where("status = 'published'").select("id", "kind", F.row_number().over(by).alias("place"), "stem")


@query("SELECT id, lower(regexp_replace(concat_ws(' ', stem, coalesce(answer, ''), paper_id, kind), '[\\s$^_{}]', '', 'g')) AS key FROM pub")
def snk8_rebuilt_index(env):
    whole = F.concat_ws(" ", "stem", F.coalesce("answer", F.lit("")), "paper_id", "kind")
    return env("pub").select("id", text.text_column(text.search_key, whole).alias("key"))


@query("SELECT * FROM (VALUES ('kind'), ('review_source'), ('tags')) v(facet)")
def flt13_active_facets(env):
    spec = FilterSpec(kind="en", review_source="human", tag_any=("n1",), needs_review=True, q="x")
    return env.rows([(f,) for f in spec.facets()], "facet string")


@query("SELECT id, number, kind, paper_id FROM pub")
def prj4_content_struct(env):
    return cards.content(env("pub")).select("id", "content.number", "content.kind", "content.origin.paper_id")


@query("SELECT id, search_text FROM pub WHERE status = 'published' ORDER BY published_at DESC, id DESC LIMIT 40")
def sort3_late_rows(env):
    ids = ordering.page(env("pub").where("status = 'published'").select("id", "published_at", "number", "paper_id", "kind")).select("id")
    return env("pub").join(F.broadcast(ids), "id").select("id", "search_text")  # a page of ids at most


@query("SELECT CAST(position AS INTEGER) AS position, CAST(id AS BIGINT) AS id FROM (VALUES (0, 30), (1, 4), (2, 17)) v(position, id)")
def sort5_requested_order(env):
    wanted = env.rows([(0, 30), (1, 4), (2, 17)], "position int, id long")
    return ordering.resolve(wanted, env("pub")).select("position", "id")


@query("""SELECT kind AS class, id, CAST(row_number() OVER (PARTITION BY kind ORDER BY id DESC) AS INTEGER) AS rank, count(*) OVER (PARTITION BY kind) > 20 AS truncated FROM pub QUALIFY rank <= 20""")
def sort10_top_per_class(env):
    by = Window.partitionBy("kind")
    ranked = env("pub").select(F.col("kind").alias("class"), "id", F.row_number().over(by.orderBy(F.desc("id"))).alias("rank"), (F.count("*").over(by) > 20).alias("truncated"))
    return ranked.where("rank <= 20")


@query("SELECT doc_id, concat(lang, '(sum)A.', lang, 'C.3') AS text FROM documents")
def scl4_reading_text(env):
    build = lambda s: text.reading_text({"stem": s + "(sum)", "options": {"C": "3", "A": s, "B": " "}})
    return env.table("documents").select("doc_id", text.text_column(build, F.col("lang")).alias("text"))


@query("""WITH m AS (SELECT doc_id, pos, line, starts_with(trim(line), '#') AS h FROM line), a AS (SELECT doc_id, min(pos) AS anchor FROM m WHERE NOT h GROUP BY 1)
SELECT m.doc_id, list_sort(list(pos)) AS headings FROM m JOIN a USING (doc_id) WHERE h AND pos > anchor GROUP BY 1""")
def scl17_headings_after_anchor(env):
    marked = env("line").withColumn("h", F.trim("line").startswith("#"))
    anchor = F.min(F.when(~F.col("h"), F.col("pos"))).over(Window.partitionBy("doc_id"))
    return marked.withColumn("_a", anchor).where("h and pos > _a").groupBy("doc_id").agg(F.array_sort(F.collect_list("pos")).alias("headings"))


@query("SELECT doc_id, CASE WHEN length(s) > 60 THEN concat(substr(s, 1, 60), '…') ELSE s END AS first_line FROM (SELECT doc_id, trim(regexp_replace(split_part(text, chr(10), 1), '[ \\t\\r\\f\\v]+', ' ', 'g')) AS s FROM documents)")
def scl27_first_line(env):
    d = env.table("documents").select("doc_id", F.substring_index("text", "\n", 1).alias("line"))
    return d.select("doc_id", ordering.snippet("line", 60).alias("first_line"))


@query("SELECT doc_id, lang AS text, CAST(CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 1 END AS INTEGER) AS colspan, doc_id % 3 = 0 AS header FROM documents")
def tbl2_html_rows(env):
    tag = F.when(F.col("doc_id") % 3 == 0, "th").otherwise("td")
    table = F.concat(F.lit("<table><tr><"), tag, F.when(F.col("doc_id") % 2 == 0, ' colspan="2"').otherwise(""), F.lit("> <b>"), F.col("lang"), F.lit("</b> </"), tag, F.lit("></tr></table>"))
    kind = pa.list_(pa.list_(pa.struct([("text", pa.string()), ("rowspan", pa.int32()), ("colspan", pa.int32()), ("header", pa.bool_())])))
    rows = text._column(markup.html_rows, "array<array<struct<text:string,rowspan:int,colspan:int,header:boolean>>>", kind, table)
    return env.table("documents").select("doc_id", rows.alias("r")).select("doc_id", F.col("r")[0][0]["text"].alias("text"), F.col("r")[0][0]["colspan"].alias("colspan"), F.col("r")[0][0]["header"].alias("header"))


@query("SELECT l_partkey AS frame, CASE WHEN count(DISTINCT CASE WHEN l_returnflag = 'A' THEN l_orderkey END) = 1 THEN max(CASE WHEN l_returnflag = 'A' THEN l_orderkey END) END AS winner FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_orderkey) > 1")
def cls7_contest_winner(env):
    claims = env.table("lineitem").select(F.col("l_partkey").alias("frame"), F.col("l_orderkey").alias("record"), (F.col("l_returnflag") == "A").alias("cue"))
    return facets.claim_ledger(claims).select("frame", "winner")


@query("""WITH c AS (SELECT l_partkey AS frame, list_sort(list(DISTINCT l_orderkey)) AS claimants, count(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_orderkey END) AS cued FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_orderkey) > 1) SELECT frame, unnest(claimants) AS record FROM c WHERE cued <> 1""")
def fig4_conflict_audit(env):
    claims = env.table("lineitem").select(F.col("l_partkey").alias("frame"), F.col("l_orderkey").alias("record"), (F.col("l_returnflag") == "R").alias("cue"))
    return facets.claim_ledger(claims).where("winner is null").select("frame", F.explode("claimants").alias("record"))


@query("SELECT l_orderkey AS paper_id, q.number, count(*) AS visuals FROM lineitem JOIN (SELECT DISTINCT l_orderkey AS paper_id, l_linenumber AS number FROM lineitem) q ON q.paper_id = l_orderkey AND q.number = l_suppkey % 7 GROUP BY 1, 2")
def fig5_visual_owners(env):
    t = env.table("lineitem")
    figs = t.select(F.col("l_orderkey").alias("paper_id"), F.col("l_linenumber").alias("seq"), F.concat(F.lit("Graph for no. "), F.col("l_suppkey") % 7).alias("caption"))
    qs = t.select(F.col("l_orderkey").alias("paper_id"), F.col("l_linenumber").alias("number"), F.lit(0).alias("question_id")).distinct()
    return figures.caption_owners(figs, qs).groupBy("paper_id", "number").agg(F.count("*").alias("visuals"))


@query("""WITH t AS (SELECT DISTINCT paper_id, seq AS number FROM question WHERE paper_id % 7 <> 0), p AS (SELECT paper_id, seq + CASE WHEN part % 5 = 0 THEN 1 ELSE 0 END AS number FROM question WHERE paper_id % 9 <> 0),
a AS (SELECT paper_id, count(*) AS n FROM t GROUP BY 1), b AS (SELECT paper_id, count(*) AS n FROM p GROUP BY 1), m AS (SELECT paper_id, count(*) AS n FROM (SELECT DISTINCT * FROM p) JOIN t USING (paper_id, number) GROUP BY 1)
SELECT paper_id AS doc_id, coalesce(m.n, 0) AS matched, coalesce(a.n, 0) - coalesce(m.n, 0) AS missed, coalesce(b.n, 0) - coalesce(m.n, 0) AS extra, CASE WHEN b.n > 0 THEN coalesce(m.n, 0) / b.n END AS precision, CASE WHEN a.n > 0 THEN coalesce(m.n, 0) / a.n END AS recall FROM a FULL JOIN b USING (paper_id) LEFT JOIN m USING (paper_id)""")
def agg14_ratios(env):
    # Papers without annotations, papers without results, and numbers read one too high.
    q = env("question").select(F.col("paper_id").alias("doc_id"), F.lit(1).alias("group_no"), F.lit("x").alias("kind"), F.col("seq").alias("number"), "part")
    truth = q.where("doc_id % 7 <> 0").drop("part").distinct()
    result = q.where("doc_id % 9 <> 0").withColumns({"position": F.col("number"), "number": F.col("number") + F.when(F.col("part") % 5 == 0, 1).otherwise(0)})
    return evaluation.identity(truth, result).select("doc_id", "matched", "missed", "extra", "precision", "recall")


@query("SELECT id, md5(concat(kind, '|', trim(stem))) AS exact FROM pub WHERE kind IS NOT NULL AND stem <> '' AND coalesce(body_mode, '') <> 'image'")
def hsh3_source_fingerprints(env):
    return related.fingerprints(env("pub")).select("id", F.md5(F.concat_ws("|", "kind", F.trim("stem"))).alias("exact"))


@query(None)
def str6_throttle(env):
    e = env.table("events")
    outcome = F.when(F.col("event_id") % 7 == 0, "throttled").otherwise("ok")
    return jobs.throttled(e.select(F.col("user_id").alias("pool"), F.col("event_id").alias("step"), outcome.alias("outcome")), 4)


REQUESTS = """SELECT user_id % 4 AS service, user_id AS account, event_id AS request, done_ms - event_id * 7919 % 900 * 1000 AS sent_ms, done_ms, CASE WHEN event_type = 'signup' AND event_id % 97 = 0 THEN 'off' WHEN event_type <> 'error' THEN 'ok' WHEN event_id % 3 = 0 THEN 'exhausted' ELSE 'throttled' END AS outcome,
 CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN CAST(floor(value) AS BIGINT) * 1000 END AS delay_ms FROM (SELECT *, {ms} AS done_ms FROM {events}) e"""


def _requests(env):
    return env.spark.sql(REQUESTS.format(ms="unix_millis(CAST(ts AS TIMESTAMP))", events="{events}"), events=env.table("events"))


@query(None)
def str6_account_levels(env):
    return pool.account_levels(_requests(env))


# Events of the tables are minutes to hours apart, so services rest for three hours.
@query(f"""WITH r AS ({REQUESTS.format(ms="epoch_us(ts) // 1000", events="events")}),
u AS (SELECT service, done_ms AS t, CASE WHEN outcome = 'ok' THEN 1 ELSE 0 END AS turn, {{'t': done_ms, 'good': outcome = 'ok'}} AS signal, NULL AS account, NULL AS request FROM r WHERE outcome IN ('ok', 'exhausted') UNION ALL SELECT service, sent_ms, 2, NULL, account, request FROM r),
w AS (SELECT *, last_value(signal IGNORE NULLS) OVER (PARTITION BY service ORDER BY t, turn ROWS UNBOUNDED PRECEDING) AS b FROM u)
SELECT service, account, request, t AS sent_ms, coalesce(NOT b.good AND t < b.t + 10800000, false) AS resting FROM w WHERE turn = 2""")
def str6_service_rests(env):
    return pool.service_rests(_requests(env), 10_800_000)


@query("SELECT DISTINCT tag_id FROM tag WHERE tag_id IN ('n4') OR tag_id IN (SELECT child FROM edge WHERE parent = 'n4' AND relation = 'contains')")
def grf6_impact_tags(env):
    return taxonomy.descendants(env("edge"), ("n4",)).select(F.col("tag").alias("tag_id")).distinct()
