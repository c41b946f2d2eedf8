"""Queries over cards under review, archives, edits and layouts."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions import places, text
from ..operators import cards, versioning
from ..operators.filters import FilterSpec, library_rows
from ..operators.spots import spot_boxes
from ..sources import bundles
from .registry import query


@query("SELECT doc_id, CAST(k AS INTEGER) AS seq, CASE WHEN (doc_id + k) % 3 = 0 THEN 'table' ELSE 'text' END AS type, CAST(k AS INTEGER) AS page, [100.0, round(k * 1000 / 1500, 1), 500.0, round((k + 30) * 1000 / 1500, 1)] AS bbox, concat('b', CAST(k AS VARCHAR)) AS text FROM (SELECT doc_id, unnest(range(3)) AS k FROM documents WHERE doc_id % 10 <> 9)")
def src5_ocr_blocks(env):
    block = lambda k: F.concat(F.lit('{"type":"'), F.when((F.col("doc_id") + k) % 3 == 0, "table").otherwise("text"), F.lit(f'","page":{k},"bbox":[100,{k},500,{k + 30}],"text":"b{k}","width":1000,"height":1500}}'))
    content = F.when(F.col("doc_id") % 10 == 9, "not json").otherwise(F.concat(F.lit("["), F.concat_ws(",", *[block(k) for k in range(3)]), F.lit("]")))
    return bundles.ocr_blocks(env.table("documents").select("doc_id", content.alias("content")))


@query("SELECT id, to_json({'number': number, 'kind': kind, 'stem': stem, 'answer': coalesce(answer, ''), 'origin': {'paper_id': paper_id}}) AS content FROM pub WHERE regexp_full_match(stem, '[ -~]*') AND NOT contains(stem, '/')")
def snk6_json_content(env):
    rows = env("pub").where(F.col("stem").rlike(r"^[ -~]*\z") & ~F.col("stem").contains("/"))
    return cards.content(rows).select("id", F.to_json("content").alias("content"))


@query("SELECT id FROM pub WHERE status = 'published' AND kind = 'es' AND body_mode = 'image'")
def prj6_saved_filter(env):
    saved = json.dumps({"kind": "es", "body_mode": "image"})
    return library_rows(env("pub"), FilterSpec(**json.loads(saved))).select("id")




@query("""SELECT id, unnest(list_filter([CASE WHEN id % 4 = 0 THEN 'no_region' END, CASE WHEN id % 4 = 2 THEN 'outside' END, CASE WHEN id % 9 = 0 THEN 'no_number' END, CASE WHEN id % 5 = 0 THEN 'no_slot' END, CASE WHEN id % 7 = 0 THEN 'no_subitems' END, CASE WHEN id % 3 > 0 THEN 'no_caption' END], lambda x: x IS NOT NULL)) AS flag FROM pub""")
def cls8_flag_rules(env):
    k = F.col("id")
    box = lambda y: F.struct(F.lit(0.0).alias("x0"), F.lit(y).alias("y1"))
    regions = F.when(k % 4 == 0, F.array().cast("array<struct<x0:double,y1:double>>")).when(k % 4 == 2, F.array(box(1200.0))).otherwise(F.array(box(900.0)))
    stem = F.when(k % 7 == 0, "x (1) y").otherwise("x")
    rows = env("pub").select("id", regions.alias("regions"), F.when(k % 9 != 0, k).alias("number"), F.when(k % 5 == 0, "blank").otherwise("free").alias("kind"), stem.alias("stem"), (k % 3).alias("figures"))
    return cards.flag_rules(rows)


@query("""SELECT id, state, coalesce(a = h, false) AS approval_current, v IN ('blocked_missing', 'conflict') AS blocked, coalesce(a = h, false) AND v NOT IN ('blocked_missing', 'conflict') AND state IN ('green', 'yellow') AS settled FROM
(SELECT id, CASE id % 3 WHEN 0 THEN 'red' WHEN 1 THEN 'green' ELSE 'yellow' END AS state, kind AS h, CASE WHEN id % 4 = 0 THEN NULL WHEN id % 4 = 1 THEN 'x' ELSE kind END AS a, CASE WHEN id % 5 = 0 THEN 'conflict' ELSE 'ok' END AS v FROM pub)""")
def cls9_verdicts(env):
    k = F.col("id")
    rows = env("pub").select("id", F.when(k % 3 == 0, "red").when(k % 3 == 1, "green").otherwise("yellow").alias("state"), F.col("kind").alias("hash"), F.when(k % 4 == 0, F.lit(None)).when(k % 4 == 1, "x").otherwise(F.col("kind")).alias("approved_hash"), F.when(k % 5 == 0, "conflict").otherwise("ok").alias("figure_verdict"))
    return cards.verdicts(rows)


@query("SELECT id, CASE WHEN status = 'published' THEN 'published' WHEN review_source = 'human' THEN 'approved' WHEN id IN (SELECT user_id FROM events WHERE event_type = 'click') THEN 'edited' END AS reason FROM pub")
def cls11_cut_protection(env):
    rows = env("pub").select("id", (F.col("status") == "published").alias("published"), F.coalesce(F.col("review_source") == "human", F.lit(False)).alias("approved"))
    ops = env.table("events").select(F.col("user_id").alias("id"), F.when(F.col("event_type") == "click", "human").otherwise("auto").alias("actor"))
    return cards.cut_protection(rows, ops)


@query("""WITH c AS (SELECT DISTINCT l_orderkey AS paper_id, l_linenumber AS seq, (l_linenumber - 1) % 3 + 1 AS number FROM lineitem), q AS (SELECT paper_id, seq, number, (paper_id + seq) % 5 = 0 AS question FROM c),
r AS (SELECT *, sum(CASE WHEN number = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY paper_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS run FROM q)
SELECT paper_id, seq, number, question FROM r WHERE NOT (run < (SELECT max(run) FROM r x WHERE x.paper_id = r.paper_id) AND NOT (SELECT bool_or(question) FROM r y WHERE y.paper_id = r.paper_id AND y.run = r.run))""")
def seg2_drop_instructions(env):
    c = env("question").select("paper_id", "seq", ((F.col("seq") - 1) % 3 + 1).alias("number")).distinct()
    return cards.moved_instructions(c.withColumn("question", (F.col("paper_id") + F.col("seq")) % 5 == 0))


@query("SELECT paper_id, min(seq) AS seq, 1 AS number FROM (SELECT DISTINCT l_orderkey AS paper_id, l_linenumber AS seq FROM lineitem WHERE l_linenumber < 3 AND (l_orderkey + l_linenumber) % 2 = 0) b WHERE paper_id IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber >= 3 GROUP BY 1) GROUP BY 1")
def seg5_leading_repair(env):
    q = env("question").select("paper_id", "seq").distinct()
    starts = q.where("seq >= 3").withColumn("number", F.lit(2))
    blocks = q.withColumn("text", F.when((F.col("paper_id") + F.col("seq")) % 2 == 0, "What is it").otherwise("so"))
    return cards.leading_repair(starts, blocks)


@query("SELECT l_orderkey AS paper_id, l_linenumber % 2 AS scope, min(l_partkey % 9) AS first_page, max(l_partkey % 9) AS last_page, count(*) OVER (PARTITION BY l_orderkey) > 1 AS confirm FROM lineitem GROUP BY 1, 2")
def seg10_group_suggestions(env):
    scopes = env("question").select("paper_id", (F.col("seq") % 2).alias("scope"), (F.col("part") % 9).alias("page"))
    return cards.group_suggestions(scopes)


@query("""WITH f AS (SELECT l_orderkey AS paper_id, l_linenumber AS seq, l_partkey % 800 AS y0, l_partkey % 800 + 50 AS y1 FROM lineitem WHERE l_suppkey % 2 = 0), q AS (SELECT l_orderkey AS paper_id, l_linenumber AS number, l_suppkey % 90 * 9 AS q_y0, l_suppkey % 90 * 9 + 100 AS q_y1 FROM lineitem)
SELECT f.paper_id, f.seq, min(number) AS number FROM f JOIN q ON f.paper_id = q.paper_id WHERE abs(q_y1 - y0) <= 60 OR abs(q_y0 - y1) <= 60 GROUP BY 1, 2 HAVING count(DISTINCT number) = 1""")
def fig3_stranded_figures(env):
    t = env.table("lineitem").withColumns({"paper_id": F.col("l_orderkey"), "page": F.lit(0)})
    figs = t.select("paper_id", "page", F.col("l_linenumber").alias("seq"), F.when(F.col("l_suppkey") % 2 == 1, 1).alias("owner"), (F.col("l_partkey") % 800).alias("y0"), (F.col("l_partkey") % 800 + 50).alias("y1"))
    y = F.col("l_suppkey") % 90 * 9
    return cards.stranded_figures(figs, t.select("paper_id", "page", F.col("l_linenumber").alias("number"), y.alias("q_y0"), (y + 100).alias("q_y1")))


@query("""WITH e AS (SELECT l_orderkey AS paper_id, l_linenumber AS number, min(l_partkey) % 3 AS y0, min(l_suppkey) % 5 = 0 AS protected FROM lineitem WHERE l_linenumber < 5 GROUP BY 1, 2), d AS (SELECT l_orderkey AS paper_id, l_linenumber AS number, min(l_partkey) % 2 AS y0 FROM lineitem WHERE l_linenumber > 1 GROUP BY 1, 2)
SELECT paper_id, number, CASE WHEN e.y0 IS NULL THEN 'add' WHEN protected THEN 'protected' WHEN d.y0 IS NULL THEN 'drop' WHEN e.y0 = d.y0 THEN 'keep' ELSE 'move' END AS action FROM e FULL JOIN d USING (paper_id, number)""")
def mut12_resegment_preview(env):
    t = env.table("lineitem").groupBy(F.col("l_orderkey").alias("paper_id"), F.col("l_linenumber").alias("number")).agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"))
    return cards.resegment_preview(t.where("number < 5").selectExpr("paper_id", "number", "p % 3 AS y0", "s % 5 = 0 AS protected"), t.where("number > 1").selectExpr("paper_id", "number", "p % 2 AS y0"))


@query("""SELECT doc_id AS suggestion_id, tag_id, CASE WHEN doc_id % 3 = 0 THEN 'pending' WHEN doc_id % 3 = 1 AND doc_id % 4 = 1 THEN 'rejected' WHEN coalesce(active, false) THEN 'accepted' ELSE 'stale' END AS state FROM (SELECT doc_id, concat('n', doc_id % 27) AS tag_id FROM documents) LEFT JOIN tag USING (tag_id)""")
def mut7_resolve_suggestions(env):
    s = env.table("documents").select(F.col("doc_id").alias("suggestion_id"), F.concat(F.lit("n"), F.col("doc_id") % 27).alias("tag_id"))
    k = F.col("suggestion_id")
    decisions = s.where(k % 3 != 0).select("suggestion_id", F.when((k % 3 == 1) & (k % 4 == 1), "reject").otherwise("accept").alias("decision"))
    return cards.resolve_suggestions(s, decisions, env("tag"))


@query("SELECT user_id AS draft_id, CAST(1 AS BIGINT) AS revision, arg_min(event_type, event_id) AS body FROM events GROUP BY 1")
def mut13_drafts(env):
    saves = env.table("events").select("event_id", F.col("user_id").alias("draft_id"), F.lit(0).cast("long").alias("expected"), F.col("event_type").alias("body"))
    return versioning.drafts_after(saves)


@query("""SELECT doc_id AS id, CASE WHEN doc_id % 5 = 4 THEN NULL ELSE 0 END AS pos, CASE WHEN doc_id % 5 = 4 THEN NULL WHEN doc_id % 5 = 1 THEN 'odd' ELSE 'method' END AS kind, CASE doc_id % 5 WHEN 4 THEN NULL WHEN 2 THEN ' ' ELSE lang END AS name,
 CASE doc_id % 5 WHEN 4 THEN 'malformed' WHEN 1 THEN 'kind' WHEN 2 THEN 'name' WHEN 3 THEN 'levels' END AS error FROM documents""")
def val1_checked_output(env):
    k = F.col("doc_id") % 5
    entry = F.to_json(F.array(F.struct(F.when(k == 1, "odd").otherwise("method").alias("kind"), F.when(k == 2, " ").otherwise(F.col("lang")).alias("name"), F.when(k == 3, F.array(*[F.lit(x) for x in "abcd"])).otherwise(F.array(F.lit("a"))).alias("levels"))))
    raw = env.table("documents").select(F.col("doc_id").alias("id"), F.when(k == 4, "{oops").otherwise(entry).alias("output"))
    return cards.checked_output(raw, ("method", "area"))


@query("""SELECT name, kind, parent, action FROM (VALUES ('NATION_3', 'land', 'region_1', 'keep'), ('new land', 'land', 'region_2', 'add'), ('lost', 'land', 'nowhere', 'no_parent'), ('child', 'firm', 'new land', 'add'), ('top', 'area', NULL, 'add')) v(name, kind, parent, action)""")
def grf10_blueprint_import(env):
    rows = [("NATION_3", "land", "region_1"), ("new land", "land", "region_2"), ("lost", "land", "nowhere"), ("child", "firm", "new land"), ("top", "area", None)]
    names = {r[0] for r in env.table("region").select(F.lower("r_name")).collect()}  # five rows
    rows = [(n, k, p.replace("region_1", sorted(names)[1]).replace("region_2", sorted(names)[2]) if p else p) for n, k, p in rows]
    back = {sorted(names)[1]: "region_1", sorted(names)[2]: "region_2"}
    out = cards.blueprint_import(env("tag"), env.rows(rows, "name string, kind string, parent string"))
    for a, b in back.items():
        out = out.withColumn("parent", F.when(F.col("parent") == a, b).otherwise(F.col("parent")))
    return out


# Strips of every kind: dark and pale print, dark photographs, shadows, even gray.
GRAY = """CASE (l_orderkey % 40) % 6 WHEN 0 THEN CASE WHEN l_partkey % 5 = 0 THEN 60 + l_suppkey % 5 ELSE 235 + l_partkey % 4 END WHEN 1 THEN CASE WHEN l_partkey % 6 = 0 THEN 190 + l_suppkey % 4 ELSE 238 + l_partkey % 3 END WHEN 2 THEN CASE WHEN l_partkey % 7 = 0 THEN 60 + l_suppkey % 4 ELSE 140 + l_partkey % 5 END
 WHEN 3 THEN CASE WHEN l_partkey % 2 = 0 THEN 90 + l_suppkey % 30 ELSE 200 + l_partkey % 30 END WHEN 4 THEN 200 + l_partkey % 3 ELSE 255 END"""


@query(f"""WITH p AS (SELECT l_orderkey % 40 AS page_id, l_linenumber AS y, CAST({GRAY} AS DOUBLE) AS value FROM lineitem), h AS (SELECT page_id, value, CAST(count(*) AS DOUBLE) AS n FROM p GROUP BY 1, 2),
s AS (SELECT *, sum(n) OVER w AS dn, sum(value * n) OVER w AS ds, sum(value * value * n) OVER w AS dq, sum(n) OVER a AS an, sum(value * n) OVER a AS sa, sum(value * value * n) OVER a AS aq FROM h WINDOW w AS (PARTITION BY page_id ORDER BY value ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY page_id)),
m AS (SELECT *, ds / dn AS dm, (sa - ds) / (an - dn) AS lm FROM s WHERE an > dn), t AS (SELECT *, dn * (an - dn) * (lm - dm) * (lm - dm) AS apart, sqrt(greatest(0, dq / dn - dm * dm)) AS dsd, sqrt(greatest(0, (aq - dq) / (an - dn) - lm * lm)) AS lsd FROM m),
b AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY apart DESC, value) = 1), paper AS (SELECT h.page_id, h.value FROM h JOIN b USING (page_id) WHERE h.value > b.value QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY h.n DESC, h.value) = 1),
l AS (SELECT b.page_id, CASE WHEN dn / an BETWEEN 0.005 AND 0.45 AND lsd <= 8 AND lm - dm >= greatest(24, 4 * (dsd + lsd)) AND NOT (lm > 176 AND dm < 164) THEN greatest(b.value + 1, paper.value) ELSE 170 END AS level FROM b JOIN paper USING (page_id))
SELECT page_id, y, avg(CASE WHEN value < coalesce(level, 170) THEN 1 ELSE 0 END) AS ink FROM p LEFT JOIN l USING (page_id) GROUP BY 1, 2""")
def geo5_ink_profile(env):
    return cards.ink_profile(env.table("lineitem").select((F.col("l_orderkey") % 40).alias("page_id"), F.col("l_linenumber").alias("y"), F.expr(GRAY).cast("double").alias("value")))


@query("""WITH c AS (SELECT o_orderkey AS cut_id, o_custkey % 300 AS page_id, o_orderkey % 900 AS y FROM orders), g AS (SELECT c_custkey % 300 AS page_id, c_custkey * 7 % 900 AS "from", c_custkey * 7 % 900 + 8 AS "to" FROM customer),
n AS (SELECT c.page_id, cut_id, ("from" + "to") / 2 AS m, abs(("from" + "to") / 2 - y) AS d FROM c JOIN g USING (page_id) WHERE abs(("from" + "to") / 2 - y) <= 15), b AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY page_id, cut_id ORDER BY d, m) = 1)
SELECT c.page_id, c.cut_id, coalesce(b.m, CAST(c.y AS DOUBLE)) AS y FROM c LEFT JOIN b ON b.page_id = c.page_id AND b.cut_id = c.cut_id""")
def geo6_snapped_cuts(env):
    cuts = env.table("orders").select(F.col("o_orderkey").alias("cut_id"), (F.col("o_custkey") % 300).alias("page_id"), (F.col("o_orderkey") % 900).alias("y"))
    at = F.col("c_custkey") * 7 % 900
    gaps = env.table("customer").select((F.col("c_custkey") % 300).alias("page_id"), at.alias("from"), (at + 8).alias("to"))
    return cards.snapped_cuts(cuts, gaps)


@query(None)
def geo8_figure_lines(env):
    figs = env("question").groupBy(F.col("paper_id").alias("draft_id"), "seq").agg((F.min("part") % 60 + 20).cast("double").alias("width"))
    return cards.figure_lines(figs.withColumn("room", F.lit(160.0)))


@query("""SELECT doc_id, CASE WHEN a + b + c <= 60 THEN [a, b, c] ELSE [least(a, l), least(b, l), least(c, l)] END AS widths FROM (SELECT *, CASE WHEN s * 3 > 60 THEN 20.0 WHEN m * 2 > 60 - s THEN (60 - s) / 2 ELSE 60 - s - m END AS l FROM
(SELECT doc_id, a, b, c, list_sort([a, b, c])[1] AS s, list_sort([a, b, c])[2] AS m FROM (SELECT doc_id, CAST(doc_id % 31 AS DOUBLE) AS a, CAST(doc_id % 47 AS DOUBLE) AS b, CAST(doc_id % 53 AS DOUBLE) AS c FROM documents)))""")
def geo9_fair_widths(env):
    w = F.array(*[(F.col("doc_id") % k).cast("double") for k in (31, 47, 53)])
    return env.table("documents").select("doc_id", w.alias("w")).select("doc_id", cards.fair_widths(F.col("w"), 60).alias("widths"))


@query("""SELECT paper_id, sha256(string_agg(concat(page, ',', CAST(CAST(x0 AS DECIMAL(8,1)) AS VARCHAR), ',', CAST(CAST(y0 AS DECIMAL(8,1)) AS VARCHAR), ',', CAST(CAST(x1 AS DECIMAL(8,1)) AS VARCHAR), ',', CAST(CAST(y1 AS DECIMAL(8,1)) AS VARCHAR)), ';' ORDER BY seq, concat(page, ',', CAST(CAST(x0 AS DECIMAL(8,1)) AS VARCHAR), ',', CAST(CAST(y0 AS DECIMAL(8,1)) AS VARCHAR), ',', CAST(CAST(x1 AS DECIMAL(8,1)) AS VARCHAR), ',', CAST(CAST(y1 AS DECIMAL(8,1)) AS VARCHAR)))) AS hash FROM box GROUP BY 1""")
def hsh4_layout_hash(env):
    return cards.layout_hash(env("box"))


@query("SELECT id, sha256(concat('solve', chr(31), coalesce(stem, ''), chr(31), coalesce(answer, ''), chr(31), 'a,', kind)) AS hash FROM pub")
def hsh2_generation_hash(env):
    return cards.generation_hash(env("pub").withColumn("digests", F.array(F.col("kind"), F.lit("a"))), "solve")


@query(r"SELECT doc_id, regexp_replace(concat(text, chr(10), ' Solution: x', chr(10), 'y'), '(?is)\n[ \t\n\x0B\f\r]*(?:solution|answer)[ \t\n\x0B\f\r]*[:.].*$', '') AS stem FROM documents")
def scl20_drop_solution(env):
    return env.table("documents").select("doc_id", cards.drop_solution(F.concat("text", F.lit("\n Solution: x\ny"))).alias("stem"))


@query(r"""SELECT doc_id, n <> '' AND CAST(nullif(n, '') AS INTEGER) <> doc_id % 30 AS mismatch FROM (SELECT doc_id, regexp_extract(concat(CASE doc_id % 5 WHEN 0 THEN '' ELSE CAST((doc_id + CAST(n_chars % 3 = 0 AS INT)) % 30 AS VARCHAR) END, CASE n_chars % 4 WHEN 0 THEN '. ' WHEN 1 THEN ') ' WHEN 2 THEN ' . ' ELSE ' ' END, text), '^[ \t\n\x0B\f\r]*([0-9]{1,3})[ \t\n\x0B\f\r]*[.)]', 1) AS n FROM documents)""")
def scl19_anchor_mismatch(env):
    n, k = F.col("n_chars"), F.col("doc_id")
    number = F.when(k % 5 == 0, "").otherwise(((k + (n % 3 == 0).cast("int")) % 30).cast("string"))
    reading = F.concat(number, F.when(n % 4 == 0, ". ").when(n % 4 == 1, ") ").when(n % 4 == 2, " . ").otherwise(" "), F.col("text"))
    return env.table("documents").select("doc_id", cards.anchor_mismatch((k % 30).cast("int"), reading).alias("mismatch"))


@query("SELECT doc_id, concat(lang, chr(10), chr(10), 'x') AS stem FROM documents")
def scl21_clean_stem(env):
    return env.table("documents").select("doc_id", cards.clean_stem(F.concat(F.lit(" 12. "), "lang", F.lit("\n\n\n\nx "))).alias("stem"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '▱ABCD in □ 3' ELSE '□ + 2' END AS text FROM documents")
def scl11_fix_symbols(env):
    return env.table("documents").select("doc_id", cards.fix_symbols(F.when(F.col("doc_id") % 2 == 0, "□ABCD in □ 3").otherwise("□ + 2")).alias("text"))


@query("SELECT doc_id, CASE WHEN strpos(text, concat(substr(text, 5, 3), substr(text, 8, 2))) > 0 THEN CAST(strpos(text, concat(substr(text, 5, 3), substr(text, 8, 2))) + length(substr(text, 5, 3)) AS INTEGER) ELSE 0 END AS place FROM documents")
def scl10_spot_place(env):
    return env.table("documents").select("doc_id", cards.spot_place(F.col("text"), F.substring("text", 5, 3), F.substring("text", 8, 2)).alias("place"))


def _disputed(env):
    """Each turn of the conversations as a card in TeX and tags, with a reading in which a letter changed, and the spots of the two."""
    c = env.table("conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    marked = F.regexp_replace(F.regexp_replace("text", r"\bth", r"\\theta "), r", ", "，<b>x</b><sup>2</sup>,\n")
    middle = (F.length("text") / 2).cast("int")
    read = F.concat(F.substr("text", F.lit(1), middle), F.lit("Q7"), F.substr("text", middle + 3))
    cards_ = c.withColumn("text", marked).withColumns({"reading": read, "options": F.create_map(F.lit("B"), F.substr("text", F.lit(1), F.lit(40)), F.lit("A"), F.lit(" "))})
    spots = F.posexplode(text.objections_column(F.col("reading"), F.col("text")))
    return cards_, cards_.select("*", spots.alias("nth", "spot"))


@query(None)
def scl10_spot_fields(env):
    found = _disputed(env)[1].withColumn("place", places.place_column(F.col("reading"), F.col("options"), F.col("spot")))
    return found.select("conv_id", "turn", "nth", "place.*", F.substr("reading", F.col("place.start") + 1, F.col("place.end") - F.col("place.start")).alias("shown"))


@query(None)
def scl10_spot_boxes(env):
    cards_, spots = _disputed(env)
    # a block for each sentence, with the lines that it has
    blocks = cards_.select("conv_id", "turn", F.posexplode(F.split("text", r"(?<=\.)\s+")).alias("seq", "text"))
    y = (F.col("seq") * 40 % 900).cast("double")
    boxed = blocks.withColumns({"page": F.floor(F.col("seq") * 40 / 900).cast("int"), "x0": F.lit(80.0), "x1": F.lit(900.0), "y0": y, "y1": y + 36})
    return spot_boxes(spots.select("conv_id", "turn", "nth", "spot.before", "spot.witness", "spot.after"), boxed, ["conv_id", "turn"], ["nth"])


@query("SELECT doc_id, [CAST(doc_id AS INTEGER), 2, 3, 4] AS parts FROM documents")
def arr1_parts_cap(env):
    from ..operators.figures import parts_cap

    return env.table("documents").select("doc_id", parts_cap(F.array(F.col("doc_id").cast("int"), *[F.lit(k) for k in range(2, 8)])).alias("parts"))
