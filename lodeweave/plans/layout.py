"""Queries over boxes, numbers and ordered blocks, and scores of segmentations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation, figures, segmentation, sequences, spatial
from ..sources import tables as sources
from .registry import query

FIG, REG = "f AS (SELECT * FROM box WHERE role = 'figure')", "r AS (SELECT * FROM box WHERE role = 'region')"
SHARED = "greatest(0, least(f.x1, r.x1) - greatest(f.x0, r.x0)) * greatest(0, least(f.y1, r.y1) - greatest(f.y0, r.y0))"
AREA = "({0}.x1 - {0}.x0) * ({0}.y1 - {0}.y0)"
PAIR = "f JOIN r ON f.paper_id = r.paper_id AND f.page = r.page"


def _sides(env):
    box = env("box")
    return box.where("role = 'figure'").drop("role"), box.where("role = 'region'").drop("role")


@query(f"WITH {FIG}, {REG} SELECT f.paper_id, f.page, f.seq AS l_seq, r.seq AS r_seq FROM {PAIR} WHERE {SHARED} > 0 AND {SHARED} >= 0.2 * {AREA.format('f')}")
def jn6_overlap(env):
    return spatial.overlaps(*_sides(env)).select("paper_id", "page", "l_seq", "r_seq")


@query(f"WITH {FIG}, {REG} SELECT f.paper_id, f.page, f.seq, count(*) AS regions, bool_or((f.y0 + f.y1) / 2 >= r.y0) AS inside FROM {PAIR} WHERE {SHARED} > 0 AND {SHARED} >= 0.2 * {AREA.format('f')} GROUP BY 1, 2, 3")
def jn7_directional(env):
    return spatial.figures_in_regions(*_sides(env))


@query(f"WITH {FIG}, {REG} SELECT f.paper_id, f.page, f.seq AS l_seq, r.seq AS r_seq FROM {PAIR} WHERE (f.x0 + f.x1) / 2 BETWEEN r.x0 AND r.x1 AND (f.y0 + f.y1) / 2 BETWEEN r.y0 AND r.y1")
def jn8_center_in_box(env):
    return spatial.centers_in(*_sides(env)).select("paper_id", "page", "l_seq", "r_seq")


@query(f"WITH {FIG}, {REG} SELECT f.paper_id, f.page, f.seq AS l_seq, r.seq AS r_seq FROM {PAIR} WHERE {SHARED} > 0 AND {SHARED} >= 0.6 * least({AREA.format('f')}, {AREA.format('r')})")
def jn9_overlap_smaller(env):
    return spatial.overlaps_smaller(*_sides(env)).select("paper_id", "page", "l_seq", "r_seq")


@query(f"WITH {FIG}, {REG} SELECT r.paper_id, r.page, r.seq, list_sort(list(DISTINCT f.seq)) AS blocks FROM {PAIR} WHERE (f.x0 + f.x1) / 2 BETWEEN r.x0 AND r.x1 AND (f.y0 + f.y1) / 2 BETWEEN r.y0 AND r.y1 GROUP BY 1, 2, 3")
def jn10_blocks_inside(env):
    return spatial.centers_in(*_sides(env)).groupBy("paper_id", "page", F.col("r_seq").alias("seq")).agg(F.array_sort(F.collect_set("l_seq")).alias("blocks"))


@query(f"""WITH {FIG}, {REG}, g AS (SELECT f.paper_id, f.page, f.seq, r.seq AS target, power(greatest(0, f.x0 - r.x1, r.x0 - f.x1), 2) + power(greatest(0, f.y0 - r.y1, r.y0 - f.y1), 2) AS gap FROM {PAIR})
SELECT *, CAST(row_number() OVER (PARTITION BY paper_id, page, seq ORDER BY gap, target) AS INTEGER) AS rank FROM g QUALIFY rank <= 3""")
def jn11_nearest(env):
    return spatial.nearest(*_sides(env))


@query("""SELECT doc_id, pos, last_value(CASE WHEN starts_with(trim(line), '#') THEN trim(regexp_replace(trim(line), '^#+', '')) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS heading FROM line""")
def jn12_last_heading(env):
    return sequences.last_heading(env("line")).select("doc_id", "pos", "heading")


@query("""WITH l AS (SELECT l_orderkey AS paper_id, 0 AS page, l_linenumber AS letter, l_partkey % 900 AS x, l_suppkey % 100 * 9 AS y FROM lineitem WHERE l_linenumber < 4),
i AS (SELECT l_orderkey AS paper_id, 0 AS page, l_linenumber AS seq, l_partkey * 3 % 900 AS x0, l_partkey * 3 % 900 + 50 AS x1, l_suppkey * 7 % 900 AS y0 FROM lineitem),
g AS (SELECT l.paper_id, l.page, letter, seq, abs((x0 + x1) / 2.0 - x) + abs(y0 - y) AS g FROM l JOIN i ON l.paper_id = i.paper_id),
n AS (SELECT *, row_number() OVER w AS r, lead(g) OVER w AS nx FROM g WINDOW w AS (PARTITION BY paper_id, page, letter ORDER BY g, seq))
SELECT paper_id, page, letter, CASE WHEN nx IS NULL OR nx - g >= 12 THEN seq END AS seq FROM n WHERE r = 1""")
def jn13_ambiguous_labels(env):
    q = env.table("lineitem").withColumns({"paper_id": F.col("l_orderkey"), "page": F.lit(0)})
    labels = q.where("l_linenumber < 4").select("paper_id", "page", F.col("l_linenumber").alias("letter"), (F.col("l_partkey") % 900).alias("x"), (F.col("l_suppkey") % 100 * 9).alias("y"))
    x = F.col("l_partkey") * 3 % 900
    images = q.select("paper_id", "page", F.col("l_linenumber").alias("seq"), x.alias("x0"), (x + 50).alias("x1"), (F.col("l_suppkey") * 7 % 900).alias("y0"))
    return figures.ambiguous_labels(labels, images)


@query("""WITH f AS (SELECT o_orderkey AS figure_id, o_custkey % 50 AS paper_id, o_orderkey % 9 + 1 AS lo, o_orderkey % 9 + 1 + o_custkey % 3 AS hi FROM orders), q AS (SELECT DISTINCT l_orderkey % 50 AS paper_id, l_linenumber AS number, l_orderkey % 50 * 100 + l_linenumber AS question_id FROM lineitem)
SELECT figure_id, question_id FROM f JOIN q ON q.paper_id = f.paper_id AND q.number BETWEEN lo AND hi""")
def jn20_shared_captions(env):
    lo = F.col("o_orderkey") % 9 + 1
    figs = env.table("orders").select(F.col("o_orderkey").alias("figure_id"), (F.col("o_custkey") % 50).alias("paper_id"), F.concat(F.lit("Questions "), lo, F.lit(" to "), lo + F.col("o_custkey") % 3).alias("caption"))
    qs = env.table("lineitem").select((F.col("l_orderkey") % 50).alias("paper_id"), F.col("l_linenumber").alias("number"), (F.col("l_orderkey") % 50 * 100 + F.col("l_linenumber")).alias("question_id")).distinct()
    return figures.shared_captions(figs, qs)


@query("""WITH t AS (SELECT doc_id, doc_id % 3 AS group_no, lang AS kind, CASE WHEN doc_id % 10 = 0 THEN NULL ELSE doc_id % 50 END AS number FROM documents), p AS (SELECT doc_id + CASE WHEN doc_id % 8 = 0 THEN 1 ELSE 0 END AS doc_id, doc_id % 3 AS group_no, lang AS kind, CASE WHEN doc_id % 10 = 0 THEN NULL ELSE doc_id % 50 END AS number, doc_id AS position FROM documents WHERE doc_id % 9 <> 4),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, group_no, kind, number ORDER BY position) AS r FROM p),
b AS (SELECT coalesce(t.doc_id, n.doc_id) AS doc_id, t.doc_id IS NOT NULL AS t, n.doc_id IS NOT NULL AS p FROM t FULL JOIN (SELECT * FROM n WHERE r = 1) n ON t.doc_id = n.doc_id AND t.group_no = n.group_no AND t.kind = n.kind AND t.number IS NOT DISTINCT FROM n.number),
s AS (SELECT doc_id, count(*) FILTER (t AND p) AS matched, count(*) FILTER (NOT p) AS missed, count(*) FILTER (NOT t) AS extra FROM b GROUP BY 1), x AS (SELECT doc_id, matched, missed, extra + coalesce((SELECT count(*) FROM n WHERE r > 1 AND n.doc_id = s.doc_id), 0) AS extra FROM s)
SELECT doc_id, matched, missed, extra, CASE WHEN matched + extra <> 0 THEN matched / (matched + extra) END AS precision, CASE WHEN matched + missed <> 0 THEN matched / (matched + missed) END AS recall FROM x""")
def jn16_identity_scores(env):
    number = F.when(F.col("doc_id") % 10 != 0, F.col("doc_id") % 50)
    d = env.table("documents").select("doc_id", (F.col("doc_id") % 3).alias("group_no"), F.col("lang").alias("kind"), number.alias("number"))
    result = d.where("doc_id % 9 <> 4").withColumn("position", F.col("doc_id")).withColumn("doc_id", F.col("doc_id") + F.when(F.col("doc_id") % 8 == 0, 1).otherwise(0))
    return evaluation.identity(d, result)


@query(f"""WITH {FIG}, xs AS (SELECT DISTINCT paper_id, page, unnest([x0, x1]) AS x FROM f), slabs AS (SELECT *, lead(x) OVER (PARTITION BY paper_id, page ORDER BY x) AS to_x FROM xs),
c AS (SELECT s.paper_id, s.page, s.x, s.to_x, f.y0, f.y1, max(f.y1) OVER (PARTITION BY s.paper_id, s.page, s.x ORDER BY f.y0, f.y1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM slabs s JOIN f USING (paper_id, page) WHERE f.x0 <= s.x AND f.x1 >= s.to_x)
SELECT paper_id, page, sum(greatest(0, y1 - greatest(y0, coalesce(top, y0))) * (to_x - x)) AS area FROM c GROUP BY 1, 2""")
def agg13_union_area(env):
    return spatial.union_area(_sides(env)[0], ["paper_id", "page"])


@query("""WITH d AS (SELECT DISTINCT paper_id, number FROM question), n AS (SELECT *, lead(number) OVER (PARTITION BY paper_id ORDER BY number) AS nx FROM d) SELECT paper_id, CAST(unnest(range(number + 1, nx)) AS INTEGER) AS missing FROM n WHERE nx > number + 1""")
def win6_missing_numbers(env):
    return sequences.missing_numbers(env("question"))


@query("""WITH o AS (SELECT paper_id, max(number) AS top FROM question WHERE seq <= 3 GROUP BY 1) SELECT q.paper_id, q.seq, CAST(coalesce(top, 0) + row_number() OVER (PARTITION BY q.paper_id ORDER BY q.seq) AS INTEGER) AS number FROM question q LEFT JOIN o USING (paper_id) WHERE q.seq > 3""")
def win11_next_numbers(env):
    q = env("question").select("paper_id", "seq", "number")
    return sequences.next_numbers(q.where("seq <= 3"), q.where("seq > 3").drop("number"))


@query("""WITH m AS (SELECT *, CASE WHEN x0 - lag(x0) OVER (PARTITION BY paper_id, page ORDER BY x0, seq) > 120 THEN 1 ELSE 0 END AS n FROM box), c AS (SELECT *, sum(n) OVER (PARTITION BY paper_id, page ORDER BY x0, seq ROWS UNBOUNDED PRECEDING) AS cluster FROM m)
SELECT paper_id, page, CAST(cluster AS BIGINT) AS cluster, count(*) AS boxes, min(x0) AS "left" FROM c GROUP BY 1, 2, 3""")
def win8_margin_clusters(env):
    return spatial.margins(env("box"))


@query("""WITH r AS (SELECT l_orderkey AS page_id, l_linenumber AS y, max(l_quantity) > 20 AS white FROM lineitem GROUP BY 1, 2), i AS (SELECT *, y - row_number() OVER (PARTITION BY page_id, white ORDER BY y) AS i FROM r),
g AS (SELECT page_id, min(y) AS "from", count(*) AS n FROM i WHERE white GROUP BY page_id, i HAVING count(*) >= 2) SELECT page_id, "from", n FROM g QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY "from") = 1""")
def win9_white_gaps(env):
    rows = env.table("lineitem").groupBy(F.col("l_orderkey").alias("page_id"), F.col("l_linenumber").alias("y")).agg((F.max("l_quantity") > 20).alias("white"))
    return spatial.white_gap(rows, 2)


@query("""WITH r AS (SELECT l_orderkey AS paper_id, l_linenumber AS page, max(l_returnflag) = 'N' AS empty FROM lineitem GROUP BY 1, 2), i AS (SELECT *, page - row_number() OVER (PARTITION BY paper_id, empty ORDER BY page) AS i FROM r) SELECT paper_id, min(page) AS first, max(page) AS last, count(*) AS rows FROM i WHERE empty GROUP BY paper_id, i""")
def win10_continuations(env):
    rows = env.table("lineitem").groupBy(F.col("l_orderkey").alias("paper_id"), F.col("l_linenumber").alias("page")).agg((F.max("l_returnflag") == "N").alias("empty"))
    return sequences.runs_of(rows, "paper_id", "empty", "page").select("paper_id", "first", "last", "rows")


@query("""SELECT source, lang, arg_max(name, (length(name), name)) AS name FROM (SELECT source, lang, substr(text, 1, CAST(doc_id % 9 + 3 AS INT)) AS name FROM documents) GROUP BY 1, 2""")
def win13_longest_name(env):
    headers = env.table("documents").select("source", "lang", F.substring(F.col("text"), F.lit(1), (F.col("doc_id") % 9 + 3).cast("int")).alias("name"))
    return sequences.longest_name(headers, ["source", "lang"])


@query("""SELECT paper_id, page, count(*) FILTER ((x0 + x1) / 2 < 500) AS "left", count(*) FILTER ((x0 + x1) / 2 >= 500) AS "right", count(*) FILTER (x0 < 492 AND x1 > 508) AS crossing,
 CASE WHEN count(*) >= 3 AND "left" >= 1 AND "right" >= 1 AND crossing <= greatest(2, 0.15 * count(*)) THEN 2 ELSE 1 END AS columns FROM box GROUP BY 1, 2""")
def geo4_column_split(env):
    return spatial.column_split(env("box"))


@query("SELECT paper_id, seq, x1 > x0 AND y1 > y0 AND x0 >= 0 AND y0 >= 0 AS valid, greatest(0, least(1000, x1)) AS x1 FROM box")
def geo1_box_validity(env):
    return env("box").select("paper_id", "seq", spatial.valid().alias("valid"), spatial.clamp("x1").alias("x1"))


@query("SELECT paper_id, seq, concat_ws(',', regexp_replace(CAST(CAST(greatest(0, least(1000, round(x0 / 4, 1))) AS DECIMAL(6,1)) AS VARCHAR), '\\.0$', ''), regexp_replace(CAST(CAST(greatest(0, least(1000, round(y0 / 4, 1))) AS DECIMAL(6,1)) AS VARCHAR), '\\.0$', '')) AS key FROM box")
def geo2_candidate_key(env):
    b = env("box").withColumns({"x0": F.col("x0") / 4, "y0": F.col("y0") / 4})
    return b.select("paper_id", "seq", spatial.candidate_key("x0", "y0").alias("key"))


@query(f"WITH {FIG}, {REG} SELECT f.paper_id, f.page, f.seq, bool_or({SHARED} >= 0.81 * {AREA.format('f')}) AS covered, bool_or({SHARED} > 0 AND {SHARED} < 0.81 * {AREA.format('f')}) AS cut FROM {PAIR} WHERE {SHARED} > 0 GROUP BY 1, 2, 3")
def geo3_covered_or_cut(env):
    pair = spatial.pairs(*_sides(env)).where(spatial.shared() > 0)
    most = spatial.shared() >= 0.81 * spatial.area("l_")
    return pair.groupBy("paper_id", "page", F.col("l_seq").alias("seq")).agg(F.bool_or(most).alias("covered"), F.bool_or(~most).alias("cut"))


@query(None)
def win3_numbering_restarts(env):
    pages = env("question").groupBy("paper_id", F.floor((F.col("seq") - 1) / 2).cast("int").alias("page")).agg(F.array_sort(F.collect_list("number")).alias("numbers"))
    return sequences.numbering_restarts(pages)


@query(None)
def win5_best_chain(env):
    found = env("question").select("paper_id", "seq", "number", (1.0 + F.col("part") % 3).alias("score"))
    return sequences.chains(found)


@query(None)
def win7_gap_repairs(env):
    # Numbers from eight on; some lost their first digit, some have none.
    q, part = env("question"), F.col("part")
    number = (F.col("seq") + 7).cast("int")
    shown = q.where(part % 5 != 0).select("paper_id", "seq", F.when((part % 5 == 1) & (number > 9), number % 10).otherwise(number).alias("number"), (1.0 + part % 3).alias("score"))
    return sequences.gap_repairs(sequences.chains(shown), shown, q.where(part % 5 == 0))


@query(None)
def seg9_book_scopes(env):
    lines = env("line").select(F.col("doc_id").cast("long").alias("paper_id"), F.col("pos").alias("seq"), F.when(F.trim("line").startswith("#"), F.trim("line")).otherwise(F.concat(F.col("pos") % 4 + 1, F.lit(". "), F.trim("line"))).alias("text"))
    return segmentation.book_scopes(lines)


@query(None)
def fig1_row_distribution(env):
    figs = _sides(env)[0].withColumn("owner", (F.col("seq") / 2).cast("int"))
    qs = env("question").select("paper_id", "number", (F.col("part") % 2 == 0).alias("cue")).distinct()
    return figures.row_distribution(figs, qs)


@query("""SELECT l_orderkey AS paper_id, l_linenumber AS seq, q.question_id FROM lineitem JOIN (SELECT DISTINCT l_orderkey AS paper_id, l_linenumber AS number, l_orderkey * 10 + l_linenumber AS question_id FROM lineitem) q ON q.paper_id = l_orderkey AND q.number = l_partkey % 7 WHERE l_suppkey % 3 = 0""")
def fig2_caption_owners(env):
    q = env.table("lineitem")
    figs = q.select(F.col("l_orderkey").alias("paper_id"), F.col("l_linenumber").alias("seq"), F.when(F.col("l_suppkey") % 3 == 0, F.concat(F.lit("Figure for question "), F.col("l_partkey") % 7)).otherwise("A figure").alias("caption"))
    qs = q.select(F.col("l_orderkey").alias("paper_id"), F.col("l_linenumber").alias("number"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("question_id")).distinct()
    return figures.caption_owners(figs, qs).select("paper_id", "seq", "question_id")


@query(f"""WITH {FIG}, {REG}, h AS (SELECT f.paper_id, f.page, f.seq, bool_or((f.y0 + f.y1) / 2 >= r.y0) AS inside FROM {PAIR} WHERE {SHARED} > 0 AND {SHARED} >= 0.2 * {AREA.format('f')} GROUP BY 1, 2, 3) SELECT paper_id, page, seq FROM h WHERE inside AND (paper_id + seq) % 3 <> 0""")
def mut14_lost_candidates(env):
    figs, regs = _sides(env)
    owned = figs.where("(paper_id + seq) % 3 = 0").select("paper_id", "seq")
    return figures.lost_candidates(figs, owned, regs)


@query("""SELECT doc_id, CAST(i + 1 AS INTEGER) AS sequence, CAST(i * 7 + 1 AS INTEGER) AS first_page, CAST(least(i * 7 + 7, n) AS INTEGER) AS last_page FROM (SELECT doc_id, n, unnest(range((n + 6) // 7)) AS i FROM (SELECT doc_id, CAST(n_chars % 40 AS BIGINT) AS n FROM documents))""")
def src11_chunk_plan(env):
    d = env.table("documents").select("doc_id", (F.col("n_chars") % 40).cast("int").alias("total_pages"), F.lit(7).alias("max_pages"))
    return sources.plan_chunks(d).select("doc_id", "sequence", "first_page", "last_page")


@query("""WITH c AS (SELECT l_orderkey AS doc_id, l_linenumber AS sequence, l_linenumber * 4 - 3 + min(l_partkey) % 2 AS first_page, l_linenumber * 4 + min(l_suppkey) % 2 AS last_page FROM lineitem GROUP BY 1, 2), s AS (SELECT *, first_page - coalesce(lag(last_page) OVER (PARTITION BY doc_id ORDER BY sequence), 0) - 1 AS step FROM c)
SELECT doc_id, CAST(sum(greatest(step, 0)) AS BIGINT) AS gap_pages, CAST(sum(greatest(-step, 0)) AS BIGINT) AS overlap_pages, 28 - max(last_page) AS missing_at_end, sum(greatest(step, 0)) = 0 AND sum(greatest(-step, 0)) = 0 AND 28 - max(last_page) = 0 AS complete FROM s GROUP BY 1""")
def src12_chunk_coverage(env):
    n = F.col("l_linenumber")
    chunks = env.table("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"), F.min("l_suppkey").alias("l_suppkey")).select(F.col("l_orderkey").alias("doc_id"), n.alias("sequence"), (n * 4 - 3 + F.col("l_partkey") % 2).alias("first_page"), (n * 4 + F.col("l_suppkey") % 2).alias("last_page"), F.lit(28).alias("total_pages"))
    return sources.chunk_coverage(chunks, "doc_id")


@query("SELECT doc_id, CASE WHEN lang = 'en' THEN 1048576 ELSE 40 END AS most FROM documents")
def src13_chunk_limit(env):
    d = env.table("documents").withColumns({"kind": F.when(F.col("lang") == "en", "photos").otherwise("pdf"), "max": F.lit(40)})
    return d.select("doc_id", sources.chunk_limit("kind", "max").alias("most"))


@query("""SELECT doc_id, CAST((pos // 4) * 3 + pos % 4 + 1 AS INTEGER) AS page, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos // 4, pos) - 1 AS INTEGER) AS seq, line AS text FROM line""")
def src14_merged_chunks(env):
    lines = env("line")
    part = F.floor(F.col("pos") / 4).cast("int")
    blocks = lines.select("doc_id", part.alias("sequence"), F.col("pos").alias("seq"), (F.col("pos") % 4 + 1).alias("page"), F.col("line").alias("text"))
    chunks = lines.select("doc_id", part.alias("sequence")).distinct().withColumn("first_page", F.col("sequence") * 3 + 1)
    return sources.merge_chunks(chunks, blocks, "doc_id").select("doc_id", "page", "seq", "text")


@query("""WITH h AS (SELECT doc_id, pos, trim(line) AS name, CASE WHEN starts_with(trim(line), '#') THEN trim(regexp_replace(trim(line), '^#+', '')) END AS h FROM line), l AS (SELECT *, last_value(h IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS heading FROM h)
SELECT doc_id, heading, name, min(pos) AS pos FROM l WHERE h IS NULL AND name <> '' AND heading IS NOT NULL GROUP BY 1, 2, 3""")
def src15_catalogue(env):
    return sources.parse_catalogue(env("line"))


@query("""WITH l AS (SELECT doc_id, pos, CAST(least(8, (length(line) - length(ltrim(line))) // 2) AS INTEGER) AS level, trim(line) AS title FROM line WHERE trim(line) <> '')
SELECT doc_id, pos, level, title, coalesce((SELECT max(b.pos) FROM l b WHERE b.doc_id = l.doc_id AND b.pos < l.pos AND b.level < l.level), -1) AS parent FROM l""")
def src16_outline(env):
    return sources.outline(env("line"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 6 <> 0")
def src1_active_rows(env):
    o = env.table("orders").withColumn("deleted_at", F.when(F.col("o_orderkey") % 6 == 0, F.col("o_orderdate")))
    return sources.active(o).select("o_orderkey")


@query("SELECT o_orderkey, o_orderkey % 6 = 0 AS deleted FROM orders")
def src2_all_rows(env):
    return env.table("orders").select("o_orderkey", (F.col("o_orderkey") % 6 == 0).alias("deleted"))
