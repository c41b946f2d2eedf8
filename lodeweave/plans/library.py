"""Queries over published records: filters, facets, orders, pages, joins and sets of ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import facets, ordering, related
from ..operators.filters import FilterSpec, library_rows, normalize_ids
from ..operators.taxonomy import descendants
from .registry import query

SPEC = FilterSpec(kind="en", review_source="human", q="the")
BELOW = """
below(root, tag) AS (SELECT DISTINCT tag_id, tag_id FROM tag UNION SELECT b.root, e.child FROM below b JOIN edge e ON e.parent = b.tag AND e.relation = 'contains')"""


def _search(env, spec, **kw):
    return library_rows(env("pub"), spec, env("assignment"), env("edge"), **kw)


@query("SELECT id, paper_id, number FROM pub WHERE status = 'published' AND kind = 'en' AND review_source = 'human' AND contains(search_text, 'the')")
def flt1_library_filter(env):
    return _search(env, SPEC).select("id", "paper_id", "number")


@query("SELECT id FROM pub WHERE false")
def flt2_malformed_id(env):
    return _search(env, FilterSpec(ids=("12", "x7"))).select("id")


@query("SELECT id, kind, review_source FROM pub WHERE status = 'published' AND kind = 'de' AND review_source = 'ai'")
def flt3_enum_equality(env):
    return _search(env, FilterSpec(kind="de", review_source="ai")).select("id", "kind", "review_source")


@query("SELECT id FROM pub WHERE status = 'published' AND coalesce(answer, '') <> ''")
def flt4_answer_present(env):
    return _search(env, FilterSpec(answer="yes")).select("id")


@query("SELECT id FROM pub WHERE status = 'published' AND coalesce(answer, '') = ''")
def flt4_answer_missing(env):
    return _search(env, FilterSpec(answer="no")).select("id")


@query("SELECT id, body_mode FROM pub WHERE status = 'published' AND (body_mode IS NULL OR body_mode = 'text')")
def flt5_text_body(env):
    return _search(env, FilterSpec(body_mode="text")).select("id", "body_mode")


@query(f"""WITH RECURSIVE {BELOW}
SELECT id FROM pub p WHERE status = 'published'
  AND EXISTS (SELECT 1 FROM assignment a JOIN below b ON a.tag_id = b.tag WHERE b.root = 'r1' AND a.publication_id = p.id AND NOT a.needs_review)
  AND EXISTS (SELECT 1 FROM assignment a JOIN below b ON a.tag_id = b.tag WHERE b.root = 'n6' AND a.publication_id = p.id AND NOT a.needs_review)""")
def flt6_tag_all(env):
    return _search(env, FilterSpec(tag_all=("r1", "n6"))).select("id")


@query(f"""WITH RECURSIVE {BELOW}
SELECT id FROM pub p WHERE status = 'published' AND EXISTS (SELECT 1 FROM assignment a JOIN below b ON a.tag_id = b.tag WHERE b.root IN ('n3', 'n8') AND a.publication_id = p.id AND NOT a.needs_review)""")
def flt7_tag_any(env):
    return _search(env, FilterSpec(tag_any=("n3", "n8"))).select("id")


@query(f"""WITH RECURSIVE {BELOW}
SELECT id FROM pub p WHERE status = 'published' AND NOT EXISTS (SELECT 1 FROM assignment a JOIN below b ON a.tag_id = b.tag WHERE b.root = 'r2' AND a.publication_id = p.id AND NOT a.needs_review)""")
def flt7_tag_not(env):
    return _search(env, FilterSpec(tag_not=("r2",))).select("id")


@query("""SELECT p.id, list_sort(list(DISTINCT t.name)) AS tags FROM pub p JOIN assignment a ON a.publication_id = p.id AND NOT a.needs_review JOIN tag t USING (tag_id)
GROUP BY p.id HAVING list_contains(list(DISTINCT t.name), 'nation_7')""")
def flt8_exact_tag_name(env):
    rows = ordering.with_tags(env("pub"), env("assignment"), env("tag"))
    return rows.where(F.contains("tags_text", F.lit("|nation_7|"))).select("id", "tags")


@query("SELECT id FROM pub p WHERE status = 'published' AND NOT EXISTS (SELECT 1 FROM assignment a WHERE a.publication_id = p.id AND NOT a.needs_review)")
def flt9_untagged(env):
    return _search(env, FilterSpec(untagged=True)).select("id")


@query("""SELECT DISTINCT p.id FROM pub p WHERE status = 'published' AND (EXISTS (SELECT 1 FROM assignment a WHERE a.publication_id = p.id AND a.needs_review)
  OR EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = p.id AND l.quality = 0))""")
def flt10_needs_review(env):
    pending = env("assignment").where("needs_review").select(F.col("publication_id").alias("id"))
    flagged = env.table("labels").where("quality = 0").select(F.col("doc_id").alias("id"))
    return env("pub").where("status = 'published'").join(pending.union(flagged), "id", "left_semi").select("id")


@query("SELECT id FROM pub WHERE status = 'published' AND contains(search_text, 'the') AND contains(search_text, 'and') AND contains(search_text, 'on')")
def flt11_terms(env):
    return _search(env, FilterSpec(q="the AND on")).select("id")


@query("SELECT p.id, CAST(r.position AS INTEGER) AS position FROM pub p JOIN (VALUES (7, 0), (3, 1), (901, 2), (12, 3)) r(id, position) USING (id)")
def flt12_id_list(env):
    ids = normalize_ids(["7", "3", "901", "7", "12"])
    wanted = F.broadcast(env.rows([(k, i) for i, k in enumerate(ids)], "id long, position int"))  # at most MOST_IDS rows
    return env("pub").join(wanted, "id").select("id", "position")


@query("SELECT o_orderkey AS paper_id, o_orderpriority AS part FROM orders WHERE contains(lower(o_orderpriority), 'high') AND o_orderkey % 10 = 3")
def flt14_review_search(env):
    from ..operators.filters import review_query

    _, number, words = review_query("no:3 HIGH")
    rows = env.table("orders").where(F.col("o_orderkey") % 10 == number)
    for w in words:
        rows = rows.where(F.contains(F.lower("o_orderpriority"), F.lit(w)))
    return rows.select(F.col("o_orderkey").alias("paper_id"), F.col("o_orderpriority").alias("part"))


@query("""SELECT event_id, CASE WHEN v IS NULL THEN false ELSE v NOT IN ('', 'null', 'false', '""', '[]', '{}') AND coalesce(try_cast(v AS DOUBLE), 1) <> 0 END AS truthy
FROM (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN '[]' WHEN event_id % 7 = 1 THEN '0' WHEN event_id % 7 = 2 THEN 'null' WHEN event_id % 7 = 3 THEN '{}' WHEN event_id % 7 = 4 THEN NULL ELSE props END AS v FROM events)""")
def flt15_json_truthy(env):
    from ..operators.filters import json_truthy

    k = F.col("event_id") % 7
    v = F.when(k == 0, "[]").when(k == 1, "0").when(k == 2, "null").when(k == 3, "{}").when(k == 4, F.lit(None)).otherwise(F.col("props"))
    return env.table("events").select("event_id", json_truthy(v).alias("truthy"))


@query("SELECT id, paper_id, kind, number, version, status FROM pub")
def prj1_list_slimming(env):
    return ordering.slim(env("pub"), ["search_text", "stem", "answer", "body_mode", "published_at", "question_id", "review_source"])


@query("SELECT id, question_id FROM pub WHERE status = 'published'")
def prj2_narrow_projection(env):
    return env("pub").where("status = 'published'").select("id", "question_id")


@query("""SELECT p.id, p.paper_id, coalesce(list_sort(list(DISTINCT t.name) FILTER (t.name IS NOT NULL)), []) AS tags
FROM pub p LEFT JOIN assignment a ON a.publication_id = p.id AND NOT a.needs_review LEFT JOIN tag t ON t.tag_id = a.tag_id GROUP BY p.id, p.paper_id""")
def prj3_records_with_tags(env):
    return ordering.with_tags(env("pub"), env("assignment"), env("tag")).select("id", "paper_id", "tags")


@query("SELECT id, CASE WHEN length(s) > 92 THEN concat(substr(s, 1, 92), '…') ELSE s END AS snippet, CASE WHEN number < 10 THEN 'early' ELSE 'late' END AS place FROM (SELECT id, number, trim(regexp_replace(stem, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS s FROM pub)")
def prj5_card_rows(env):
    return env("pub").select("id", ordering.snippet("stem").alias("snippet"), F.when(F.col("number") < 10, "early").otherwise("late").alias("place"))


FACETS = """
WITH base AS (SELECT * FROM pub WHERE status = 'published' AND contains(search_text, 'the')),
k AS (SELECT * FROM base WHERE review_source = 'human'), r AS (SELECT * FROM base WHERE kind = 'en'), b AS (SELECT * FROM base WHERE kind = 'en' AND review_source = 'human')
SELECT 'kind' AS facet, CASE WHEN kind IN ('en', 'de', 'fr') THEN kind ELSE 'other' END AS value, count(*) AS count FROM k GROUP BY 1, 2
UNION ALL SELECT 'review_source', coalesce(review_source, 'none'), count(*) FROM r GROUP BY 1, 2
UNION ALL SELECT 'paper', paper_id, count(*) FROM b GROUP BY 1, 2
UNION ALL SELECT 'answer', CASE WHEN trim(coalesce(answer, '')) <> '' THEN 'yes' ELSE 'no' END, count(*) FROM b GROUP BY 1, 2
UNION ALL SELECT 'body_mode', CASE WHEN coalesce(body_mode, '') = 'image' THEN 'image' ELSE 'text' END, count(*) FROM b GROUP BY 1, 2"""


@query(FACETS)
def agg1_facet_counts(env):
    return facets.facet_counts(env("pub"), SPEC, env("assignment"), env("edge"))


@query("""SELECT CASE WHEN paper_id IN ('src1', 'src2') THEN 'pair' ELSE paper_id END AS source, count(*) AS count, min(number) AS first_number, max(number) AS last_number FROM pub WHERE status = 'published' GROUP BY 1""")
def agg2_source_facet(env):
    renamed = env.rows([("src1", "pair"), ("src2", "pair")], "paper_id string, name string")
    return facets.source_facet(env("pub").where("status = 'published'"), renamed)


@query("SELECT CASE WHEN kind IN ('en', 'de', 'fr') THEN kind ELSE 'other' END AS kind, count(*) AS count FROM pub GROUP BY 1")
def agg3_folded_kinds(env):
    return env("pub").groupBy(facets.folded_kind().alias("kind")).agg(F.count("*").alias("count"))


@query(f"""WITH RECURSIVE {BELOW},
link AS (SELECT DISTINCT a.publication_id, a.tag_id FROM assignment a JOIN pub p ON p.id = a.publication_id WHERE p.status = 'published' AND p.kind = 'en' AND NOT a.needs_review)
SELECT b.root AS tag_id, t.name, t.kind, count(DISTINCT l.publication_id) AS count, count(DISTINCT CASE WHEN b.root = b.tag THEN l.publication_id END) AS direct_count
FROM below b JOIN link l ON l.tag_id = b.tag JOIN tag t ON t.tag_id = b.root GROUP BY 1, 2, 3""")
def agg4_tag_counts(env):
    return facets.tag_facet(env("pub"), FilterSpec(kind="en", tag_any=("r1",)), env("assignment"), env("edge"), env("tag"))


@query("""SELECT count(*) AS total, count(*) FILTER (trim(coalesce(answer, '')) <> '') AS with_answer, count(*) FILTER (coalesce(body_mode, '') = 'image') AS image_bodies,
 count(*) FILTER (review_source IS NULL) AS unreviewed, count(DISTINCT paper_id) AS papers FROM pub""")
def agg5_presence(env):
    return facets.dimension_presence(env("pub"))


JOBS = "SELECT event_id % 1000 AS id, CASE event_id % 4 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' WHEN 2 THEN 'pending' ELSE 'done' END AS state FROM events"


@query(f"""WITH jobs AS ({JOBS}), live AS (SELECT id FROM pub WHERE status = 'published'), tagged AS (SELECT publication_id FROM assignment WHERE NOT needs_review),
busy AS (SELECT id FROM jobs WHERE state IN ('queued', 'running')), un AS (SELECT id FROM live WHERE id NOT IN (SELECT publication_id FROM tagged))
SELECT 'untagged' AS counter, count(DISTINCT id) AS count FROM un UNION ALL SELECT 'untagged_ready', count(DISTINCT id) FROM un WHERE id NOT IN (SELECT id FROM busy)
UNION ALL SELECT 'in_work', count(DISTINCT id) FROM busy WHERE id IN (SELECT id FROM live)
UNION ALL SELECT 'to_review', count(DISTINCT id) FROM (SELECT publication_id AS id FROM assignment WHERE needs_review UNION SELECT id FROM jobs WHERE state = 'pending') WHERE id IN (SELECT id FROM live)""")
def agg6_work_counters(env):
    k = F.col("event_id") % 4
    jobs = env.table("events").select((F.col("event_id") % 1000).alias("id"), F.when(k == 0, "queued").when(k == 1, "running").when(k == 2, "pending").otherwise("done").alias("state"))
    return facets.work_counters(env("pub"), env("assignment"), jobs)


@query("SELECT paper_id, count(*) FILTER (coalesce(answer, '') = '') AS missing, count(*) FILTER (answer <> '' AND trim(answer) = '') AS blank, count(*) FILTER (trim(answer) <> '') AS present FROM pub GROUP BY 1")
def agg7_answer_inventory(env):
    return facets.answer_inventory(env("pub"))


@query("""SELECT issue, count(*) AS count FROM (SELECT unnest([CASE WHEN answer IS NULL THEN 'no answer' END, CASE WHEN body_mode = 'image' THEN 'image' END, CASE WHEN number < 5 THEN 'low number' END, CASE WHEN review_source IS NULL THEN 'unreviewed' END, kind]) AS issue FROM pub)
WHERE issue IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5""")
def agg8_top_issues(env):
    issues = F.array_compact(F.array(F.when(F.col("answer").isNull(), "no answer"), F.when(F.col("body_mode") == "image", "image"), F.when(F.col("number") < 5, "low number"), F.when(F.col("review_source").isNull(), "unreviewed"), F.col("kind")))
    return facets.top_issues(env("pub").select(issues.alias("issues")))


@query("SELECT paper_id, count(*) FILTER (deleted_at IS NULL) AS live, count(*) FILTER (deleted_at IS NOT NULL) AS deleted FROM question GROUP BY 1")
def agg9_bulk_counts(env):
    return facets.bulk_counts(env("question"))


@query("SELECT status, count(*) FILTER (answer IS NULL) AS no_answer, count(*) FILTER (review_source IS NULL) AS no_review FROM pub GROUP BY 1")
def agg11_backlog(env):
    return env("pub").groupBy("status").agg(F.count_if(F.col("answer").isNull()).alias("no_answer"), F.count_if(F.col("review_source").isNull()).alias("no_review"))


@query("""SELECT doc_id, n AS lines, CASE WHEN n >= 3 AND t >= 0.3 AND s <= 0.4 THEN 'topics' ELSE 'questions' END AS verdict FROM
(SELECT doc_id, count(*) AS n, avg(CASE WHEN trim(line) LIKE '#%' THEN 1 ELSE 0 END) AS t, avg(CASE WHEN contains(line, 'a') THEN 1 ELSE 0 END) AS s FROM line GROUP BY 1)""")
def agg12_numbering_verdict(env):
    lines = env("line").select("doc_id", F.trim("line").startswith("#").alias("topic"), F.contains("line", F.lit("a")).alias("stem"))
    return facets.numbering_verdict(lines, "doc_id")


@query("SELECT source, CASE WHEN count(DISTINCT CASE WHEN lang <> 'es' THEN lang END) = 1 THEN max(CASE WHEN lang <> 'es' THEN lang END) ELSE 'unknown' END AS label FROM documents GROUP BY 1")
def agg17_consensus(env):
    votes = env.table("documents").select("source", F.when(F.col("lang") == "es", "unknown").otherwise(F.col("lang")).alias("vote"))
    return facets.consensus(votes, "source", "vote")


@query("""SELECT frame, list_sort(list(DISTINCT record)) AS claimants, CASE WHEN count(DISTINCT CASE WHEN cue THEN record END) = 1 THEN max(CASE WHEN cue THEN record END) END AS winner
FROM (SELECT l_partkey AS frame, l_orderkey AS record, l_returnflag = 'R' AS cue FROM lineitem) GROUP BY 1 HAVING count(DISTINCT record) > 1""")
def agg18_claim_ledger(env):
    claims = env.table("lineitem").select(F.col("l_partkey").alias("frame"), F.col("l_orderkey").alias("record"), (F.col("l_returnflag") == "R").alias("cue"))
    return facets.claim_ledger(claims)


@query("SELECT 'pub' AS name, count(*) AS rows FROM pub UNION ALL SELECT 'tag', count(*) FROM tag UNION ALL SELECT 'edge', count(*) FROM edge")
def agg15_manifest(env):
    return facets.manifest({n: env(n) for n in ("pub", "tag", "edge")})


@query("SELECT id, CAST(row_number() OVER (ORDER BY published_at DESC, id DESC) - 1 AS INTEGER) AS position, true AS has_more FROM pub WHERE status = 'published' ORDER BY 2 LIMIT 40 OFFSET 40")
def sort2_page(env):
    return ordering.page(env("pub").where("status = 'published'"), "recent", 40, 40).select("id", "position", "has_more")


def _order(name, sql):
    @query(f"SELECT id, CAST(row_number() OVER (ORDER BY {sql}) - 1 AS INTEGER) AS position FROM pub QUALIFY position < 100", name=f"sort1_order_{name}")
    def run(env):
        return ordering.page(env("pub"), name, 0, 100).select("id", "position")


_order("recent", "published_at DESC, id DESC")
_order("source", "paper_id ASC NULLS LAST, number ASC NULLS LAST, id")
_order("number", "number ASC NULLS LAST, paper_id ASC NULLS LAST, id")
_order("display", "kind ASC NULLS LAST, published_at DESC, id DESC")


@query("SELECT id FROM pub WHERE status = 'published' AND kind = 'en'")
def sort4_ids_only(env):
    return _search(env, FilterSpec(kind="en")).select("id")


WANTED = [(0, 8), (1, 9), (2, 16), (3, 5), (4, 10**9), (5, 21)]


@query(f"""WITH wanted(position, id) AS (VALUES {', '.join(map(str, WANTED))})
SELECT CAST(w.position AS INTEGER) AS position, CAST(w.id AS BIGINT) AS id, coalesce(p.status, '') = 'published' AS available, CASE WHEN p.status IS NULL THEN 'not_found' WHEN p.status <> 'published' THEN p.status END AS reason,
 CASE WHEN p.status = 'superseded' THEN (SELECT x.id FROM pub x WHERE x.question_id = p.question_id AND x.status = 'published' ORDER BY version DESC, published_at DESC, id DESC LIMIT 1) END AS replacement_id
FROM wanted w LEFT JOIN pub p ON p.id = w.id""")
def jn19_resolve_ids(env):
    return ordering.resolve(env.rows(WANTED, "position int, id long"), env("pub"))


@query("SELECT id, question_id, version FROM pub QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY version DESC, published_at DESC, id DESC) = 1")
def win1_latest_version(env):
    return ordering.latest(env("pub")).select("id", "question_id", "version")


@query("""SELECT id, question_id, version, CASE WHEN row_number() OVER w = 1 THEN [] ELSE list_filter([CASE WHEN lag(kind) OVER w IS DISTINCT FROM kind THEN 'kind' END, CASE WHEN lag(answer) OVER w IS DISTINCT FROM answer THEN 'answer' END, CASE WHEN lag(body_mode) OVER w IS DISTINCT FROM body_mode THEN 'body_mode' END], lambda x: x IS NOT NULL) END AS changed
FROM pub WINDOW w AS (PARTITION BY question_id ORDER BY version)""")
def win2_history(env):
    return ordering.history(env("pub"), "question_id", ["kind", "answer", "body_mode"]).select("id", "question_id", "version", "changed")


@query("SELECT doc_id AS set_id, turn AS selected, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY taken ASC NULLS LAST, n ASC NULLS LAST, turn) AS INTEGER) AS place FROM (SELECT conv_id AS doc_id, turn, CASE WHEN turn % 2 = 0 THEN (turn * 7) % 5 END AS taken, (turn * 13) % 11 AS n FROM conversations)")
def sort6_natural_order(env):
    files = env.table("conversations").select(F.col("conv_id").alias("set_id"), F.col("turn").alias("selected"), F.when(F.col("turn") % 2 == 0, F.col("turn") * 7 % 5).alias("taken"), F.concat(F.lit("img"), F.col("turn") * 13 % 11, F.lit(".jpg")).alias("name"))
    return ordering.natural_order(files).select("set_id", "selected", "place")


@query("""WITH p AS (SELECT conv_id AS set_id, turn AS selected, (turn * 5) % 8 * 10 AS lo, (turn * 5) % 8 * 10 + CASE WHEN conv_id % 2 = 0 THEN 9 ELSE 12 END AS hi FROM conversations),
o AS (SELECT *, lag(hi) OVER (PARTITION BY set_id ORDER BY lo, selected) >= lo AS clash, row_number() OVER (PARTITION BY set_id ORDER BY lo, selected) AS a, row_number() OVER (PARTITION BY set_id ORDER BY selected) AS b FROM p)
SELECT set_id, selected, coalesce(bool_or(clash) OVER (PARTITION BY set_id), false) AS refused, CAST(CASE WHEN coalesce(bool_or(clash) OVER (PARTITION BY set_id), false) THEN b ELSE a END AS INTEGER) AS place FROM o""")
def sort7_arranged(env):
    t = F.col("turn") * 5 % 8 * 10
    pages = env.table("conversations").select(F.col("conv_id").alias("set_id"), F.col("turn").alias("selected"), t.alias("lo"), (t + F.when(F.col("conv_id") % 2 == 0, 9).otherwise(12)).alias("hi"))
    return ordering.arranged(pages).select("set_id", "selected", "refused", "place")


@query("SELECT paper_id, seq, CAST(CASE WHEN x0 >= 500 THEN 1 ELSE 0 END AS INTEGER) AS \"column\", CAST(row_number() OVER (PARTITION BY paper_id ORDER BY page, CASE WHEN x0 >= 500 THEN 1 ELSE 0 END, y0, x0, seq) AS INTEGER) AS place FROM box")
def sort8_reading_order(env):
    return ordering.reading_order(env("box").withColumn("split_x", F.lit(500.0))).select("paper_id", "seq", "column", "place")


@query("SELECT id, CAST(row_number() OVER (PARTITION BY paper_id ORDER BY CASE kind WHEN 'fr' THEN 1 WHEN 'en' THEN 2 ELSE 3 END, id) AS INTEGER) AS place FROM pub")
def sort9_grouped(env):
    items = env("pub").select("id", "kind", F.col("paper_id").alias("draft_id"), F.col("id").alias("position"))
    return ordering.grouped_order(items, ["fr", "en"]).select("id", "place")


@query("""WITH f AS (SELECT id, question_id, paper_id, trim(coalesce(answer, '')) AS a, concat(kind, '|', trim(stem)) AS exact, concat(kind, '|', regexp_replace(lower(stem), '[ \\t\\n\\r\\f\\v.,;:!?''"()|-]', '', 'g')) AS poss FROM pub WHERE status = 'published' AND kind IS NOT NULL AND stem <> '' AND coalesce(body_mode, '') <> 'image'),
p AS (SELECT x.id, CASE WHEN x.exact = y.exact THEN 'exact' ELSE 'possible' END AS class, max(y.id) AS other FROM f x JOIN f y ON x.poss = y.poss AND x.question_id <> y.question_id AND x.paper_id <> y.paper_id AND (x.a = '' OR y.a = '' OR x.a = y.a) GROUP BY 1, 2, y.question_id),
r AS (SELECT *, row_number() OVER (PARTITION BY id, class ORDER BY other DESC) AS rank, count(*) OVER (PARTITION BY id, class) AS total FROM p)
SELECT id, class, other, CAST(rank AS INTEGER) AS rank, total, total > 20 AS truncated FROM r WHERE rank <= 20""")
def jn5_related_sources(env):
    return related.related_sources(env("pub"))


@query("SELECT id FROM pub WHERE id IN (SELECT publication_id FROM assignment WHERE tag_id = 'n5')")
def jn1_semi(env):
    return env("pub").join(env("assignment").where("tag_id = 'n5'").select(F.col("publication_id").alias("id")), "id", "left_semi").select("id")


@query("SELECT id FROM pub WHERE id NOT IN (SELECT publication_id FROM assignment)")
def jn2_anti(env):
    return env("pub").join(env("assignment").select(F.col("publication_id").alias("id")), "id", "left_anti").select("id")


@query("SELECT q.paper_id, q.seq, o.o_orderpriority AS title FROM question q LEFT JOIN orders o ON o.o_orderkey = q.paper_id WHERE q.deleted_at IS NULL")
def jn3_parent(env):
    papers = env.table("orders").select(F.col("o_orderkey").alias("paper_id"), F.col("o_orderpriority").alias("title"))
    return env("question").where("deleted_at is null").join(papers, "paper_id", "left").select("paper_id", "seq", "title")


@query("SELECT o_orderkey AS paper_id, list_sort(list(l_linenumber)) AS seqs FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def jn4_attached(env):
    papers = env.table("orders").select(F.col("o_orderkey").alias("paper_id"))
    return papers.join(env("question"), "paper_id").groupBy("paper_id").agg(F.array_sort(F.collect_list("seq")).alias("seqs"))


@query("SELECT publication_id AS id FROM assignment WHERE needs_review UNION SELECT doc_id FROM labels WHERE quality = 0")
def set1_union(env):
    return env("assignment").where("needs_review").select(F.col("publication_id").alias("id")).union(env.table("labels").where("quality = 0").select("doc_id")).distinct()


@query("SELECT publication_id AS id FROM assignment WHERE needs_review EXCEPT SELECT doc_id FROM labels WHERE toxic = 0")
def set2_difference(env):
    return env("assignment").where("needs_review").select(F.col("publication_id").alias("id")).subtract(env.table("labels").where("toxic = 0").select("doc_id"))


@query("SELECT a.conv_id, list_sort(list_intersect(list(DISTINCT a.turn % 5), list(DISTINCT (a.turn * 3) % 5))) AS both_have FROM conversations a GROUP BY 1")
def set3_intersection(env):
    sets = env.table("conversations").groupBy("conv_id").agg(F.collect_set(F.col("turn") % 5).alias("a"), F.collect_set(F.col("turn") * 3 % 5).alias("b"))
    return sets.select("conv_id", F.array_sort(F.array_intersect("a", "b")).alias("both_have"))


@query("SELECT doc_id, list_distinct_in_order AS words FROM (SELECT doc_id, list_transform(list_filter(list_zip(w, range(len(w))), lambda x: list_position(w, x[1]) = x[2] + 1), lambda x: x[1]) AS list_distinct_in_order FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents))")
def set5_ordered_distinct(env):
    return env.table("documents").select("doc_id", F.array_distinct(F.split("text", " ")).alias("words"))


@query(f"""WITH RECURSIVE {BELOW} SELECT DISTINCT a.publication_id AS id FROM assignment a JOIN below b ON a.tag_id = b.tag WHERE b.root IN ('n1', 'n2', 'r3')""")
def set6_subtree_union(env):
    closure = descendants(env("edge"), ("n1", "n2", "r3"))
    return env("assignment").join(closure, F.col("tag_id") == F.col("tag"), "left_semi").select(F.col("publication_id").alias("id")).distinct()


@query("SELECT tag_id, name, count(*) AS count FROM assignment JOIN tag USING (tag_id) GROUP BY 1, 2 ORDER BY 3 DESC, 2 LIMIT 25")
def sort11_tags_by_count(env):
    named = env("assignment").join(env("tag"), "tag_id").groupBy("tag_id", "name").agg(F.count("*").alias("count"))
    return named.orderBy(F.desc("count"), "name").limit(25)
