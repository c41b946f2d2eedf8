"""Queries over tag hierarchies, versions and merges."""

from __future__ import annotations


from pyspark.sql import functions as F

from ..functions.classify import option_content
from ..operators import facets, merge, taxonomy, versioning
from .library import BELOW
from .registry import query


@query("SELECT DISTINCT parent, child FROM edge WHERE relation = 'contains'")
def grf1_adjacency(env):
    return taxonomy.hierarchy(env("edge"))


@query(f"WITH RECURSIVE {BELOW} SELECT root, tag FROM below")
def grf2_closure(env):
    return taxonomy.closure(env("edge"), env("tag").select(F.col("tag_id").alias("root")))


CYCLE = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "b"), ("d", "e"), ("x", "y")]


@query("SELECT * FROM (VALUES ('b'), ('c'), ('d'), ('e')) v(tag)")
def grf3_cycle_check(env):
    edges = env.rows([(a, b, "contains") for a, b in CYCLE], "parent string, child string, relation string")
    return taxonomy.unsorted_rest(edges)


@query("""SELECT parent, child, relation, CASE WHEN parent = child THEN 'self' WHEN parent NOT IN (SELECT tag_id FROM tag) OR child NOT IN (SELECT tag_id FROM tag) THEN 'unknown' WHEN n > 1 THEN 'twice' END AS reason
FROM (SELECT *, count(*) OVER (PARTITION BY parent, child, relation) AS n FROM (SELECT * FROM edge UNION ALL VALUES ('r0', 'r0', 'contains'), ('r0', 'zz', 'contains'), ('n3', 'n3', 'related_method'))) WHERE reason IS NOT NULL""")
def grf3_invalid_relations(env):
    more = env.rows([("r0", "r0", "contains"), ("r0", "zz", "contains"), ("n3", "n3", "related_method")], "parent string, child string, relation string")
    return taxonomy.invalid_relations(env("edge").union(more), env("tag"))


@query("""WITH RECURSIVE up(tag, node) AS (SELECT tag_id, tag_id FROM tag WHERE kind = 'firm' UNION SELECT u.tag, e.parent FROM up u JOIN edge e ON e.child = u.node AND e.relation = 'contains')
SELECT tag, node AS chapter FROM up WHERE node NOT IN (SELECT child FROM edge WHERE relation = 'contains')""")
def grf4_chapters(env):
    return taxonomy.chapters(env("edge"), env("tag").where("kind = 'firm'").select(F.col("tag_id").alias("root")))


@query("""SELECT publication_id, CASE WHEN tag_id IN ('n1', 'n2') THEN 'n3' ELSE tag_id END AS tag_id, bool_and(needs_review) AS needs_review, count(*) AS merged FROM assignment GROUP BY 1, 2""")
def grf5_merge_links(env):
    return taxonomy.merge_tags(env("assignment"), env("edge"), ("n1", "n2"), "n3")[0]


@query("""SELECT DISTINCT parent, child, relation FROM (SELECT CASE WHEN parent IN ('n1', 'n2') THEN 'n3' ELSE parent END AS parent, CASE WHEN child IN ('n1', 'n2') THEN 'n3' ELSE child END AS child, relation FROM edge) WHERE parent <> child""")
def grf5_merge_edges(env):
    return taxonomy.merge_tags(env("assignment"), env("edge"), ("n1", "n2"), "n3")[1]


@query(f"""WITH RECURSIVE {BELOW}, under AS (SELECT DISTINCT tag FROM below WHERE root IN ('n4', 'n8')), links AS (SELECT * FROM assignment WHERE tag_id IN (SELECT tag FROM under))
SELECT (SELECT count(*) FROM under) AS tags, (SELECT count(*) FROM edge WHERE parent IN ('n4', 'n8') OR child IN ('n4', 'n8')) AS edges, (SELECT count(*) FROM links) AS links,
 count(DISTINCT CASE WHEN p.status = 'published' THEN p.id END) AS live, count(DISTINCT CASE WHEN p.status <> 'published' THEN p.id END) AS historic FROM links l JOIN pub p ON p.id = l.publication_id""")
def agg10_impact(env):
    return taxonomy.impact(env("assignment"), env("edge"), env("pub"), ("n4", "n8"))


@query("""SELECT proposal_id, list_sort(list(DISTINCT t)) AS broken FROM (SELECT doc_id AS proposal_id, unnest([concat('n', doc_id % 25), concat('s', doc_id % 90 + 1), 'gone']) AS t FROM documents)
WHERE t NOT IN (SELECT tag_id FROM tag WHERE active) GROUP BY 1""")
def grf7_broken_references(env):
    ids = F.array(F.concat(F.lit("n"), F.col("doc_id") % 25), F.concat(F.lit("s"), F.col("doc_id") % 90 + 1), F.lit("gone"))
    proposals = env.table("documents").select(F.col("doc_id").alias("proposal_id"), ids.alias("tag_ids"))
    return taxonomy.broken_references(proposals, env("tag"))


@query("""WITH asked(asked, kind) AS (VALUES ('Nation_3', 'land'), ('NATION_ 4', 'land'), ('asia', 'area'), ('REGION_1', 'area'))
SELECT a.asked, a.kind, t.tag_id, t.active FROM asked a JOIN tag t ON t.kind = a.kind AND lower(replace(t.name, ' ', '')) = lower(replace(a.asked, ' ', ''))
QUALIFY row_number() OVER (PARTITION BY a.asked, a.kind ORDER BY t.active DESC, t.tag_id) = 1""")
def grf8_name_candidates(env):
    asked = env.rows([("Nation_3", "land"), ("NATION_ 4", "land"), ("asia", "area"), ("REGION_1", "area")], "asked string, kind string")
    return taxonomy.name_candidates(env("tag"), asked)


@query(f"""WITH RECURSIVE {BELOW}, hit AS (SELECT DISTINCT b.root FROM below b JOIN tag t ON t.tag_id = b.root WHERE contains(t.name, '1') AND b.tag IN (SELECT tag_id FROM assignment)),
up(node) AS (SELECT root FROM hit UNION SELECT e.parent FROM up u JOIN edge e ON e.child = u.node AND e.relation = 'contains') SELECT node AS tag FROM up""")
def grf9_visible_graph(env):
    return taxonomy.visible_graph(env("edge"), env("tag"), env("assignment"), "1")


@query("""WITH p AS (SELECT child, min(parent) AS up FROM edge WHERE relation = 'contains' GROUP BY 1)
SELECT t.tag_id, concat_ws(' / ', t4.name, t3.name, t2.name, t.name) AS path FROM tag t LEFT JOIN p p1 ON p1.child = t.tag_id LEFT JOIN tag t2 ON t2.tag_id = p1.up LEFT JOIN p p2 ON p2.child = p1.up LEFT JOIN tag t3 ON t3.tag_id = p2.up LEFT JOIN p p3 ON p3.child = p2.up LEFT JOIN tag t4 ON t4.tag_id = p3.up""")
def agg19_folder_paths(env):
    return taxonomy.paths(env("edge"), env("tag"))


@query("""WITH RECURSIVE c AS (SELECT DISTINCT parent, child FROM edge WHERE relation = 'contains'), d(tag, depth) AS (SELECT parent, 0 FROM c WHERE parent NOT IN (SELECT child FROM c) UNION SELECT c.child, d.depth + 1 FROM d JOIN c ON c.parent = d.tag),
depths AS (SELECT tag, max(depth) AS depth FROM d GROUP BY 1),
a AS (SELECT tag, depth, row_number() OVER (ORDER BY tag) AS place FROM depths WHERE depth = 0),
b AS (SELECT tag, depth, row_number() OVER (ORDER BY m, tag) AS place FROM (SELECT t.tag, t.depth, avg(a.place) AS m FROM depths t JOIN c ON c.child = t.tag JOIN a ON a.tag = c.parent WHERE t.depth = 1 GROUP BY 1, 2)),
ab AS (SELECT * FROM a UNION ALL SELECT * FROM b),
e AS (SELECT tag, depth, row_number() OVER (ORDER BY m, tag) AS place FROM (SELECT t.tag, t.depth, avg(ab.place) AS m FROM depths t JOIN c ON c.child = t.tag JOIN ab ON ab.tag = c.parent WHERE t.depth = 2 GROUP BY 1, 2))
SELECT tag, CAST(depth AS INTEGER) AS depth, CAST(place AS INTEGER) AS place FROM (SELECT * FROM ab UNION ALL SELECT * FROM e)""")
def sort12_layers(env):
    return taxonomy.layers(env("edge"))


DRAFT = """drafts AS (SELECT doc_id AS question_id, sha256(concat(lang, '|', CAST(n_chars % 3 AS VARCHAR))) AS hash, CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 7 = 1 THEN 'old' ELSE sha256(concat(lang, '|', CAST(n_chars % 3 AS VARCHAR))) END AS approved_hash, CASE WHEN doc_id % 5 = 0 THEN 'red' WHEN doc_id % 5 = 1 THEN 'yellow' ELSE 'green' END AS state FROM documents),
versions AS (SELECT id, question_id, version, status, sha256(concat(kind, '|', CAST(id % 3 AS VARCHAR))) AS hash FROM pub)"""


@query(f"""WITH {DRAFT}, top AS (SELECT question_id, max(version) AS top FROM versions GROUP BY 1), live AS (SELECT question_id, hash, version FROM versions WHERE status = 'published' QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY version DESC) = 1),
j AS (SELECT d.question_id, CASE WHEN approved_hash IS NULL THEN 'not_approved' WHEN state = 'red' THEN 'not_ready' WHEN approved_hash <> d.hash THEN 'changed' WHEN live.hash = d.hash THEN 'same' ELSE 'new' END AS action, top, live.version AS lv FROM drafts d LEFT JOIN top USING (question_id) LEFT JOIN live ON live.question_id = d.question_id)
SELECT question_id, action, CAST(CASE action WHEN 'new' THEN coalesce(top, 0) + 1 WHEN 'same' THEN lv END AS INTEGER) AS version FROM j""")
def mut1_publish(env):
    h = F.sha2(F.concat("lang", F.lit("|"), F.col("n_chars") % 3), 256)
    k = F.col("doc_id") % 7
    drafts = env.table("documents").select(F.col("doc_id").alias("question_id"), h.alias("hash"), F.when(k == 0, F.lit(None)).when(k == 1, "old").otherwise(h).alias("approved_hash"), F.when(F.col("doc_id") % 5 == 0, "red").when(F.col("doc_id") % 5 == 1, "yellow").otherwise("green").alias("state"))
    versions = env("pub").withColumn("hash", F.sha2(F.concat("kind", F.lit("|"), F.col("id") % 3), 256))
    return versioning.publish(versions, drafts)


@query("""WITH b AS (SELECT id, question_id, version, md5(kind) AS hash, CASE WHEN version = 1 THEN concat('x', id) END AS extras FROM pub)
SELECT id, coalesce(extras, CASE WHEN lag(hash) OVER w = hash THEN lag(extras) OVER w END) AS extras FROM b WINDOW w AS (PARTITION BY question_id ORDER BY version)""")
def mut3_carried_extras(env):
    rows = env("pub").select("id", "question_id", "version", F.md5("kind").alias("hash"), F.when(F.col("version") == 1, F.concat(F.lit("x"), "id")).alias("extras"))
    return versioning.carried(rows).select("id", "extras")


@query("""WITH r AS (SELECT doc_id * 3 AS id, min(doc_id) AS position FROM documents GROUP BY 1)
SELECT position, r.id, status IS NOT NULL AND status = 'published' AS done, CASE WHEN status IS NULL THEN 'not_found' WHEN status <> 'published' THEN concat('is_', status) END AS reason, CASE WHEN status = 'published' THEN 'withdrawn' ELSE status END AS status FROM r LEFT JOIN pub p ON p.id = r.id""")
def mut2_withdraw_batch(env):
    requests = env.table("documents").select((F.col("doc_id") * 3).alias("id"), F.col("doc_id").alias("position"))
    return versioning.batch(env("pub"), requests, "published", "withdrawn")


REQ = """req AS (SELECT concat('q', k) AS request_id, CASE WHEN k % 400 = 7 THEN concat('h', event_id) ELSE concat('h', k) END AS hash, k AS publication_id, concat('n', k % 25) AS tag_id, CASE WHEN k % 3 = 0 THEN 'remove' ELSE 'add' END AS op, k % 4 AS expected FROM (SELECT event_id, event_id % (SELECT 1 + count(*) // 2 FROM events) AS k FROM events)),
rev AS (SELECT id AS publication_id, id % 5 AS revision FROM pub WHERE id % 8 <> 7),
judged AS (SELECT req.*, revision, row_number() OVER (PARTITION BY request_id, req.publication_id, tag_id ORDER BY hash) AS n, min(hash) OVER (PARTITION BY request_id) <> max(hash) OVER (PARTITION BY request_id) AS odd FROM req LEFT JOIN rev USING (publication_id)),
outcomes AS (SELECT *, CASE WHEN odd THEN 'conflict' WHEN n > 1 THEN 'replayed' WHEN revision IS NULL THEN 'not_found' WHEN revision <> expected THEN 'stale' ELSE 'done' END AS outcome FROM judged)"""


def _assigned(env):
    # Half as many requests as events: each is asked about twice.
    events, k = env.table("events"), F.col("k")
    events = events.crossJoin(F.broadcast(events.agg(F.floor(1 + F.count("*") / 2).cast("long").alias("n")))).withColumn("k", F.col("event_id") % F.col("n"))
    requests = events.select(F.concat(F.lit("q"), k).alias("request_id"), F.concat(F.lit("h"), F.when(k % 400 == 7, F.col("event_id")).otherwise(k)).alias("hash"), k.alias("publication_id"), F.concat(F.lit("n"), k % 25).alias("tag_id"), F.when(k % 3 == 0, "remove").otherwise("add").alias("op"), (k % 4).alias("expected"))
    revisions = env("pub").where("id % 8 <> 7").select(F.col("id").alias("publication_id"), (F.col("id") % 5).alias("revision"))
    return versioning.assign(env("assignment"), requests, revisions)


@query(f"WITH {REQ} SELECT request_id, publication_id, tag_id, outcome FROM outcomes")
def mut4_assign_outcomes(env):
    return _assigned(env)[0]


@query(f"""WITH {REQ}, done AS (SELECT * FROM outcomes WHERE outcome = 'done')
SELECT publication_id, tag_id, needs_review FROM assignment a WHERE NOT EXISTS (SELECT 1 FROM done d WHERE d.publication_id = a.publication_id AND d.tag_id = a.tag_id) UNION ALL SELECT DISTINCT publication_id, tag_id, false FROM done WHERE op = 'add'""")
def mut4_assign_links(env):
    return _assigned(env)[1]


@query("""SELECT publication_id, tag_id, needs_review FROM assignment WHERE tag_id <> 'n3' UNION ALL
SELECT publication_id, 'n4', needs_review FROM assignment WHERE tag_id = 'n3' AND publication_id NOT IN (SELECT publication_id FROM assignment WHERE tag_id = 'n4')""")
def mut5_replace_tag(env):
    return versioning.replace_tag(env("assignment"), "n3", "n4")


@query("""SELECT key, op_id, after IS NOT DISTINCT FROM current AS undone, CASE WHEN after IS NOT DISTINCT FROM current THEN before ELSE current END AS value FROM
(SELECT event_id AS op_id, user_id AS key, event_type AS before, CASE WHEN event_id % 9 = 0 THEN NULL ELSE event_type END AS after, CASE WHEN user_id % 3 = 0 THEN 'edited' WHEN event_id % 9 = 0 THEN NULL ELSE event_type END AS current FROM events) QUALIFY row_number() OVER (PARTITION BY key ORDER BY op_id DESC) = 1""")
def mut6_undo(env):
    e = F.when(F.col("event_id") % 9 == 0, F.lit(None)).otherwise(F.col("event_type"))
    log = env.table("events").select(F.col("event_id").alias("op_id"), F.col("user_id").alias("key"), F.col("event_type").alias("before"), e.alias("after"), F.when(F.col("user_id") % 3 == 0, "edited").otherwise(e).alias("current"))
    return versioning.undo(log)


TWO = """local AS (SELECT doc_id AS id, lang AS kind, concat(source, CAST(doc_id % 40 AS VARCHAR)) AS name, CASE WHEN doc_id % 3 = 0 THEN '' ELSE concat('a', doc_id) END AS answer, doc_id % 4 AS questions FROM documents WHERE doc_id % 2 = 0),
incoming AS (SELECT doc_id AS id, lang AS kind, concat(source, CAST((doc_id + 1) % 50 AS VARCHAR)) AS name, CASE WHEN doc_id % 5 = 0 THEN '' ELSE concat('b', doc_id) END AS answer, doc_id % 4 AS questions FROM documents WHERE doc_id % 2 = 1),
m AS (SELECT i.id AS incoming_id, l.id AS local_id FROM incoming i LEFT JOIN (SELECT * FROM local QUALIFY row_number() OVER (PARTITION BY kind, name ORDER BY questions DESC, id) = 1) l USING (kind, name)),
f AS (SELECT local_id, i.answer AS b FROM m JOIN incoming i ON i.id = m.incoming_id WHERE local_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY local_id ORDER BY incoming_id) = 1),
merged AS (SELECT id, kind, name, CASE WHEN answer = '' AND coalesce(b, '') <> '' THEN b ELSE answer END AS answer, questions, CASE WHEN answer = '' AND coalesce(b, '') <> '' THEN 'filled' ELSE 'kept' END AS origin FROM local LEFT JOIN f ON f.local_id = local.id
UNION ALL SELECT i.id, i.kind, i.name, i.answer, i.questions, 'inserted' FROM incoming i JOIN m ON m.incoming_id = i.id WHERE m.local_id IS NULL)"""


def _two(env):
    d = env.table("documents")
    side = lambda odd, shift, mod, blank, p: d.where(F.col("doc_id") % 2 == odd).select(F.col("doc_id").alias("id"), F.col("lang").alias("kind"), F.concat("source", ((F.col("doc_id") + shift) % mod).cast("string")).alias("name"), F.when(F.col("doc_id") % blank == 0, "").otherwise(F.concat(F.lit(p), "doc_id")).alias("answer"), (F.col("doc_id") % 4).alias("questions"))
    local, incoming = side(0, 0, 40, 3, "a"), side(1, 1, 50, 5, "b")
    return local, incoming, merge.id_map(local, incoming, ["kind", "name"], [F.desc("questions"), F.asc("id")])


@query(f"WITH {TWO} SELECT incoming_id, local_id FROM m")
def jn17_natural_keys(env):
    return _two(env)[2]


@query(f"WITH {TWO} SELECT * FROM merged")
def mut9_bundle_merge(env):
    local, incoming, mapping = _two(env)
    return merge.merge_rows(local, incoming, mapping, ["answer"])


@query(f"WITH {TWO} SELECT origin, count(*) AS rows FROM merged GROUP BY 1")
def mut9_dry_run(env):
    local, incoming, mapping = _two(env)
    return merge.merge_counts(merge.merge_rows(local, incoming, mapping, ["answer"]))


@query(f"WITH {TWO} SELECT * FROM merged WHERE id NOT IN (SELECT id FROM merged WHERE origin = 'inserted')")
def mut10_undo_merge(env):
    local, incoming, mapping = _two(env)
    done = merge.merge_rows(local, incoming, mapping, ["answer"])
    return merge.undo_merge(done, done.where("origin = 'inserted'"))


@query("""WITH q AS (SELECT id, paper_id, number, substr(regexp_replace(stem, '[ \\t\\n\\r\\f\\v]', '', 'g'), 1, 30) AS head FROM pub), i AS (SELECT * FROM q WHERE id % 2 = 1), l AS (SELECT * FROM q WHERE id % 2 = 0),
h AS (SELECT i.id, l.id AS local_id, 1 AS s FROM i JOIN l USING (paper_id) WHERE i.number = l.number AND (starts_with(i.head, l.head) OR starts_with(l.head, i.head))
UNION ALL SELECT i.id, l.id, 2 FROM i JOIN l USING (paper_id) WHERE l.head <> '' AND i.head <> '' AND (starts_with(i.head, l.head) OR starts_with(l.head, i.head))),
b AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY id ORDER BY s, local_id) = 1)
SELECT i.id, b.local_id, CASE b.s WHEN 1 THEN 'number' WHEN 2 THEN 'stem' ELSE 'new' END AS "by" FROM i LEFT JOIN b USING (id)""")
def jn18_match_questions(env):
    rows = env("pub").select("id", "paper_id", "number", "stem")
    return merge.match_questions(rows.where("id % 2 = 0"), rows.where("id % 2 = 1"))


@query("""SELECT 'orders' AS name, count(*) AS rows FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)
UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)) UNION ALL SELECT 'customer', count(*) FROM customer WHERE c_nationkey = 3""")
def snk2_closed_subset(env):
    customer = env.table("customer").withColumn("id", F.col("c_custkey"))
    tables = {"customer": customer, "orders": env.table("orders"), "lineitem": env.table("lineitem")}
    kept = customer.where("c_nationkey = 3").select("id")
    out = merge.closed_subset(tables, kept, [("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey")])
    return facets.manifest(out)


@query("""WITH b AS (SELECT event_id AS backup_id, event_type AS series, ts AS created_at FROM events) SELECT backup_id, series FROM b QUALIFY row_number() OVER (PARTITION BY series ORDER BY created_at DESC, backup_id DESC) > 10""")
def snk4_backup_rotation(env):
    backups = env.table("events").select(F.col("event_id").alias("backup_id"), F.col("event_type").alias("series"), F.col("ts").alias("created_at"))
    return facets.rotation(backups, 10).select("backup_id", "series")


@query("SELECT concat_ws(' | ', kind, name, CAST(count(*) AS VARCHAR), CAST(count(*) FILTER (needs_review) AS VARCHAR)) AS row FROM assignment JOIN tag USING (tag_id) GROUP BY kind, name")
def snk7_migration_report(env):
    return facets.migration_report(env("assignment"), env("tag"))


@query("""SELECT upload_id, paper_id FROM (SELECT doc_id AS upload_id, md5(text) AS sha256, lang AS kind FROM documents WHERE doc_id % 2 = 1) u JOIN (SELECT doc_id AS paper_id, md5(text) AS sha256, lang AS kind, doc_id % 4 AS questions FROM documents WHERE doc_id % 2 = 0) p USING (sha256, kind)
QUALIFY row_number() OVER (PARTITION BY upload_id ORDER BY questions DESC, paper_id) = 1""")
def src10_duplicate_sources(env):
    from ..sources.tables import duplicate_sources

    d = env.table("documents").select("doc_id", F.md5("text").alias("sha256"), F.col("lang").alias("kind"))
    papers = d.where("doc_id % 2 = 0").select(F.col("doc_id").alias("paper_id"), "sha256", "kind", (F.col("doc_id") % 4).alias("questions"))
    return duplicate_sources(papers, d.where("doc_id % 2 = 1").select(F.col("doc_id").alias("upload_id"), "sha256", "kind"))


@query("""SELECT count(*) FILTER (w IS NULL) AS extra, count(*) FILTER (n IS NULL) AS missing, count(*) FILTER (n > 1) AS repeated FROM
(SELECT l_orderkey AS k, count(*) AS n FROM lineitem WHERE l_linenumber < 3 GROUP BY 1) a FULL JOIN (SELECT o_orderkey AS k, 1 AS w FROM orders) b USING (k)""")
def set4_exact_cover(env):
    parts = env.table("lineitem").where("l_linenumber < 3").select(F.col("l_orderkey").alias("k"))
    return merge.exact_cover(parts, env.table("orders").select(F.col("o_orderkey").alias("k")), "k")


CARDS = """d AS (SELECT doc_id AS position, doc_id // 100 AS paper_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE doc_id % 20 END AS anchor, lang AS kind, doc_id % 7 AS number FROM documents WHERE doc_id % 2 = 0),
e AS (SELECT doc_id AS id, doc_id // 100 AS paper_id, CASE WHEN doc_id % 4 = 1 THEN NULL ELSE (doc_id - 1) % 20 END AS anchor, lang AS kind, doc_id % 7 AS number, doc_id % 5 = 0 AS deleted FROM documents WHERE doc_id % 2 = 1)"""


def _pass(keys, left, free):
    ks = ", ".join(keys)
    some = " AND ".join(f"{k} IS NOT NULL" for k in keys)
    return f"""SELECT x.paper_id, x.position, y.id FROM (SELECT *, row_number() OVER (PARTITION BY {ks} ORDER BY position) AS n FROM {left} WHERE {some}) x JOIN (SELECT *, row_number() OVER (PARTITION BY {ks} ORDER BY deleted, id) AS n FROM {free} WHERE {some}) y USING ({ks}, n)"""


@query(f"""WITH {CARDS}, p1 AS ({_pass(['paper_id', 'anchor', 'kind'], 'd', 'e')}), d2 AS (SELECT * FROM d WHERE position NOT IN (SELECT position FROM p1)), e2 AS (SELECT * FROM e WHERE id NOT IN (SELECT id FROM p1)),
p2 AS ({_pass(['paper_id', 'anchor'], 'd2', 'e2')}), d3 AS (SELECT * FROM d2 WHERE position NOT IN (SELECT position FROM p2) AND (anchor IS NULL OR kind IN ('unknown', 'manual'))), e3 AS (SELECT * FROM e2 WHERE id NOT IN (SELECT id FROM p2)), p3 AS ({_pass(['paper_id', 'number'], 'd3', 'e3')})
SELECT *, 1 AS pass FROM p1 UNION ALL SELECT *, 2 FROM p2 UNION ALL SELECT *, 3 FROM p3""")
def jn14_match_cards(env):
    d = env.table("documents")
    desired = d.where("doc_id % 2 = 0").select(F.col("doc_id").alias("position"), F.floor(F.col("doc_id") / 100).alias("paper_id"), F.when(F.col("doc_id") % 3 != 0, F.col("doc_id") % 20).alias("anchor"), F.col("lang").alias("kind"), (F.col("doc_id") % 7).alias("number"))
    existing = d.where("doc_id % 2 = 1").select(F.col("doc_id").alias("id"), F.floor(F.col("doc_id") / 100).alias("paper_id"), F.when(F.col("doc_id") % 4 != 1, (F.col("doc_id") - 1) % 20).alias("anchor"), F.col("lang").alias("kind"), (F.col("doc_id") % 7).alias("number"), (F.col("doc_id") % 5 == 0).alias("deleted"))
    return merge.match_cards(existing, desired)


@query("""SELECT id, sha256(concat('{"kind":["', kind, '"],"number":["', CAST(number AS VARCHAR), '"]}')) AS hash FROM pub""")
def hsh1_content_hash(env):
    return env("pub").select("id", versioning.content_hash(number=F.col("number"), kind=F.col("kind")).alias("hash"))


@query("""SELECT id, map {'A': kind, 'B': '', 'C': '', 'D': 'x'} AS m FROM pub WHERE false""")
def map1_option_content_empty(env):
    m = F.create_map(F.lit("A"), F.col("kind"), F.lit("D"), F.lit("x"))
    return env("pub").where("false").select("id", option_content(m).alias("m"))


@query("""SELECT id, op IS NOT NULL AND op = 'delete' AS deleted, restores FROM (SELECT DISTINCT paper_id AS id FROM question) r
LEFT JOIN (SELECT user_id AS id, max_by(op, event_id) AS op, count(*) FILTER (op = 'restore') AS restores FROM (SELECT *, CASE WHEN event_id % 2 = 0 THEN 'delete' ELSE 'restore' END AS op FROM events) GROUP BY 1) e USING (id)""")
def mut17_soft_deletes(env):
    rows = env("question").select(F.col("paper_id").alias("id")).distinct()
    events = env.table("events").select(F.col("user_id").alias("id"), "event_id", F.when(F.col("event_id") % 2 == 0, "delete").otherwise("restore").alias("op"))
    return versioning.soft_deletes(rows, events)


@query("""SELECT paper_id, seq, CAST(CASE WHEN page = 0 THEN 1 ELSE 0 END AS INTEGER) AS page FROM box""")
def mut15_page_reorder(env):
    pages = env("box").select("paper_id", "page").distinct().withColumn("to_page", 1 - F.col("page"))
    return versioning.reordered(env("box"), pages).select("paper_id", "seq", "page")


@query("""WITH pages AS (SELECT l_orderkey AS paper_id, l_linenumber AS page FROM lineitem), parts AS (SELECT l_orderkey AS paper_id, l_linenumber AS page FROM lineitem WHERE l_suppkey % 13 <> 0 UNION ALL SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_suppkey % 17 = 0),
j AS (SELECT paper_id, n FROM pages LEFT JOIN (SELECT paper_id, page, count(*) AS n FROM parts GROUP BY 1, 2) USING (paper_id, page))
SELECT paper_id, count(*) FILTER (n IS NULL) AS missing, count(*) FILTER (n > 1) AS repeated, count(*) FILTER (n IS NULL) = 0 AND count(*) FILTER (n > 1) = 0 AS lossless FROM j GROUP BY 1""")
def mut16_split_check(env):
    pages = env.table("lineitem").select(F.col("l_orderkey").alias("paper_id"), F.col("l_linenumber").alias("page"), "l_suppkey")
    parts = pages.where("l_suppkey % 13 <> 0").union(pages.where("l_suppkey % 17 = 0")).drop("l_suppkey")
    return versioning.split_check(parts, pages.drop("l_suppkey"))


@query("""SELECT doc_id AS proposal_id FROM documents WHERE md5(concat(source, lang)) NOT IN (SELECT md5(concat(source, lang)) FROM documents WHERE doc_id % 97 = 0)""")
def mut18_rejected_memory(env):
    d = env.table("documents").select("doc_id", F.md5(F.concat("source", "lang")).alias("change_hash"))
    return versioning.rejected_before(d, d.where("doc_id % 97 = 0")).select(F.col("doc_id").alias("proposal_id"))


@query("""SELECT id, CASE WHEN paper_id = 'src3' THEN 'renamed' ELSE paper_id END AS paper_id, CASE WHEN paper_id = 'src3' THEN 'new' ELSE 'old' END AS changed FROM pub""")
def mut11_rename_source(env):
    rows = env("pub").withColumn("hash", F.lit("h"))
    return versioning.rename_source(rows, "src3", "renamed").select("id", "paper_id", F.when(F.col("hash") == "h", "old").otherwise("new").alias("changed"))


