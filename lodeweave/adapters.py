"""The benchmark tables in the shapes that the operators work on.

Each adapter is SQL that Spark and DuckDB both run, so that a query and its
check start from the same rows. Operators never import this module.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from .sources.tables import load

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

FRAMES: dict[str, str] = {
    # Published versions of records: two versions a question.
    "pub": """
SELECT d.doc_id AS id, d.source AS paper_id, CAST(floor(d.doc_id / 2) AS BIGINT) AS question_id,
       CAST(d.doc_id % 2 + 1 AS INT) AS version,
       CASE WHEN d.doc_id % 11 = 5 THEN 'withdrawn' WHEN d.doc_id % 2 = 0 THEN 'superseded' ELSE 'published' END AS status,
       d.lang AS kind, CAST(d.doc_id % 50 AS INT) AS number,
       CASE WHEN l.quality = 1 THEN 'human' WHEN l.quality = 0 THEN 'ai' END AS review_source,
       CASE WHEN d.doc_id % 17 = 0 THEN ' ' WHEN l.toxic = 1 THEN 'yes' WHEN l.toxic = 0 THEN '' END AS answer,
       CASE WHEN d.doc_id % 5 = 0 THEN 'image' WHEN d.doc_id % 5 > 1 THEN 'text' END AS body_mode,
       lower(d.text) AS search_text, d.text AS stem,
       DATE '2024-01-01' + CAST(d.doc_id % 365 AS INT) AS published_at
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "tag": """
SELECT concat('r', r_regionkey) AS tag_id, lower(r_name) AS name, 'area' AS kind, true AS active FROM region
UNION ALL SELECT concat('n', n_nationkey), lower(n_name), 'land', n_nationkey % 9 <> 4 FROM nation
UNION ALL SELECT concat('s', s_suppkey), lower(s_name), 'firm', s_suppkey % 10 <> 3 FROM supplier""",
    # A hierarchy with diamonds, and edges that imply nothing.
    "edge": """
SELECT concat('r', n_regionkey) AS parent, concat('n', n_nationkey) AS child, 'contains' AS relation FROM nation
UNION ALL SELECT concat('r', (n_regionkey + 1) % 5), concat('n', n_nationkey), 'contains' FROM nation WHERE n_nationkey % 4 = 0
UNION ALL SELECT concat('n', s_nationkey), concat('s', s_suppkey), 'contains' FROM supplier
UNION ALL SELECT concat('n', (s_nationkey + 4) % 25), concat('s', s_suppkey), 'contains' FROM supplier WHERE s_suppkey % 3 = 0
UNION ALL SELECT concat('r', r_regionkey), concat('r', (r_regionkey + 2) % 5), 'related_method' FROM region""",
    "assignment": """
SELECT doc_id AS publication_id, concat('s', doc_id * 13 % (SELECT count(*) FROM supplier) + 1) AS tag_id, doc_id % 7 = 0 AS needs_review FROM documents WHERE doc_id % 5 <> 4
UNION ALL SELECT doc_id, concat('n', doc_id % 25), doc_id % 6 = 0 FROM documents WHERE doc_id % 3 = 0""",
    # Ordered text blocks.
    "line": """
SELECT conv_id AS doc_id, CAST(turn AS INT) AS pos, CASE WHEN turn % 3 = 0 THEN concat('# ', replace(text, chr(10), ' ')) ELSE concat(substr('      ', 1, CAST(turn % 4 * 2 AS INT)), replace(text, chr(10), ' ')) END AS line FROM conversations""",
    # Boxes on pages, in page units.
    "box": """
SELECT l_orderkey AS paper_id, CAST(l_linenumber AS INT) AS seq, CAST(l_partkey % 2 AS INT) AS page,
       CAST(l_partkey % 700 AS DOUBLE) AS x0, CAST(l_suppkey * 37 % 800 AS DOUBLE) AS y0,
       CAST(l_partkey % 700 + 40 + l_quantity * 4 AS DOUBLE) AS x1, CAST(l_suppkey * 37 % 800 + 30 + l_quantity * 3 AS DOUBLE) AS y1,
       CASE WHEN l_linenumber % 2 = 0 THEN 'figure' ELSE 'region' END AS role FROM lineitem""",
    "job": """
SELECT event_id, user_id AS job_id, event_type AS kind, ts, value FROM events""",
    # Layout blocks of papers of a few dozen lines, in one column or two; every line item is a block.
    "paperblock": """
SELECT paper_id, seq, CAST(floor((seq - 1) / 12) AS INT) AS page, CAST(CASE WHEN wide THEN 60 WHEN side = 0 THEN 60 + part % 20 ELSE 540 + part % 20 END AS DOUBLE) AS x0, y0,
       CAST(CASE WHEN wide THEN 900 WHEN side = 0 THEN 460 ELSE 940 END AS DOUBLE) AS x1, CAST(y0 + 30 + part % 50 AS DOUBLE) AS y1, part,
       CASE WHEN part % 31 = 0 THEN 'equation' WHEN part % 37 = 0 THEN 'table' WHEN part % 41 = 0 THEN 'header' WHEN part % 43 = 0 THEN 'image' ELSE 'text' END AS type
FROM (SELECT *, paper_id % 3 = 0 OR part % 29 = 0 AS wide, CASE WHEN (seq - 1) % 12 < 6 THEN 0 ELSE 1 END AS side,
             CAST(CASE WHEN paper_id % 3 = 0 THEN (seq - 1) % 12 * 75 ELSE (seq - 1) % 6 * 150 END + 40 AS DOUBLE) AS y0
      FROM (SELECT CAST(floor(l_orderkey / 8) AS BIGINT) AS paper_id, CAST(row_number() OVER (PARTITION BY floor(l_orderkey / 8) ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INT) AS seq, l_partkey AS part FROM lineitem) n) p""",
    "question": """
SELECT l_orderkey AS paper_id, CAST(l_linenumber AS INT) AS seq, CAST(l_linenumber * 2 - l_partkey % 2 AS INT) AS number, l_partkey AS part,
       CASE WHEN l_suppkey % 9 = 0 THEN l_shipdate END AS deleted_at FROM lineitem""",
}


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The adapter ``name`` over the tables of ``sf_dir``."""
    used: dict[str, DataFrame] = {}

    def table(m):
        used[m[2]] = used[m[2]] if m[2] in used else load(spark, sf_dir, m[2])
        return f"{m[1]} {{{m[2]}}}"

    sql = re.sub(rf"\b(FROM|JOIN) ({'|'.join(TABLES)})\b", table, FRAMES[name])
    return spark.sql(sql, **used)


def with_frames(sql: str) -> str:
    """DuckDB SQL with a CTE for each adapter that it names."""
    names = [n for n in FRAMES if re.search(rf"\b{n}\b", sql)]
    ctes = ", ".join(f"{n} AS ({FRAMES[n]})" for n in names)
    if not names:
        return sql
    text = sql.strip()
    if text.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {ctes}, {text[len('WITH RECURSIVE') :]}"
    if text.upper().startswith("WITH"):
        return f"WITH {ctes}, {text[4:]}"
    return f"WITH {ctes} {text}"
