"""Tag hierarchies: closures, checks, counts and merges.

Closures of small hierarchies, as counted, are walked in memory; others grow by
joins until nothing new is reached. Pairs are distinct, so diamonds never multiply.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HIERARCHY = "contains"
#: Edges, roots and pairs up to which a closure is walked in memory.
SMALL, PAIRS = 20_000, 200_000
_folders: dict[str, str] = {}
#: Tables written by :func:`settled` in this process.
_written: dict[str, SparkSession] = {}


def hierarchy(edges: DataFrame) -> DataFrame:
    """Edges that imply membership."""
    return edges.where(F.col("relation") == HIERARCHY).select("parent", "child").distinct()


def _walk(edges: list[tuple], roots: list) -> list[tuple] | None:
    """Pairs of a closure in memory; None once there are more than ``PAIRS``."""
    below: dict = {}
    for parent, child in edges:
        below.setdefault(parent, []).append(child)
    out: list[tuple] = []
    for root in roots:
        seen, open_ = {root}, [root]
        while open_:
            new = [c for c in below.get(open_.pop(), ()) if c not in seen]
            seen.update(new)
            open_ += dict.fromkeys(new)
        out += [(root, tag) for tag in seen]
        if len(out) > PAIRS:
            return None
    return out


def closure(edges: DataFrame, roots: DataFrame, small: int = SMALL) -> DataFrame:
    """``(root, tag)``: every root with itself and all tags below it.

    ``roots`` has one column ``root``. A taxonomy of at most ``small`` edges and
    roots, as counted while reading one row more than that, is walked on the
    driver. Any other grows by joins, a round for each level; each round joins
    what the last one found only and is settled, so that plans don't nest.
    """
    down, start = hierarchy(edges), roots.select("root").distinct()
    some, ends = down.limit(small + 1).collect(), start.limit(small + 1).collect()
    if len(some) <= small and len(ends) <= small:
        pairs = _walk([tuple(e) for e in some], [r[0] for r in ends])
        if pairs is not None:
            kind = roots.schema["root"].dataType.simpleString()
            return edges.sparkSession.createDataFrame(pairs, f"root {kind}, tag {kind}")
    down = settled(down)
    new = reached = settled(start.select("root", F.col("root").alias("tag")))
    while True:  # pairs are new in each round, so a cycle ends too
        step = new.join(down, new["tag"] == down["parent"]).select("root", F.col("child").alias("tag")).distinct()
        new = settled(step.join(reached, ["root", "tag"], "left_anti"))
        if new.isEmpty():
            return reached
        reached = reached.union(new)


def settled(df: DataFrame) -> DataFrame:
    """``df`` as Parquet in the folder of checkpoints, so that neither plan nor lineage grows and later steps read only the columns they need.

    A local session without such a folder gets a temporary one; a cluster needs
    one. The files go when the driver ends.
    """
    spark = df.sparkSession
    folder, context = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("start the application with spark.checkpoint.dir naming a folder that the driver and all executors share")
        folder = _folders.setdefault(context.applicationId, "") or "file://" + tempfile.mkdtemp(prefix="lodeweave-")
        _folders[context.applicationId] = folder
    path = f"{folder}/settled-{uuid.uuid4().hex}"
    _written[path] = spark
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _drop_written() -> None:
    with contextlib.suppress(Exception):  # the session may have ended before
        for path, spark in _written.items():
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def descendants(edges: DataFrame, tags) -> DataFrame:
    """``(root, tag)`` of the given tag ids."""
    roots = edges.sparkSession.createDataFrame([(t,) for t in dict.fromkeys(tags)], "root string")
    return closure(edges, roots)


def ancestors(edges: DataFrame, tags: DataFrame) -> DataFrame:
    """``(root, tag)``: every tag of ``tags(root)`` with itself and all tags above it."""
    return closure(edges.select(F.col("child").alias("parent"), F.col("parent").alias("child"), "relation"), tags)


def chapters(edges: DataFrame, tags: DataFrame) -> DataFrame:
    """``(tag, chapter)``: the topmost tags above each tag of ``tags(root)``."""
    up = ancestors(edges, tags)
    children = hierarchy(edges).select(F.col("child").alias("tag"))
    return up.join(children, "tag", "left_anti").select(F.col("root").alias("tag"), F.col("tag").alias("chapter"))


def unsorted_rest(edges: DataFrame) -> DataFrame:
    """Nodes that no round of taking away parentless nodes removes; some if and only if there is a cycle."""
    left = hierarchy(edges).cache()
    count = left.count()
    while True:
        left = settled(left.join(left.select(F.col("child").alias("parent")).distinct(), "parent", "left_semi"))
        now = left.count()
        if now == count or now == 0:
            return left.select(F.col("parent").alias("tag")).union(left.select("child")).distinct()
        count = now


def invalid_relations(edges: DataFrame, tags: DataFrame) -> DataFrame:
    """Edges with a reason not to accept them: to itself, an unknown end, or stated twice."""
    known = tags.select("tag_id")
    twice = F.count("*").over(Window.partitionBy("parent", "child", "relation"))
    checked = edges.withColumn("_n", twice).join(known.withColumn("_p", F.lit(True)), F.col("parent") == F.col("tag_id"), "left").drop("tag_id").join(known.withColumn("_c", F.lit(True)), F.col("child") == F.col("tag_id"), "left")
    reason = F.when(F.col("parent") == F.col("child"), "self").when(F.col("_p").isNull() | F.col("_c").isNull(), "unknown").when(F.col("_n") > 1, "twice")
    return checked.select("parent", "child", "relation", reason.alias("reason")).where("reason is not null")


def tag_counts(rows: DataFrame, assignments: DataFrame, edges: DataFrame, tags: DataFrame) -> DataFrame:
    """Distinct publications in each tag's subtree, and its own links; tags with an empty subtree are left out."""
    confirmed = assignments.where("not needs_review").join(rows.select(F.col("id").alias("publication_id")), "publication_id", "left_semi").select("publication_id", "tag_id").distinct()
    under = closure(edges, tags.select(F.col("tag_id").alias("root")))
    counted = under.join(confirmed, under["tag"] == confirmed["tag_id"]).groupBy("root").agg(F.countDistinct("publication_id").alias("count"), F.countDistinct(F.when(F.col("root") == F.col("tag"), F.col("publication_id"))).alias("direct_count"))
    return counted.join(tags.select(F.col("tag_id").alias("root"), "name", "kind"), "root").withColumnRenamed("root", "tag_id")


def visible_graph(edges: DataFrame, tags: DataFrame, assignments: DataFrame, q: str) -> DataFrame:
    """Tags that a search for ``q`` shows: matches with links below, and everything above them."""
    found = tags.where(F.contains("name", F.lit(q.lower()))).select(F.col("tag_id").alias("root"))
    filled = closure(edges, found).join(assignments.select(F.col("tag_id").alias("tag")), "tag", "left_semi").select("root").distinct()
    return ancestors(edges, filled).select("tag").distinct()


def paths(edges: DataFrame, tags: DataFrame, steps: int = 4) -> DataFrame:
    """``(tag_id, path)``: names up to ``steps`` levels above, by the smallest parent each time."""
    parent = hierarchy(edges).groupBy(F.col("child").alias("at")).agg(F.min("parent").alias("up"))
    names = tags.select(F.col("tag_id").alias("at"), F.col("name").alias("_n"))
    out = tags.select("tag_id", F.col("tag_id").alias("at"), F.array("name").alias("names"))
    for _ in range(steps - 1):
        out = out.join(parent, "at", "left").select("tag_id", F.col("up").alias("at"), "names").join(names, "at", "left").select("tag_id", "at", F.when(F.col("_n").isNotNull(), F.concat(F.array("_n"), "names")).otherwise(F.col("names")).alias("names"))
    return out.select("tag_id", F.array_join("names", " / ").alias("path"))


def merge_tags(assignments: DataFrame, edges: DataFrame, sources: tuple[str, ...], target: str) -> tuple[DataFrame, DataFrame]:
    """Redirects links and edges from ``sources`` to ``target``.

    Links of one publication fall together: a link counts as pending only if no
    merged link is confirmed. Edges between merged tags and repeats go.
    """
    to = lambda c: F.when(F.col(c).isin(list(sources)), F.lit(target)).otherwise(F.col(c))
    links = assignments.select("publication_id", to("tag_id").alias("tag_id"), "needs_review").groupBy("publication_id", "tag_id").agg(F.bool_and("needs_review").alias("needs_review"), F.count("*").alias("merged"))
    moved = edges.select(to("parent").alias("parent"), to("child").alias("child"), "relation").where("parent <> child").distinct()
    return links, moved


def impact(assignments: DataFrame, edges: DataFrame, pubs: DataFrame, tags: tuple[str, ...]) -> DataFrame:
    """What a change of ``tags`` touches: subtree tags, edges, links, live and historic publications."""
    under = descendants(edges, tags).select("tag").distinct()
    links = assignments.join(under, assignments["tag_id"] == under["tag"], "left_semi")
    touched = links.join(pubs, links["publication_id"] == pubs["id"])
    near = edges.where(F.col("parent").isin(list(tags)) | F.col("child").isin(list(tags)))
    one = under.agg(F.count("*").alias("tags")).crossJoin(near.agg(F.count("*").alias("edges"))).crossJoin(links.agg(F.count("*").alias("links")))  # one row each
    return one.crossJoin(touched.agg(F.countDistinct(F.when(F.col("status") == "published", F.col("id"))).alias("live"), F.countDistinct(F.when(F.col("status") != "published", F.col("id"))).alias("historic")))


def broken_references(proposals: DataFrame, tags: DataFrame) -> DataFrame:
    """Proposals that name tags which are not active: ``(proposal_id, broken)``."""
    named = proposals.select("proposal_id", F.explode("tag_ids").alias("tag_id"))
    gone = named.join(tags.where("active").select("tag_id"), "tag_id", "left_anti")
    return gone.groupBy("proposal_id").agg(F.array_sort(F.collect_set("tag_id")).alias("broken"))


def name_candidates(tags: DataFrame, names: DataFrame) -> DataFrame:
    """For each asked name and kind the tag of that folded name, an active one first, then the smallest id."""
    fold = lambda c: F.lower(F.regexp_replace(F.col(c), r"\s", ""))
    known = tags.select("tag_id", F.col("kind"), "active", fold("name").alias("_f"))
    asked = names.select("asked", "kind", fold("asked").alias("_f"))
    best = Window.partitionBy("asked", "kind").orderBy(F.desc("active"), "tag_id")
    return asked.join(known, ["kind", "_f"]).withColumn("_r", F.row_number().over(best)).where("_r = 1").select("asked", "kind", "tag_id", "active")


def layers(edges: DataFrame) -> DataFrame:
    """Depth of each tag (longest way from a root) and its place in the layer, by the mean place of its parents as laid out.

    Each round takes the tags all of whose parents are placed, so there are as
    many as layers. Tags in or below a cycle are never free: they stand in the
    first layer. Equal means and tags without a parent go by id.
    """
    down = settled(hierarchy(edges))
    nodes = down.select(F.col("parent").alias("tag")).union(down.select("child")).distinct()
    wanted = down.groupBy(F.col("child").alias("tag")).agg(F.count("*").alias("parents"))
    new = settled(nodes.join(wanted, "tag", "left_anti").withColumn("depth", F.lit(0)))
    done = new
    while True:
        met = down.join(done.select(F.col("tag").alias("parent")), "parent", "left_semi").groupBy(F.col("child").alias("tag")).agg(F.count("*").alias("met"))
        free = wanted.join(met, "tag").where("met = parents").join(done, "tag", "left_anti")
        new = settled(free.select("tag", (F.lit(1) + done.agg(F.max("depth")).first()[0]).alias("depth"))) if not done.isEmpty() else done
        if new.isEmpty():
            break
        done = settled(done.unionByName(new))
    depths = settled(nodes.join(done, "tag", "left").select("tag", F.coalesce("depth", F.lit(0)).alias("depth")))
    order = lambda *by: F.row_number().over(Window.partitionBy("depth").orderBy(*by))
    placed = settled(depths.where("depth = 0").withColumn("place", order("tag")))
    for depth in range(1, (depths.agg(F.max("depth")).first()[0] or 0) + 1):
        means = down.join(placed.select(F.col("tag").alias("parent"), "place"), "parent").groupBy(F.col("child").alias("tag")).agg(F.avg("place").alias("mean"))
        layer = depths.where(F.col("depth") == depth).join(means, "tag", "left").withColumn("place", order(F.col("mean").asc_nulls_last(), "tag"))
        placed = settled(placed.unionByName(layer.select("tag", "depth", "place")))
    return placed
