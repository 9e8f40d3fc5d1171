"""Queries over sources, signatures, streams and placement."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.operators import graph, placement, quality
from lattica.plans import roles
from lattica.plans.queries_sequences import WHOLE_SQL
from lattica.plans.queries_statistics import FRAMES_SQL, frames
from lattica.plans.registry import Tables, query
from lattica.plans.roles import BEADS_SQL, BOX, EDGES_SQL, KEYS, components_sql
from lattica.session import materialise, shared_folder
from lattica.sources import tables as sources
from lattica.streaming import incremental, monitor

K = "system:s replicate:s frame:i"

SIGNATURE_SQL = """
current AS (SELECT doc_id, sha256('{"version":"v2","source":"' || source || '","n_chars":' || CAST(n_chars AS VARCHAR) || ',"digest":"' || sha256(text) || '"}') AS signature FROM documents),
stored AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'old' ELSE signature END AS signature FROM current WHERE doc_id % 7 <> 0),
"""


@query("i1_changed_signatures", "doc_id:i signature:s", "SELECT c.* FROM current c LEFT JOIN stored s USING (doc_id, signature) WHERE s.doc_id IS NULL", SIGNATURE_SQL)
def i1_changed_signatures(t: Tables) -> DataFrame:
    """Keys whose stored signature is missing or differs."""
    docs = t.documents.select("doc_id", "source", "n_chars", F.sha2("text", 256).alias("digest"))
    now = incremental.signatures(docs, ["source", "n_chars", "digest"], "v2", ["doc_id"])
    stored = now.where("doc_id % 7 <> 0").withColumn("signature", F.when(F.col("doc_id") % 4 == 0, "old").otherwise(F.col("signature")))
    return incremental.changed(now, stored, ["doc_id"])


@query(
    "i2_health_stream",
    "task_id:s step:i temperature_k:f threshold_k:f",
    "SELECT CAST(user_id AS VARCHAR) AS task_id, event_id AS step, value AS temperature_k, 200.0 AS threshold_k FROM events WHERE value > 200 OR value IS NULL",
)
def i2_health_stream(t: Tables) -> DataFrame:
    """The health monitor as a stream over arriving files, run until the folder is exhausted."""
    spark = t.spark
    ddl = spark.read.parquet(f"{t.folder}/events.parquet").schema
    reports = (
        spark.readStream.schema(ddl).option("pathGlobFilter", "events.parquet").parquet(t.folder).selectExpr(
            "CAST(user_id AS STRING) AS task_id", "event_id AS step", "value AS potential_kj_mol", "value AS kinetic_kj_mol", "value AS temperature_k"
        )
    )
    out = os.path.join(shared_folder(spark), f"alerts-{uuid.uuid4().hex}")
    job = monitor.alerts(reports, 200.0).writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-state").trigger(availableNow=True).start()
    job.awaitTermination()
    return spark.read.parquet(out)


@query(
    "v10_digest_mismatches",
    "path:s reason:s",
    "SELECT CAST(page_id AS VARCHAR) AS path, CASE WHEN page_id % 11 = 0 THEN 'missing' ELSE 'mismatch' END AS reason FROM pages WHERE page_id % 5 = 0 OR page_id % 11 = 0",
)
def v10_digest_mismatches(t: Tables) -> DataFrame:
    """Listed digests against those of the contents."""
    p = t.pages.withColumn("path", F.col("page_id").cast("string"))
    listed = p.select("path", F.sha2(F.when(F.col("page_id") % 5 == 0, F.col("url")).otherwise(F.col("html")), 256).alias("sha256"))
    actual = p.where("page_id % 11 <> 0").select("path", F.sha2("html", 256).alias("sha256"))
    return quality.digest_mismatches(listed, actual)


@query(
    "s6_stored_indices",
    "system:s replicate:s frame:i stored_index:i",
    """SELECT d.system, d.replicate, g.frame, i.stored_index FROM (SELECT DISTINCT system, replicate FROM frames) d CROSS JOIN (SELECT UNNEST(RANGE(1, 721, 4)) AS frame) g
       LEFT JOIN (SELECT system, replicate, frame, ROW_NUMBER() OVER (PARTITION BY system, replicate ORDER BY frame) - 1 AS stored_index FROM frames) i USING (system, replicate, frame)""",
    FRAMES_SQL,
)
def s6_stored_indices(t: Tables) -> DataFrame:
    """Original frame to stored index through the selected-frame map of every trajectory."""
    # A frame map lists at most the frames of the grid, so it is one bounded array per trajectory.
    maps = frames(t).groupBy("system", "replicate").agg(F.array_sort(F.collect_set("frame")).alias("source_frames_one_based"))
    return sources.stored_indices(maps, range(1, 721, 4))


@query(
    "v12_design_counts",
    "l_orderkey:i expected:i observed:i",
    """SELECT o_orderkey AS l_orderkey, 4 AS expected, COALESCE(n, 0) AS observed FROM orders LEFT JOIN (SELECT l_orderkey, COUNT(*) AS n FROM lineitem GROUP BY ALL) ON o_orderkey = l_orderkey
       WHERE COALESCE(n, 0) <> 4""",
)
def v12_design_counts(t: Tables) -> DataFrame:
    """Groups whose number of rows differs from the design."""
    n = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("observed"))
    design = t.orders.selectExpr("o_orderkey AS l_orderkey", "4 AS expected")
    return design.join(n, "l_orderkey", "left").fillna({"observed": 0}).where("observed <> expected")


G15_SQL = (
    EDGES_SQL
    + WHOLE_SQL.removeprefix(BEADS_SQL)
    + """
anc AS (SELECT system, replicate, frame, lo, hi, bl, bh FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY frame, lo, hi ORDER BY d, bl, bh) AS k FROM (
   SELECT system, replicate, frame, LEAST(molecule_i, molecule_j) AS lo, GREATEST(molecule_i, molecule_j) AS hi, d,
     CASE WHEN molecule_i > molecule_j THEN j ELSE i END AS bl, CASE WHEN molecule_i > molecule_j THEN i ELSE j END AS bh FROM pairs WHERE d < 1.2 AND molecule_i <> molecule_j)) WHERE k = 1),
steps AS MATERIALIZED (SELECT a.system, a.replicate, a.frame, a.lo, a.hi, """
    + ", ".join(f"CAST(ROUND_EVEN((h.u{a} - l.u{a}) / CAST(20.0 AS DOUBLE), 0) AS INT) AS s{a}" for a in "xyz")
    + """ FROM anc a JOIN whole l ON l.frame = a.frame AND l.bead = a.bl JOIN whole h ON h.frame = a.frame AND h.bead = a.bh),
"""
    + components_sql("steps", "nodes", "scomp")
    + """
walk AS MATERIALIZED (SELECT frame, lo AS a, hi AS b, sx, sy, sz FROM steps UNION ALL SELECT frame, hi, lo, -sx, -sy, -sz FROM steps),
lev(frame, node, l) USING KEY (frame, node) AS (SELECT frame, node, 0 FROM scomp WHERE node = label
   UNION SELECT w.frame, w.b, MIN(v.l) + 1 FROM lev v JOIN walk w ON w.frame = v.frame AND w.a = v.node
     LEFT JOIN recurring.lev k ON k.frame = w.frame AND k.node = w.b WHERE k.node IS NULL GROUP BY ALL),
near AS MATERIALIZED (SELECT frame, node, l FROM lev),
par AS MATERIALIZED (SELECT w.frame, w.b AS node, MIN(w.a) AS a FROM walk w JOIN near x ON x.frame = w.frame AND x.node = w.a JOIN near y ON y.frame = w.frame AND y.node = w.b
   WHERE x.l = y.l - 1 GROUP BY ALL),
placed AS (SELECT frame, node, 0 AS nx, 0 AS ny, 0 AS nz FROM near WHERE l = 0
   UNION ALL SELECT p.frame, p.node, q.nx - w.sx, q.ny - w.sy, q.nz - w.sz FROM placed q JOIN par p ON p.frame = q.frame AND p.a = q.node
     JOIN walk w ON w.frame = p.frame AND w.a = p.a AND w.b = p.node),
"""
)


@query(
    "g15_component_placement",
    f"{K} broken:i contacts:i",
    """SELECT s.system, s.replicate, s.frame, COUNT(*) FILTER (NOT (h.nx + s.sx = l.nx AND h.ny + s.sy = l.ny AND h.nz + s.sz = l.nz)) AS broken, COUNT(*) AS contacts
       FROM steps s JOIN placed l ON l.frame = s.frame AND l.node = s.lo JOIN placed h ON h.frame = s.frame AND h.node = s.hi GROUP BY ALL""",
    G15_SQL,
)
def g15_component_placement(t: Tables) -> DataFrame:
    """Chains moved next to their contact partners; contacts that still cross the box are counted."""
    centres, steps = _steps(t)
    placed = materialise(placement.placed_components(steps, centres, KEYS), "placed")
    return placement.broken_contacts(steps, placed.drop("label"), KEYS)


def _steps(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Centres of whole chains, and image steps of their contacts."""
    p = roles.stored_pairs(t)
    sizes = roles.frame_sizes(t).unionByName(p.groupBy(*KEYS).agg(F.count("*").alias("n"))).groupBy(*KEYS).agg(F.sum("n").alias("n"))
    return placement.chain_steps(roles.beads(t), graph.contact_anchors(p, KEYS), KEYS, "molecule", "bead", BOX, sizes)


@query(
    "g15_component_shifts",
    f"{K} label:i nodes:i bx:i by:i bz:i",
    """SELECT p.system, p.replicate, p.frame, label, nodes, """
    + ", ".join(f"CAST(-FLOOR((p.{a} - r.{a}) / 20.0 + 0.5) AS INT) AS b{a}" for a in "xyz")
    + """ FROM parts p JOIN ref r USING (frame)""",
    G15_SQL
    + """
mid AS (SELECT frame, molecule AS node, AVG(ux) AS x, AVG(uy) AS y, AVG(uz) AS z FROM whole GROUP BY ALL),
parts AS MATERIALIZED (SELECT c.system, c.replicate, c.frame, c.label, COUNT(*) AS nodes, AVG(m.x + 20.0 * p.nx) AS x, AVG(m.y + 20.0 * p.ny) AS y, AVG(m.z + 20.0 * p.nz) AS z
   FROM scomp c JOIN placed p USING (frame, node) JOIN mid m USING (frame, node) GROUP BY ALL),
ref AS (SELECT frame, x, y, z FROM parts QUALIFY ROW_NUMBER() OVER (PARTITION BY frame ORDER BY nodes DESC, label) = 1),
""",
)
def g15_component_shifts(t: Tables) -> DataFrame:
    """Whole components moved to the image nearest the centre of the largest one."""
    centres, steps = _steps(t)
    placed = placement.placed_components(steps, centres, KEYS, "xyz")
    moved = placed.selectExpr(*KEYS, "node", "label", *[f"{a} + {BOX!r}D * n{a} AS {a}" for a in "xyz"])
    return placement.component_shifts(moved, None, KEYS, BOX)


@query("g15_contact_count", f"{K} contacts:i", "SELECT system, replicate, frame, COUNT(*) AS contacts FROM edges GROUP BY ALL", EDGES_SQL)
def g15_contact_count(t: Tables) -> DataFrame:
    """Every contact of the graph has one anchor pair of beads and thereby one placement step."""
    b = roles.beads(t).select(*KEYS, "bead", F.col("x").alias("ux"), F.col("y").alias("uy"), F.col("z").alias("uz"))
    steps = placement.image_steps(graph.contact_anchors(roles.stored_pairs(t), KEYS), b, KEYS, BOX)
    return steps.groupBy(*KEYS).agg(F.count("*").alias("contacts"))
