"""How the given tables play the parts of a trajectory data set, in DataFrame form and as the same SQL.

Line items are particles of a periodic box with edge ``BOX``: a supplier is a frame, a part picks the molecule. Every
row of the table becomes one particle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.operators import graph, spatial
from lattica.plans.registry import Tables
from lattica.session import materialise

BOX = 20.0
KEYS = ["system", "replicate", "frame"]
CUTOFFS = [1.0, 1.2, 1.4]
PRIMARY = 1.2
CUTS = [50, 100, 150]
MED1_RESIDUES, OCT4_RESIDUES, DNA_BEADS = 200, 60, 80


def beads(t: Tables) -> DataFrame:
    """The positions of one query, derived in the plan from the line items, all of a frame in one partition.

    One exchange by frame, of the five columns that everything else is derived from; what follows by frame, or by frame and
    molecule, finds its rows together. A plan that reads the positions several times reuses it.
    """
    if "_positions" not in t.__dict__:
        narrow = t.lineitem.select("l_suppkey", "l_partkey", "l_linenumber", "l_orderkey", "l_extendedprice")
        t._positions = _derived_beads(narrow.repartition("l_suppkey"))
    return t._positions


def frame_sizes(t: Tables) -> DataFrame:
    """Particles of every frame, counted before any exchange."""
    return t.lineitem.where("l_suppkey IS NOT NULL").groupBy(F.col("l_suppkey").alias("frame")).agg(F.count("*").alias("n")).selectExpr(*trajectory("frame"), "frame", "n")


def trajectory(frame: str) -> list[str]:
    """System and replicate follow from the frame."""
    return [f"concat('S', CAST({frame} % 4 AS STRING)) AS system", f"concat('R', CAST(({frame} div 4) % 3 AS STRING)) AS replicate"]


def _derived_beads(items: DataFrame) -> DataFrame:
    """One particle per line item: coordinates, molecule, species, residue, parent chain and fixed block."""
    out = items.selectExpr(
        *trajectory("l_suppkey"),
        "l_suppkey AS frame",
        "(l_partkey * 8 + l_linenumber) * 4294967296 + l_orderkey AS bead",
        "l_extendedprice * 0.0137D AS x",
        "l_orderkey * 0.7310585D AS y",
        "l_partkey * 1.6180339D + l_linenumber * 2.7182818D AS z",
        "if(l_partkey % 15 = 0, 0L, l_partkey % 150) AS molecule",
        "l_orderkey AS o",
    ).selectExpr(
        "system", "replicate", "frame", "bead", *[f"{a} - {BOX}D * floor({a} / {BOX}D) AS {a}" for a in "xyz"], "molecule", "o",
        "CASE WHEN molecule = 0 THEN 'DNA' WHEN molecule % 5 = 1 THEN 'MED1' ELSE 'OCT4' END AS species",
    )
    out = out.selectExpr(
        "system", "replicate", "frame", "bead", "x", "y", "z", "molecule", "species",
        "CASE WHEN species = 'MED1' THEN ((molecule div 5) % 2) * 100 + o % 100 "
        f"WHEN species = 'OCT4' THEN o % {OCT4_RESIDUES} ELSE o % {DNA_BEADS} END AS residue",
        "CASE WHEN species = 'MED1' THEN molecule div 10 WHEN species = 'OCT4' THEN 1000 + molecule ELSE -1L END AS parent",
    )
    block = (
        F.when(F.col("species") == "MED1", graph.block_key("parent", "residue", CUTS))
        .when(F.col("species") == "OCT4", 10000 + F.col("molecule"))
        .otherwise(-1)
    )
    return out.withColumn("block", block.cast("long"))


BEADS_SQL = """
beads AS (
  SELECT *, CASE WHEN species = 'MED1' THEN parent * 4 + (CASE WHEN residue >= 50 THEN 1 ELSE 0 END)
                      + (CASE WHEN residue >= 100 THEN 1 ELSE 0 END) + (CASE WHEN residue >= 150 THEN 1 ELSE 0 END)
                 WHEN species = 'OCT4' THEN 10000 + molecule ELSE -1 END AS block
  FROM (
    SELECT *, CASE WHEN species = 'MED1' THEN ((molecule // 5) % 2) * 100 + o % 100
                   WHEN species = 'OCT4' THEN o % 60 ELSE o % 80 END AS residue,
              CASE WHEN species = 'MED1' THEN molecule // 10 WHEN species = 'OCT4' THEN 1000 + molecule ELSE -1 END AS parent
    FROM (
      SELECT *, CASE WHEN molecule = 0 THEN 'DNA' WHEN molecule % 5 = 1 THEN 'MED1' ELSE 'OCT4' END AS species
      FROM (
        SELECT 'S' || CAST(l_suppkey % 4 AS VARCHAR) AS system, 'R' || CAST((l_suppkey // 4) % 3 AS VARCHAR) AS replicate,
               l_suppkey AS frame, (l_partkey * 8 + l_linenumber) * 4294967296 + l_orderkey AS bead,
               l_extendedprice * CAST(0.0137 AS DOUBLE) - 20.0 * FLOOR(l_extendedprice * CAST(0.0137 AS DOUBLE) / CAST(20.0 AS DOUBLE)) AS x,
               l_orderkey * CAST(0.7310585 AS DOUBLE) - 20.0 * FLOOR(l_orderkey * CAST(0.7310585 AS DOUBLE) / CAST(20.0 AS DOUBLE)) AS y,
               (l_partkey * CAST(1.6180339 AS DOUBLE) + l_linenumber * CAST(2.7182818 AS DOUBLE))
                 - 20.0 * FLOOR((l_partkey * CAST(1.6180339 AS DOUBLE) + l_linenumber * CAST(2.7182818 AS DOUBLE)) / CAST(20.0 AS DOUBLE)) AS z,
               CASE WHEN l_partkey % 15 = 0 THEN 0 ELSE l_partkey % 150 END AS molecule, l_orderkey AS o
        FROM lineitem)))),
"""

CARRY = ["molecule", "species", "parent", "block", "residue"]


_CONTACTS: dict[tuple[str, str], tuple[str, DataFrame]] = {}


def _listing(spark: SparkSession, path: str) -> str:
    """Names, sizes and times of a table's files; empty if it doesn't exist."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return "\n".join(f"{f.getPath().toString()} {f.getLen()} {f.getModificationTime()}" for f in files.listStatus(at)) if files.exists(at) else ""


def contacts(t: Tables) -> DataFrame:
    """All bead pairs at the largest cutoff, with the attributes of both beads: searched once for a session and the files of a
    folder's line items, written to the shared folder, and read by every contact query. Changed files, or a stored table
    that is gone, lead to a new search."""
    at = (t.spark.sparkContext.applicationId, t.folder)
    files = _listing(t.spark, f"{t.folder}/lineitem.parquet")
    known = _CONTACTS.get(at)
    if known is None or known[0] != files or not _listing(t.spark, known[1].stored_path):
        _CONTACTS[at] = (files, materialise(spatial.radius_pairs(beads(t), KEYS, BOX, max(CUTOFFS), carry=CARRY, sizes=frame_sizes(t), clustered=True), "contacts"))
    return _CONTACTS[at][1]


def stored_pairs(t: Tables) -> DataFrame:
    """Contacts at the primary cutoff."""
    return pairs(t, PRIMARY).where(F.col("d") < PRIMARY)


def pairs(t: Tables, radius: float = max(CUTOFFS)) -> DataFrame:
    """Bead pairs within ``radius``, with the attributes of both beads."""
    return contacts(t).where(F.col("d") <= radius)


PAIRS_SQL = (
    BEADS_SQL
    + """
pairs AS MATERIALIZED (
  SELECT * FROM (
    SELECT a.system, a.replicate, a.frame, a.bead AS i, b.bead AS j,
      SQRT(POWER(a.x - b.x - 20.0 * ROUND_EVEN(CAST((a.x - b.x) / 20.0 AS DOUBLE), 0), 2) + POWER(a.y - b.y - 20.0 * ROUND_EVEN(CAST((a.y - b.y) / 20.0 AS DOUBLE), 0), 2)
         + POWER(a.z - b.z - 20.0 * ROUND_EVEN(CAST((a.z - b.z) / 20.0 AS DOUBLE), 0), 2)) AS d,
      a.molecule AS molecule_i, b.molecule AS molecule_j, a.species AS species_i, b.species AS species_j,
      a.parent AS parent_i, b.parent AS parent_j, a.block AS block_i, b.block AS block_j, a.residue AS residue_i, b.residue AS residue_j
    FROM beads a JOIN beads b ON a.frame = b.frame AND a.bead < b.bead
    WHERE ABS(a.x - b.x - 20.0 * ROUND_EVEN(CAST((a.x - b.x) / 20.0 AS DOUBLE), 0)) <= 1.4
      AND ABS(a.y - b.y - 20.0 * ROUND_EVEN(CAST((a.y - b.y) / 20.0 AS DOUBLE), 0)) <= 1.4)
  WHERE d <= 1.4),
"""
)


def nodes(t: Tables) -> DataFrame:
    """Molecules of every frame: id, species, parent and length in beads."""
    return (
        beads(t)
        .groupBy(*KEYS, F.col("molecule").alias("node"), "species", "parent")  # both follow from the molecule
        .agg(F.count("*").alias("length"))
    )


NODES_SQL = """
nodes AS (SELECT system, replicate, frame, molecule AS node, ANY_VALUE(species) AS species, ANY_VALUE(parent) AS parent, COUNT(*) AS length
          FROM beads GROUP BY ALL),
"""


def edges(t: Tables, source: DataFrame | None = None) -> DataFrame:
    """Molecule contacts at the primary cutoff."""
    p = (source if source is not None else pairs(t, PRIMARY)).where(F.col("d") < PRIMARY)
    return graph.node_pairs(p, KEYS, "molecule_i", "molecule_j")


EDGES_SQL = (
    PAIRS_SQL
    + NODES_SQL
    + """
edges AS MATERIALIZED (SELECT DISTINCT system, replicate, frame, LEAST(molecule_i, molecule_j) AS lo, GREATEST(molecule_i, molecule_j) AS hi
          FROM pairs WHERE d < 1.2 AND molecule_i <> molecule_j),
"""
)


def components_sql(edge: str, node: str, out: str, keys: str = "system, replicate, frame") -> str:
    """SQL for components by reachability: the label of a node is the smallest node it reaches."""
    ks = [k.strip() for k in keys.split(",")]
    on = " AND ".join(f"r.{k} = b.{k}" for k in ks)
    return f"""
{out}_both AS MATERIALIZED (SELECT {keys}, lo AS u, hi AS v FROM {edge} UNION ALL SELECT {keys}, hi, lo FROM {edge}),
{out}_reach AS (SELECT {keys}, node, node AS r FROM {node}
  UNION SELECT {", ".join("b." + k for k in ks)}, b.v, r.r FROM {out}_reach r JOIN {out}_both b ON {on} AND r.node = b.u WHERE r.r < b.v),
{out}_lab AS (SELECT {keys}, node, MIN(r) AS label FROM {out}_reach GROUP BY ALL),
{out} AS MATERIALIZED (SELECT n.*, l.label FROM {node} n JOIN {out}_lab l USING ({keys}, node)),
"""
