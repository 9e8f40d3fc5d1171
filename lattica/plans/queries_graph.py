"""Queries over contacts and contact graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.constants import MASK_BOUNDARIES
from lattica.functions.scalars import base_pair_index, int_div, odds_ratio, ratio
from lattica.operators import graph, quality, spatial, statistics
from lattica.plans import roles
from lattica.plans.registry import Tables, query
from lattica.session import materialise
from lattica.plans.roles import BEADS_SQL, BOX, CUTOFFS, EDGES_SQL, KEYS, NODES_SQL, PAIRS_SQL, components_sql

K = "system:s replicate:s frame:i"
KEY_SQL = "system, replicate, frame"


@query("j1_periodic_pairs", f"{K} i:i j:i d:f", "SELECT * FROM pairs", PAIRS_SQL)
def j1_periodic_pairs(t: Tables) -> DataFrame:
    """Every particle pair within the largest cutoff, minimum image."""
    return roles.pairs(t)


@query(
    "j2_primary_pairs", f"{K} bead_pairs:i mean_d:f", f"SELECT {KEY_SQL}, COUNT(*) AS bead_pairs, AVG(d) AS mean_d FROM pairs WHERE d < 1.2 GROUP BY ALL", PAIRS_SQL
)
def j2_primary_pairs(t: Tables) -> DataFrame:
    """The search at the primary cutoff, strictly below it."""
    p = spatial.radius_pairs(roles.beads(t), KEYS, BOX, roles.PRIMARY, strict=True, sizes=roles.frame_sizes(t), clustered=True)
    return p.groupBy(*KEYS).agg(F.count("*").alias("bead_pairs"), F.avg("d").alias("mean_d"))


def _lcc(t: Tables) -> DataFrame:
    edges = graph.levelled_pairs(roles.pairs(t), KEYS, "molecule_i", "molecule_j", CUTOFFS)
    return graph.cluster_metrics(graph.components_by_cutoff(edges, roles.nodes(t), KEYS, CUTOFFS), [*KEYS, "cutoff_nm"])


CLUSTER_SQL = (
    PAIRS_SQL
    + NODES_SQL
    + """
cut AS (SELECT UNNEST([1.0, 1.2, 1.4])::DOUBLE AS cutoff_nm),
pnodes AS MATERIALIZED (SELECT nodes.*, cutoff_nm FROM nodes CROSS JOIN cut WHERE species <> 'DNA'),
pedges AS MATERIALIZED (SELECT DISTINCT system, replicate, frame, cutoff_nm, LEAST(molecule_i, molecule_j) AS lo, GREATEST(molecule_i, molecule_j) AS hi
           FROM pairs JOIN cut ON d < cutoff_nm WHERE molecule_i <> molecule_j AND species_i <> 'DNA' AND species_j <> 'DNA'),
"""
    + components_sql("pedges", "pnodes", "comp", "system, replicate, frame, cutoff_nm")
    + """
sizes AS (SELECT system, replicate, frame, cutoff_nm, label, COUNT(*) AS size, SUM(length) AS weight FROM comp GROUP BY ALL),
ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY system, replicate, frame, cutoff_nm ORDER BY size DESC, label) AS rk FROM sizes),
clusters AS (SELECT system, replicate, frame, cutoff_nm,
   MAX(size) AS largest_cluster_size, MAX(size) / SUM(size) AS largest_cluster_fraction,
   SUM(CASE WHEN rk = 1 THEN weight END) / SUM(weight) AS largest_cluster_residue_fraction,
   COALESCE(MAX(CASE WHEN rk = 2 THEN size END), 0) AS second_cluster_size,
   COALESCE(MAX(CASE WHEN rk = 2 THEN size END), 0) / SUM(size) AS second_cluster_fraction,
   SUM(CASE WHEN rk > 1 THEN size * size END) / SUM(CASE WHEN rk > 1 THEN size END) AS finite_cluster_mean_size,
   SUM(CASE WHEN size >= 2 THEN 1 ELSE 0 END) AS n_clusters_size_ge_2,
   SUM(CASE WHEN size = 1 THEN 1 ELSE 0 END) / SUM(size) AS monomer_fraction
 FROM ranked GROUP BY ALL),
"""
)


@query(
    "g3_cluster_metrics",
    f"{K} cutoff_nm:f largest_cluster_size:i largest_cluster_fraction:f9 largest_cluster_residue_fraction:f9 second_cluster_size:i "
    "second_cluster_fraction:f9 finite_cluster_mean_size:f9 n_clusters_size_ge_2:i monomer_fraction:f9",
    "SELECT * FROM clusters",
    CLUSTER_SQL,
)
def g3_cluster_metrics(t: Tables) -> DataFrame:
    """Cluster metrics per frame and cutoff on the protein graph."""
    return _lcc(t)


@query(
    "largest_cluster_by_system",
    "system:s cutoff_nm:f largest_cluster_fraction_mean:f9 largest_cluster_fraction_sd:f9 largest_cluster_fraction_n:i",
    """SELECT system, cutoff_nm, AVG(v) AS largest_cluster_fraction_mean, STDDEV_SAMP(v) AS largest_cluster_fraction_sd,
              COUNT(v) AS largest_cluster_fraction_n
       FROM (SELECT system, replicate, cutoff_nm, AVG(largest_cluster_fraction) AS v FROM clusters GROUP BY ALL) GROUP BY ALL""",
    CLUSTER_SQL,
)
def largest_cluster_by_system(t: Tables) -> DataFrame:
    """J1, J5, G2, G3, A1, A2, A3 end to end: mean and SD over trajectories of the largest-cluster fraction."""
    repeat = statistics.trajectory_means(_lcc(t), ["system", "replicate", "cutoff_nm"], ["largest_cluster_fraction"])
    return statistics.two_level_stats(repeat, ["system", "cutoff_nm"], ["largest_cluster_fraction"])


# ------------------------------------------------------------------------------------ distance joins, projections


def _vectors(t: Tables) -> DataFrame:
    """Vectors as points in open space: the first three components, one frame per label."""
    return t.embeddings.selectExpr(
        "label AS frame", "vec_id AS bead", *[f"CAST(embedding[{k}] AS DOUBLE) * 40 AS {a}" for k, a in enumerate("xyz")]
    )


VECTORS_SQL = """
vectors AS (SELECT label AS frame, vec_id AS bead, CAST(embedding[1] AS DOUBLE) * 40 AS x, CAST(embedding[2] AS DOUBLE) * 40 AS y,
            CAST(embedding[3] AS DOUBLE) * 40 AS z FROM embeddings),
vpairs AS (SELECT a.frame, a.bead AS i, b.bead AS j, SQRT(POWER(a.x - b.x, 2) + POWER(a.y - b.y, 2) + POWER(a.z - b.z, 2)) AS d
           FROM vectors a JOIN vectors b ON a.frame = b.frame AND a.bead < b.bead),
"""


@query("j3_open_pairs", "frame:i i:i j:i d:f", "SELECT * FROM vpairs WHERE d <= 2.5", VECTORS_SQL)
def j3_open_pairs(t: Tables) -> DataFrame:
    """Fixed-radius pairs without periodic images."""
    return spatial.radius_pairs_open(_vectors(t), ["frame"], 2.5)


NEAREST_SQL = (
    BEADS_SQL
    + """
nearest AS MATERIALIZED (
  SELECT a.system, a.replicate, a.frame, a.bead, ANY_VALUE(a.species) AS species, ANY_VALUE(a.molecule) AS molecule, ANY_VALUE(a.parent) AS parent,
    MIN(SQRT(POWER(a.x - b.x - 20.0 * ROUND_EVEN(CAST((a.x - b.x) / 20.0 AS DOUBLE), 0), 2) + POWER(a.y - b.y - 20.0 * ROUND_EVEN(CAST((a.y - b.y) / 20.0 AS DOUBLE), 0), 2)
           + POWER(a.z - b.z - 20.0 * ROUND_EVEN(CAST((a.z - b.z) / 20.0 AS DOUBLE), 0), 2))) AS distance
  FROM beads a JOIN beads b ON a.frame = b.frame AND a.species <> 'DNA' AND b.species = 'DNA' GROUP BY ALL),
"""
)


def nearest(t: Tables) -> DataFrame:
    b = roles.beads(t)
    return spatial.nearest_target_distance(b, "species = 'DNA'", KEYS, BOX, carry=["species", "molecule", "parent"], clustered=True)


@query("j4_nearest_anchor", f"{K} bead:i distance:f", "SELECT * FROM nearest", NEAREST_SQL)
def j4_nearest_anchor(t: Tables) -> DataFrame:
    """Distance of every protein particle to the nearest anchor particle of its frame."""
    return nearest(t)


@query("j5_molecule_edges", f"{K} lo:i hi:i", "SELECT * FROM edges", EDGES_SQL)
def j5_molecule_edges(t: Tables) -> DataFrame:
    """Bead pairs lifted to molecule pairs through two lookups on a pair list without attributes."""
    b = roles.beads(t)
    bare = spatial.radius_pairs(b, KEYS, BOX, roles.PRIMARY, strict=True, sizes=roles.frame_sizes(t), clustered=True)
    return graph.node_pairs(graph.lift_pairs(bare, b, KEYS, ["molecule"]), KEYS, "molecule_i", "molecule_j")


@query(
    "j20_contact_anchors",
    f"{K} lo:i hi:i bead_lo:i bead_hi:i d:f",
    f"""SELECT {KEY_SQL}, lo, hi, ARG_MIN(bl, d) AS bead_lo, ARG_MIN(bh, d) AS bead_hi, MIN(d) AS d FROM (
        SELECT {KEY_SQL}, LEAST(molecule_i, molecule_j) AS lo, GREATEST(molecule_i, molecule_j) AS hi, d,
               CASE WHEN molecule_i > molecule_j THEN j ELSE i END AS bl, CASE WHEN molecule_i > molecule_j THEN i ELSE j END AS bh
        FROM pairs WHERE d < 1.2 AND molecule_i <> molecule_j) GROUP BY ALL""",
    PAIRS_SQL,
)
def j20_contact_anchors(t: Tables) -> DataFrame:
    """Closest bead pair of every molecule pair."""
    return graph.contact_anchors(roles.pairs(t, roles.PRIMARY).where("d < 1.2"), KEYS)


# --------------------------------------------------------------------------------------------------- components

COMP_SQL = EDGES_SQL + components_sql("edges", "nodes", "comp")


@query("g1_components", f"{K} node:i label:i", "SELECT * FROM comp", COMP_SQL)
def g1_components(t: Tables) -> DataFrame:
    """G1: components with isolated nodes."""
    return graph.connected_components(roles.edges(t), roles.nodes(t), KEYS)


@query("g1_components_star", f"{K} node:i label:i", "SELECT * FROM comp", COMP_SQL)
def g1_components_star(t: Tables) -> DataFrame:
    """G1 for graphs of any size: alternating star joins, every round written to the shared folder."""
    return graph.connected_components(roles.edges(t), roles.nodes(t), KEYS, method="star")


PROTEIN_SQL = (
    EDGES_SQL
    + """
pnodes AS MATERIALIZED (SELECT * FROM nodes WHERE species <> 'DNA'),
pedges AS MATERIALIZED (SELECT * FROM edges WHERE lo <> 0 AND hi <> 0),
"""
    + components_sql("pedges", "pnodes", "pcomp")
)


@query("g2_protein_components", f"{K} node:i label:i", "SELECT * FROM pcomp", PROTEIN_SQL)
def g2_protein_components(t: Tables) -> DataFrame:
    """Components of the protein graph; the anchor does not bridge proteins."""
    return graph.species_components(roles.edges(t), roles.nodes(t), KEYS)


@query(
    "g4_augmented_graph",
    f"{K} augmented_largest_protein_fraction:f DNA_component_MED1:i DNA_component_OCT4:i DNA_component_protein_fraction:f",
    f"""SELECT {KEY_SQL}, MAX(p) / SUM(p) AS augmented_largest_protein_fraction, SUM(CASE WHEN has THEN m END) AS DNA_component_MED1,
          SUM(CASE WHEN has THEN o END) AS DNA_component_OCT4, SUM(CASE WHEN has THEN p END) / SUM(p) AS DNA_component_protein_fraction
        FROM (SELECT {KEY_SQL}, label, COUNT(*) FILTER (species <> 'DNA') AS p, COUNT(*) FILTER (species = 'MED1') AS m,
                COUNT(*) FILTER (species = 'OCT4') AS o, BOOL_OR(species = 'DNA') AS has FROM comp GROUP BY ALL) GROUP BY {KEY_SQL}""",
    COMP_SQL,
)
def g4_augmented_graph(t: Tables) -> DataFrame:
    """The graph with the anchor: largest protein count of a component, and the anchor's component."""
    return graph.augmented_metrics(graph.connected_components(roles.edges(t), roles.nodes(t), KEYS), KEYS)


HOPS_SQL = (
    COMP_SQL
    + """
nbr AS MATERIALIZED (SELECT system, replicate, frame, lo AS u, hi AS v FROM edges UNION ALL SELECT system, replicate, frame, hi, lo FROM edges),
direct AS (SELECT DISTINCT frame, v AS node FROM nbr WHERE u = 0),
near AS (SELECT DISTINCT n.frame, n.v AS node FROM nbr n JOIN direct d ON n.frame = d.frame AND n.u = d.node),
anchor AS (SELECT frame, label FROM comp WHERE species = 'DNA'),
hops AS MATERIALIZED (SELECT c.*, CASE WHEN d.node IS NOT NULL THEN 'direct' WHEN s.node IS NOT NULL THEN 'second' ELSE 'third_plus' END AS hop
  FROM comp c JOIN anchor a ON c.frame = a.frame AND c.label = a.label
  LEFT JOIN direct d ON c.frame = d.frame AND c.node = d.node LEFT JOIN near s ON c.frame = s.frame AND c.node = s.node WHERE c.species <> 'DNA'),
"""
)


@query("g5_hop_classes", f"{K} node:i hop:s", "SELECT * FROM hops", HOPS_SQL)
def g5_hop_classes(t: Tables) -> DataFrame:
    """Linked proteins by distance class from the anchor."""
    return graph.hop_classes(roles.edges(t), roles.nodes(t), KEYS)


@query(
    "g5_hop_fractions",
    f"{K} hop_class:s physical_fraction:f9 residue_fraction:f9 parent_fraction:f9",
    f"""SELECT {KEY_SQL}, hop_class, COALESCE(cn, 0) / n AS physical_fraction, COALESCE(cr, 0) / r AS residue_fraction, COALESCE(cp, 0) / p AS parent_fraction
        FROM (SELECT {KEY_SQL}, COUNT(*) AS n, SUM(length) AS r, COUNT(DISTINCT parent) AS p FROM nodes WHERE species <> 'DNA' GROUP BY ALL)
        CROSS JOIN (SELECT UNNEST(['linked', 'direct', 'second', 'third_plus']) AS hop_class)
        LEFT JOIN (SELECT {KEY_SQL}, hop_class, COUNT(*) AS cn, SUM(length) AS cr, COUNT(DISTINCT parent) AS cp FROM
           (SELECT *, hop AS hop_class FROM hops UNION ALL SELECT *, 'linked' FROM hops) GROUP BY ALL) USING ({KEY_SQL}, hop_class)""",
    HOPS_SQL,
)
def g5_hop_fractions(t: Tables) -> DataFrame:
    """Chain, residue and parent fractions of each class."""
    n = roles.nodes(t)
    return graph.hop_fractions(graph.hop_classes(roles.edges(t), n, KEYS), n, KEYS)


DEGREE_SQL = (
    EDGES_SQL
    + """
deg AS (SELECT n.*, COALESCE(k.degree, 0) AS degree FROM nodes n LEFT JOIN
  (SELECT frame, node, COUNT(*) AS degree FROM (SELECT frame, lo AS node FROM edges UNION ALL SELECT frame, hi FROM edges) GROUP BY ALL) k USING (frame, node)),
dcount AS (SELECT system, replicate, frame, degree, COUNT(*) AS count FROM deg WHERE species <> 'DNA' GROUP BY ALL),
dhist AS (SELECT *, count / SUM(count) OVER (PARTITION BY system, replicate, frame) AS probability FROM dcount),
"""
)


@query(
    "g6_species_degrees", f"{K} species:s mean_degree:f", f"SELECT {KEY_SQL}, species, AVG(degree) AS mean_degree FROM deg GROUP BY ALL", DEGREE_SQL
)
def g6_species_degrees(t: Tables) -> DataFrame:
    """Mean degree per species, nodes of degree zero included."""
    return graph.degrees(roles.edges(t), roles.nodes(t), KEYS).groupBy(*KEYS, "species").agg(F.avg("degree").alias("mean_degree"))


@query(
    "g7_degree_histogram",
    f"{K} degree:i count:i probability:f9",
    "SELECT * FROM dhist",
    DEGREE_SQL,
)
def g7_degree_histogram(t: Tables) -> DataFrame:
    """Sparse degree histogram of the proteins (anchor contacts count)."""
    return graph.degree_histogram(graph.degrees(roles.edges(t), roles.nodes(t), KEYS).where("species <> 'DNA'"), KEYS)


@query(
    "a5_degree_group",
    "system:s degree:i probability_mean:f9 probability_sd:f9 probability_n:i",
    f"""SELECT system, degree, AVG(p) AS probability_mean, STDDEV_SAMP(p) AS probability_sd, COUNT(p) AS probability_n FROM (
          SELECT system, replicate, degree, AVG(probability) AS p FROM dhist GROUP BY ALL) GROUP BY ALL""",
    DEGREE_SQL,
)
def a5_degree_group(t: Tables) -> DataFrame:
    """A5: mean degree distribution over the frames in which a degree occurs, then over trajectories."""
    hist = graph.degree_histogram(graph.degrees(roles.edges(t), roles.nodes(t), KEYS).where("species <> 'DNA'"), KEYS)
    return statistics.two_level_stats(statistics.degree_means(hist), ["system", "degree"], ["probability"])


@query(
    "a7_graph_metrics",
    f"{K} n_nodes:i n_edges:i edge_density:f mean_partner_number:f free_fraction:f",
    f"""SELECT {KEY_SQL}, COUNT(*) AS n_nodes, SUM(degree) // 2 AS n_edges, (SUM(degree) / 2) / (COUNT(*) * (COUNT(*) - 1) / 2) AS edge_density,
          AVG(degree) AS mean_partner_number, AVG(CASE WHEN degree = 0 THEN 1.0 ELSE 0.0 END) AS free_fraction FROM deg GROUP BY ALL""",
    DEGREE_SQL,
)
def a7_graph_metrics(t: Tables) -> DataFrame:
    """Edge count and density, mean partners, share of free nodes."""
    return graph.graph_metrics(roles.edges(t), roles.nodes(t), KEYS)


@query(
    "a6_pair_kinds",
    f"{K} kind:s edges:i possible:f contact_probability:f",
    f"""SELECT {KEY_SQL}, kind, COALESCE(e, 0) AS edges, possible, CASE WHEN possible > 0 THEN COALESCE(e, 0) / possible END AS contact_probability FROM (
          SELECT {KEY_SQL}, UNNEST(['OO', 'MM', 'OM', 'OD', 'MD']) AS kind, UNNEST([o * (o - 1) / 2, m * (m - 1) / 2, o * m, o * d, m * d]) AS possible
          FROM (SELECT {KEY_SQL}, COUNT(*) FILTER (species = 'OCT4')::DOUBLE AS o, COUNT(*) FILTER (species = 'MED1')::DOUBLE AS m,
                  COUNT(*) FILTER (species = 'DNA')::DOUBLE AS d FROM nodes GROUP BY ALL))
        LEFT JOIN (SELECT e.system, e.replicate, e.frame, CASE LEAST(a.species, b.species) || GREATEST(a.species, b.species) WHEN 'OCT4OCT4' THEN 'OO'
             WHEN 'MED1MED1' THEN 'MM' WHEN 'MED1OCT4' THEN 'OM' WHEN 'DNAOCT4' THEN 'OD' WHEN 'DNAMED1' THEN 'MD' END AS kind, COUNT(*) AS e
           FROM edges e JOIN nodes a ON e.frame = a.frame AND e.lo = a.node JOIN nodes b ON e.frame = b.frame AND e.hi = b.node GROUP BY ALL)
        USING ({KEY_SQL}, kind)""",
    EDGES_SQL,
)
def a6_pair_kinds(t: Tables) -> DataFrame:
    """Edges, possible pairs and contact probability per pair of species."""
    return graph.pair_kind_counts(roles.edges(t), roles.nodes(t), KEYS)


@query(
    "a19_anchor_neighbours",
    f"{K} OCT4_neighbours:i MED1_neighbours:i",
    f"""SELECT n.system, n.replicate, n.frame, COUNT(DISTINCT node) FILTER (species = 'OCT4') AS OCT4_neighbours,
          COUNT(DISTINCT node) FILTER (species = 'MED1') AS MED1_neighbours
        FROM edges e JOIN nodes n ON e.frame = n.frame AND e.hi = n.node WHERE e.lo = 0 GROUP BY ALL""",
    EDGES_SQL,
)
def a19_anchor_neighbours(t: Tables) -> DataFrame:
    """Distinct proteins of each species that touch the anchor."""
    p = roles.pairs(t, roles.PRIMARY).where("d < 1.2 AND (species_i = 'DNA') <> (species_j = 'DNA')")
    touched = p.selectExpr(*KEYS, "if(species_i = 'DNA', molecule_j, molecule_i) AS node", "if(species_i = 'DNA', species_j, species_i) AS species").distinct()
    return touched.groupBy(*KEYS).agg(*[F.count_if(F.col("species") == s).alias(f"{s}_neighbours") for s in ("OCT4", "MED1")])


# ---------------------------------------------------------------------------------------- fixed-resolution graphs

FIXED_SQL = (
    PAIRS_SQL
    + """
cross_pairs AS MATERIALIZED (SELECT * FROM pairs WHERE d < 1.2 AND species_i <> 'DNA' AND species_j <> 'DNA' AND parent_i <> parent_j),
par_nodes AS MATERIALIZED (SELECT system, replicate, frame, parent AS node, COUNT(*) AS length FROM beads WHERE species <> 'DNA' GROUP BY ALL),
par_edges AS MATERIALIZED (SELECT DISTINCT system, replicate, frame, LEAST(parent_i, parent_j) AS lo, GREATEST(parent_i, parent_j) AS hi FROM cross_pairs),
blk_nodes AS MATERIALIZED (SELECT system, replicate, frame, block AS node, ANY_VALUE(parent) AS parent, ANY_VALUE(species) AS species,
   ANY_VALUE(molecule) AS molecule, COUNT(*) AS length FROM beads WHERE species <> 'DNA' GROUP BY system, replicate, frame, block),
blk_edges AS MATERIALIZED (SELECT DISTINCT system, replicate, frame, LEAST(block_i, block_j) AS lo, GREATEST(block_i, block_j) AS hi FROM cross_pairs),
"""
)


def cross_pairs(t: Tables) -> DataFrame:
    return roles.pairs(t, roles.PRIMARY).where("d < 1.2 AND species_i <> 'DNA' AND species_j <> 'DNA' AND parent_i <> parent_j")


def block_nodes(t: Tables) -> DataFrame:
    return (
        roles.beads(t)
        .where("species <> 'DNA'")
        .groupBy(*KEYS, F.col("block").alias("node"))
        .agg(*[F.first(c).alias(c) for c in ("parent", "species", "molecule")], F.count("*").alias("length"))
    )


def parent_nodes(t: Tables) -> DataFrame:
    return roles.beads(t).where("species <> 'DNA'").groupBy(*KEYS, F.col("parent").alias("node")).agg(F.count("*").alias("length"))


def _fixed_metric_sql(prefix: str, minus: str) -> str:
    return f"""SELECT {KEY_SQL}, n AS n_nodes, e AS n_edges, e / NULLIF(n * (n - 1) / 2 - {minus}, 0) AS edge_density, 2 * e / n AS mean_partner_number FROM (
      SELECT {KEY_SQL}, ANY_VALUE(n) AS n, COALESCE(ANY_VALUE(e), 0) AS e, COALESCE(ANY_VALUE(w), 0) AS w FROM
        (SELECT {KEY_SQL}, COUNT(*) AS n FROM {prefix}_nodes GROUP BY ALL)
        LEFT JOIN (SELECT {KEY_SQL}, COUNT(*) AS e FROM {prefix}_edges GROUP BY ALL) USING ({KEY_SQL})
        LEFT JOIN (SELECT {KEY_SQL}, SUM(k * (k - 1) / 2) AS w FROM (SELECT {KEY_SQL}, parent, COUNT(*) AS k FROM blk_nodes GROUP BY ALL) GROUP BY ALL)
          USING ({KEY_SQL}) GROUP BY ALL)"""


@query("g9_parent_graph", f"{K} n_nodes:i n_edges:i edge_density:f mean_partner_number:f", _fixed_metric_sql("par", "0"), FIXED_SQL)
def g9_parent_graph(t: Tables) -> DataFrame:
    """The graph of parent molecules from the same contacts, pairs inside a parent left out."""
    return graph.graph_metrics(graph.node_pairs(cross_pairs(t), KEYS, "parent_i", "parent_j"), parent_nodes(t), KEYS)


@query("a8_block_graph", f"{K} n_nodes:i n_edges:i edge_density:f mean_partner_number:f", _fixed_metric_sql("blk", "w"), FIXED_SQL)
def a8_block_graph(t: Tables) -> DataFrame:
    """The fixed-block graph; its density leaves out the pairs inside a parent."""
    n = block_nodes(t)
    inside = n.groupBy(*KEYS, "parent").agg(F.count("*").alias("_k")).groupBy(*KEYS).agg(F.sum(F.expr("_k * (_k - 1) / 2")).alias("within_pairs"))
    return graph.graph_metrics(graph.node_pairs(cross_pairs(t), KEYS, "block_i", "block_j"), n, KEYS, inside)


COVALENT_SQL = (
    FIXED_SQL
    + """
cov AS MATERIALIZED (SELECT a.system, a.replicate, a.frame, a.node AS lo, b.node AS hi, a.node % 4 AS boundary, a.molecule = b.molecule AS same
  FROM blk_nodes a JOIN blk_nodes b ON a.frame = b.frame AND a.species = 'MED1' AND b.species = 'MED1' AND a.parent = b.parent AND b.node = a.node + 1),
"""
)


def _med1_blocks(n: DataFrame) -> DataFrame:
    return n.where("species = 'MED1'").select(*KEYS, "parent", (F.col("node") % 4).alias("block_index"), "node", "molecule")


@query("g10_covalent_edges", f"{K} lo:i hi:i", "SELECT * FROM cov WHERE same", COVALENT_SQL)
def g10_covalent_edges(t: Tables) -> DataFrame:
    """Consecutive blocks of a parent on one physical chain."""
    return graph.covalent_edges(_med1_blocks(block_nodes(t)), KEYS)


CONT_SQL = (
    COVALENT_SQL
    + """
cont_edges AS MATERIALIZED (SELECT system, replicate, frame, lo, hi FROM blk_edges UNION SELECT system, replicate, frame, lo, hi FROM cov WHERE same),
"""
    + components_sql("cont_edges", "blk_nodes", "contc")
)


@query(
    "g12_residue_weighted_lcc",
    f"{K} largest_weight_fraction:f9",
    f"SELECT {KEY_SQL}, MAX(w) / SUM(w) AS largest_weight_fraction FROM (SELECT {KEY_SQL}, label, SUM(length) AS w FROM contc GROUP BY ALL) GROUP BY ALL",
    CONT_SQL,
)
def g12_residue_weighted_lcc(t: Tables) -> DataFrame:
    """Contacts and covalent edges together; residue share of the largest component."""
    n = block_nodes(t)
    e = graph.union_edges(graph.node_pairs(cross_pairs(t), KEYS, "block_i", "block_j"), graph.covalent_edges(_med1_blocks(n), KEYS))
    return graph.weighted_largest_component(graph.connected_components(e, n, KEYS), KEYS, "length")


MASK_SQL = (
    COVALENT_SQL
    + """
masks AS (SELECT UNNEST(['Full', 'Full', 'Full', 'Split-2', 'Split-2']) AS mask, UNNEST([0, 1, 2, 0, 2]) AS boundary),
mlab AS (SELECT UNNEST(['Full', 'Split-2', 'Split-4']) AS mask),
mk_nodes AS MATERIALIZED (SELECT blk_nodes.*, mask FROM blk_nodes CROSS JOIN mlab),
mk_edges AS MATERIALIZED (SELECT system, replicate, frame, mask, lo, hi FROM blk_edges CROSS JOIN mlab
  UNION SELECT system, replicate, frame, mask, lo, hi FROM cov JOIN masks USING (boundary)),
"""
    + components_sql("mk_edges", "mk_nodes", "mkc", "system, replicate, frame, mask")
    + """
masklcc AS MATERIALIZED (SELECT system, replicate, frame, mask, MAX(w) / SUM(w) AS largest_weight_fraction FROM
  (SELECT system, replicate, frame, mask, label, SUM(length) AS w FROM mkc GROUP BY ALL) GROUP BY ALL),
"""
)


def mask_lcc(t: Tables) -> DataFrame:
    n = block_nodes(t)
    contact = graph.node_pairs(cross_pairs(t), KEYS, "block_i", "block_j")
    labelled = graph.components_by_mask(contact, _med1_blocks(n), n, KEYS, MASK_BOUNDARIES)
    return graph.weighted_largest_component(labelled, [*KEYS, "mask"], "length")


@query("g11_mask_lcc", f"{K} mask:s largest_weight_fraction:f9", "SELECT * FROM masklcc", MASK_SQL)
def g11_mask_lcc(t: Tables) -> DataFrame:
    """Every covalent mask applied to every ensemble; residue share of the largest component."""
    return mask_lcc(t)


ANCHOR_SQL = FIXED_SQL + components_sql("blk_edges", "blk_nodes", "bc")


@query(
    "g13_anchor_component",
    f"{K} node:i",
    f"""SELECT DISTINCT b.system, b.replicate, b.frame, b.node FROM bc b JOIN (SELECT DISTINCT c.frame, c.label FROM bc c JOIN
          (SELECT DISTINCT frame, CASE WHEN species_i = 'DNA' THEN block_j ELSE block_i END AS node FROM pairs
           WHERE d < 1.2 AND (species_i = 'DNA') <> (species_j = 'DNA')) h USING (frame, node)) l USING (frame, label)""",
    ANCHOR_SQL,
)
def g13_anchor_component(t: Tables) -> DataFrame:
    """Blocks reachable from a virtual anchor tied to the blocks in contact with it."""
    p = roles.stored_pairs(t)
    tied = p.where("(species_i = 'DNA') <> (species_j = 'DNA')").selectExpr(*KEYS, "if(species_i = 'DNA', block_j, block_i) AS node").distinct()
    cross = p.where("species_i <> 'DNA' AND species_j <> 'DNA' AND parent_i <> parent_j")
    return graph.component_with_anchor(graph.node_pairs(cross, KEYS, "block_i", "block_j"), block_nodes(t), tied, KEYS)


INDIRECT_SQL = (
    EDGES_SQL
    + """
tnbr AS MATERIALIZED (SELECT n.system, n.replicate, n.frame, n.u, a.species AS us, n.v, b.species AS vs FROM
  (SELECT system, replicate, frame, lo AS u, hi AS v FROM edges UNION ALL SELECT system, replicate, frame, hi, lo FROM edges) n
  JOIN nodes a ON n.frame = a.frame AND n.u = a.node JOIN nodes b ON n.frame = b.frame AND n.v = b.node),
bound AS (SELECT DISTINCT frame, v AS node FROM tnbr WHERE us = 'DNA'),
indirect AS (SELECT DISTINCT t.system, t.replicate, t.frame, t.v AS node FROM tnbr t SEMI JOIN bound x ON t.frame = x.frame AND t.u = x.node
  WHERE t.us = 'OCT4' AND t.vs = 'MED1' AND NOT EXISTS (SELECT 1 FROM bound y WHERE y.frame = t.frame AND y.node = t.v)),
"""
)


@query("g14_indirect_associates", f"{K} node:i", "SELECT * FROM indirect", INDIRECT_SQL)
def g14_indirect_associates(t: Tables) -> DataFrame:
    """Long chains next to an anchor-bound short chain and not bound themselves."""
    return graph.indirect_associates(materialise(roles.edges(t), "edges"), roles.nodes(t), KEYS)


@query(
    "g16_node_selection",
    f"{K} mode:s nodes:i",
    f"""SELECT {KEY_SQL}, 'dna_associated' AS mode, COUNT(DISTINCT node) AS nodes FROM
          (SELECT {KEY_SQL}, node FROM indirect UNION ALL SELECT system, replicate, b.frame, b.node FROM bound b JOIN nodes USING (frame, node)
           UNION ALL SELECT {KEY_SQL}, node FROM nodes WHERE species = 'DNA') GROUP BY ALL
        UNION ALL SELECT {KEY_SQL}, 'dna_neighborhood', COUNT(DISTINCT node) FROM
          (SELECT system, replicate, b.frame, b.node FROM bound b JOIN nodes USING (frame, node)
           UNION ALL SELECT {KEY_SQL}, node FROM nodes WHERE species = 'DNA') GROUP BY ALL
        UNION ALL SELECT {KEY_SQL}, 'full', COUNT(*) FROM nodes GROUP BY ALL
        UNION ALL SELECT {KEY_SQL}, 'dna_linked', COUNT(*) FROM (SELECT {KEY_SQL}, node FROM hops UNION ALL SELECT {KEY_SQL}, node FROM nodes WHERE species = 'DNA') GROUP BY ALL
        UNION ALL SELECT {KEY_SQL}, 'largest_component', MAX(size) FROM (SELECT {KEY_SQL}, label, COUNT(*) AS size FROM pcomp GROUP BY ALL) GROUP BY {KEY_SQL}""",
    HOPS_SQL + INDIRECT_SQL.removeprefix(EDGES_SQL) + PROTEIN_SQL.removeprefix(EDGES_SQL),
)
def g16_node_selection(t: Tables) -> DataFrame:
    """Size of each node selection."""
    e, n = materialise(roles.edges(t), "edges"), roles.nodes(t)
    out = None
    for mode in ("dna_associated", "dna_neighborhood", "dna_linked", "full", "largest_component"):
        part = graph.select_nodes(mode, e, n, KEYS).groupBy(*KEYS).agg(F.count("*").alias("nodes")).withColumn("mode", F.lit(mode))
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "k8_largest_component_nodes",
    f"{K} node:i size:i internal:i",
    f"""SELECT p.system, p.replicate, p.frame, p.node, size, internal FROM pcomp p JOIN (
          SELECT *, ROW_NUMBER() OVER (PARTITION BY {KEY_SQL} ORDER BY size DESC, internal DESC, label) AS rk FROM (
            SELECT s.*, COALESCE(i.c, 0) AS internal FROM (SELECT {KEY_SQL}, label, COUNT(*) AS size FROM pcomp GROUP BY ALL) s LEFT JOIN
              (SELECT c.frame, c.label, COUNT(*) AS c FROM pedges e JOIN pcomp c ON e.frame = c.frame AND e.lo = c.node GROUP BY ALL) i USING (frame, label))) b
        ON p.frame = b.frame AND p.label = b.label AND rk = 1""",
    PROTEIN_SQL,
)
def k8_largest_component_nodes(t: Tables) -> DataFrame:
    """K8: members of the largest protein component; ties go to more internal edges."""
    e = materialise(roles.edges(t), "edges")
    protein_edges = e.where("lo <> 0 AND hi <> 0")
    return graph.largest_component_nodes(graph.species_components(e, roles.nodes(t), KEYS), protein_edges, KEYS)


# ---------------------------------------------------------------------------------------------- anchor windows

WINDOW_SQL = (
    EDGES_SQL
    + """
touch AS MATERIALIZED (SELECT DISTINCT system, replicate, frame, CASE WHEN species_i = 'DNA' THEN molecule_j ELSE molecule_i END AS node,
   LEAST(CASE WHEN species_i = 'DNA' THEN residue_i ELSE residue_j END, 79 - CASE WHEN species_i = 'DNA' THEN residue_i ELSE residue_j END) // 4 AS win
   FROM pairs WHERE d < 1.2 AND (species_i = 'DNA') <> (species_j = 'DNA')),
pnode AS MATERIALIZED (SELECT n.system, n.replicate, n.frame, n.node, EXISTS (SELECT 1 FROM touch t WHERE t.frame = n.frame AND t.node = n.node) AS bound
  FROM nodes n WHERE species <> 'DNA'),
shared AS MATERIALIZED (SELECT DISTINCT a.frame, a.node AS lo, b.node AS hi FROM touch a JOIN touch b ON a.frame = b.frame AND a.win = b.win AND a.node < b.node),
cats AS MATERIALIZED (SELECT a.system, a.replicate, a.frame, CASE WHEN NOT a.bound AND NOT b.bound THEN 'neither_bound' WHEN a.bound <> b.bound THEN 'only_one_bound'
   WHEN s.lo IS NOT NULL THEN 'shared_window' ELSE 'both_bound_different_windows' END AS binding_category, e.lo IS NOT NULL AS is_edge
  FROM pnode a JOIN pnode b ON a.frame = b.frame AND a.node < b.node
  LEFT JOIN shared s ON s.frame = a.frame AND s.lo = a.node AND s.hi = b.node
  LEFT JOIN edges e ON e.frame = a.frame AND e.lo = a.node AND e.hi = b.node),
local_repeat AS MATERIALIZED (SELECT system, replicate, binding_category, COUNT(*) FILTER (is_edge) AS edges, COUNT(*) AS opportunities FROM cats GROUP BY ALL),
"""
)


def touches(t: Tables, p: DataFrame | None = None) -> DataFrame:
    p = p if p is not None else roles.pairs(t, roles.PRIMARY).where("d < 1.2")
    dna = p.where("(species_i = 'DNA') <> (species_j = 'DNA')").selectExpr(
        *KEYS, "if(species_i = 'DNA', molecule_j, molecule_i) AS node", "if(species_i = 'DNA', residue_i, residue_j) AS r"
    )
    return dna.select(*KEYS, "node", int_div(base_pair_index("r", roles.DNA_BEADS), 4).alias("window")).distinct()


def binding(t: Tables) -> DataFrame:
    p = roles.stored_pairs(t)
    proteins = roles.nodes(t).where("species <> 'DNA'")
    e = graph.node_pairs(p.where("species_i <> 'DNA' AND species_j <> 'DNA'"), KEYS, "molecule_i", "molecule_j")
    return graph.binding_categories(e, proteins, touches(t, p), KEYS)


def local_repeat(t: Tables) -> DataFrame:
    return binding(t).groupBy("system", "replicate", "binding_category").agg(F.sum("edges").alias("edges"), F.sum("opportunities").alias("opportunities"))


@query("j7_shared_window_edges", f"{K} lo:i hi:i shared_window:b",
       f"SELECT {KEY_SQL}, e.lo, e.hi, s.lo IS NOT NULL AS shared_window FROM edges e LEFT JOIN shared s USING (frame, lo, hi) WHERE e.lo <> 0", WINDOW_SQL)
def j7_shared_window_edges(t: Tables) -> DataFrame:
    """Edges whose ends touch a common window of the anchor."""
    p = roles.stored_pairs(t)
    e = graph.node_pairs(p.where("species_i <> 'DNA' AND species_j <> 'DNA'"), KEYS, "molecule_i", "molecule_j")
    return graph.shared_window_edges(e, touches(t, p), KEYS)


@query(
    "a20_binding_categories",
    "system:s replicate:s binding_category:s edges:i opportunities:i conditional_probability:f9",
    """SELECT system, replicate, binding_category, COALESCE(edges, 0) AS edges, COALESCE(opportunities, 0) AS opportunities,
         CASE WHEN opportunities > 0 THEN edges / opportunities END AS conditional_probability
       FROM (SELECT DISTINCT system, replicate FROM nodes) CROSS JOIN
         (SELECT UNNEST(['neither_bound', 'only_one_bound', 'both_bound_different_windows', 'shared_window']) AS binding_category)
       LEFT JOIN local_repeat USING (system, replicate, binding_category)""",
    WINDOW_SQL,
)
def a20_binding_categories(t: Tables) -> DataFrame:
    """Contact probability given how both chains are bound, without listing all pairs."""
    return local_repeat(t).withColumn("conditional_probability", ratio("edges", "opportunities"))


@query(
    "a21_odds_ratio",
    "system:s log2_odds_ratio_mean:f log2_odds_ratio_sd:f log2_odds_ratio_n:i geometric_mean_odds_ratio:f",
    """SELECT system, AVG(l) AS log2_odds_ratio_mean, STDDEV_SAMP(l) AS log2_odds_ratio_sd, COUNT(l) AS log2_odds_ratio_n, POWER(2, AVG(l)) AS geometric_mean_odds_ratio
       FROM (SELECT system, replicate, LOG2(((a + p) / (b + p)) / ((c + p) / (d + p))) AS l FROM (
         SELECT *, CASE WHEN a = 0 OR b = 0 OR c = 0 OR d = 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS p FROM (
           SELECT system, replicate, COALESCE(MAX(edges) FILTER (binding_category = 'shared_window'), 0)::DOUBLE AS a,
             COALESCE(MAX(opportunities - edges) FILTER (binding_category = 'shared_window'), 0)::DOUBLE AS b,
             COALESCE(MAX(edges) FILTER (binding_category = 'both_bound_different_windows'), 0)::DOUBLE AS c,
             COALESCE(MAX(opportunities - edges) FILTER (binding_category = 'both_bound_different_windows'), 0)::DOUBLE AS d
           FROM local_repeat GROUP BY ALL))) GROUP BY ALL""",
    WINDOW_SQL,
)
def a21_odds_ratio(t: Tables) -> DataFrame:
    """Odds of contact in a shared window against different windows; geometric mean over trajectories."""
    wide = local_repeat(t).groupBy("system", "replicate").agg(
        *[
            F.coalesce(F.max(F.when(F.col("binding_category") == c, F.expr(e))), F.lit(0)).alias(n)
            for n, c, e in [
                ("a", "shared_window", "edges"),
                ("b", "shared_window", "opportunities - edges"),
                ("c", "both_bound_different_windows", "edges"),
                ("d", "both_bound_different_windows", "opportunities - edges"),
            ]
        ]
    )
    repeat = wide.withColumn("log2_odds_ratio", F.log2(odds_ratio("a", "b", "c", "d")))
    return statistics.two_level_stats(repeat, ["system"], ["log2_odds_ratio"]).withColumn("geometric_mean_odds_ratio", F.pow(F.lit(2.0), "log2_odds_ratio_mean"))


@query(
    "v3_conservation_ledger",
    "check:s value:s required:s passed:b",
    """SELECT 'degree sum is twice the edges' AS "check", CAST(MAX(ABS(k - 2 * e)) AS VARCHAR) AS value, '<= 0' AS required, MAX(ABS(k - 2 * e)) <= 0 AS passed FROM
         (SELECT frame, SUM(degree)::BIGINT AS k FROM deg GROUP BY ALL) JOIN (SELECT frame, COUNT(*) AS e FROM edges GROUP BY ALL) USING (frame)
       UNION ALL SELECT 'binding categories hold all pairs', CAST(ROUND(MAX(ABS(o - n * (n - 1) / 2)), 9) AS VARCHAR), '<= 1e-06', MAX(ABS(o - n * (n - 1) / 2)) <= 0.000001 FROM
         (SELECT frame, COUNT(*)::DOUBLE AS o FROM cats GROUP BY ALL) JOIN (SELECT frame, COUNT(*)::DOUBLE AS n FROM nodes WHERE species <> 'DNA' GROUP BY ALL) USING (frame)
       UNION ALL SELECT 'hop classes add up to the linked', CAST(ROUND(MAX(ABS(a - b)), 9) AS VARCHAR), '<= 1e-06', MAX(ABS(a - b)) <= 0.000001 FROM
         (SELECT h.frame, COUNT(*)::DOUBLE / MAX(n) AS a, (COUNT(*) FILTER (hop = 'direct') + COUNT(*) FILTER (hop = 'second') + COUNT(*) FILTER (hop = 'third_plus'))::DOUBLE / MAX(n) AS b
          FROM hops h JOIN (SELECT frame, COUNT(*) AS n FROM nodes WHERE species <> 'DNA' GROUP BY ALL) USING (frame) GROUP BY ALL)""",
    HOPS_SQL + DEGREE_SQL.removeprefix(EDGES_SQL) + WINDOW_SQL.removeprefix(EDGES_SQL),
)
def v3_conservation_ledger(t: Tables) -> DataFrame:
    """V3, V7: degrees add up to twice the edges, categories to all pairs, hop classes to the linked proteins."""
    e, n = materialise(roles.edges(t), "edges"), roles.nodes(t)
    ends = graph.degrees(e, n, KEYS).groupBy(*KEYS).agg(F.sum("degree").alias("k")).join(e.groupBy(*KEYS).agg(F.count("*").alias("e")), KEYS)
    proteins = n.where("species <> 'DNA'")
    possible = binding(t).groupBy(*KEYS).agg(F.sum("opportunities").alias("o")).join(proteins.groupBy(*KEYS).agg(F.count("*").cast("double").alias("n")), KEYS)
    hops = graph.hop_fractions(graph.hop_classes(e, n, KEYS), n, KEYS).groupBy(*KEYS).agg(
        F.sum(F.when(F.col("hop_class") == "linked", F.col("physical_fraction"))).alias("a"), F.sum(F.when(F.col("hop_class") != "linked", F.col("physical_fraction"))).alias("b")
    )
    return quality.ledger(
        quality.max_gap(ends, "degree sum is twice the edges", F.col("k"), 2 * F.col("e"), 0),
        quality.max_gap(possible, "binding categories hold all pairs", F.col("o"), F.col("n") * (F.col("n") - 1) / 2, 1e-6),
        quality.max_gap(hops, "hop classes add up to the linked", F.col("a"), F.col("b"), 1e-6),
    )
