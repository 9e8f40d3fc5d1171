"""The three trajectory analyses as compositions of operators.

``positions`` has one row per bead and frame with its attributes (molecule, species, parent, block, residue). Contacts
are searched once, at the largest cutoff, written, and shared by all three analyses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica import constants as C
from lattica.functions import scalars as S
from lattica.operators import graph, histograms, profiles, quantiles, spatial, statistics
from lattica.session import materialise

KEYS = ["system", "replicate", "frame"]
ATTRIBUTES = ["molecule", "species", "parent", "block", "residue"]


def sampled(positions: DataFrame, first: int = C.FIRST_FRAME, last: int = C.LAST_FRAME, step: int = C.FRAME_STEP) -> DataFrame:
    """Production frames on the sampling grid (a range filter that reaches the Parquet scan, then the step)."""
    f = F.col("frame")
    return positions.where((f >= first) & (f <= last) & ((f - first) % step == 0))


def contacts(positions: DataFrame, box, cutoffs=C.CUTOFFS_NM) -> DataFrame:
    return materialise(spatial.radius_pairs(positions, KEYS, box, max(cutoffs), carry=ATTRIBUTES), "contacts")


def node_table(positions: DataFrame) -> DataFrame:
    return positions.groupBy(*KEYS, F.col("molecule").alias("node")).agg(F.first("species").alias("species"), F.first("parent").alias("parent"), F.count("*").alias("length"))


def network(positions: DataFrame, pairs: DataFrame, cutoffs=C.CUTOFFS_NM, primary: float = C.PRIMARY_CUTOFF_NM) -> dict[str, DataFrame]:
    """Cluster, frame, degree and paired summaries of the contact network."""
    nodes = node_table(positions)
    at = [*KEYS, "cutoff_nm"]
    edges = materialise(graph.node_pairs(graph.pairs_by_cutoff(pairs, cutoffs), at, "molecule_i", "molecule_j"), "edges")
    every = nodes.select("*", F.explode(F.array(*[F.lit(float(c)) for c in cutoffs])).alias("cutoff_nm"))
    clusters = graph.cluster_metrics(graph.species_components(edges, every, at), at)
    main = edges.where(S.close("cutoff_nm", primary)).drop("cutoff_nm")
    labelled = graph.connected_components(main, nodes, KEYS)
    degree = graph.degrees(main, nodes, KEYS)
    kinds = graph.pair_kind_counts(main, nodes, KEYS)
    wide = kinds.groupBy(*KEYS).agg(*[F.max(F.when(F.col("kind") == k, F.col("contact_probability"))).alias(f"{k}_contact_probability") for k in ("OO", "MM", "OM", "OD", "MD")])
    frames = wide.join(graph.augmented_metrics(labelled, KEYS), KEYS, "left")
    metrics = statistics.metric_columns(frames, KEYS)
    cluster_metrics = statistics.metric_columns(clusters, at)
    cluster_repeat = statistics.trajectory_means(clusters, ["system", "replicate", "cutoff_nm"], cluster_metrics)
    frame_repeat = statistics.trajectory_means(frames, ["system", "replicate"], metrics)
    degree_repeat = statistics.degree_means(graph.degree_histogram(degree.where(F.col("species") != C.ANCHOR_SPECIES), KEYS))
    return {
        "clusters": clusters,
        "frames": frames,
        "cluster_repeat": cluster_repeat,
        "cluster_group": statistics.two_level_stats(cluster_repeat, ["system", "cutoff_nm"], cluster_metrics),
        "frame_repeat": frame_repeat,
        "frame_group": statistics.two_level_stats(frame_repeat, ["system"], metrics),
        "block_repeat": statistics.block_means(clusters, cluster_metrics, primary),
        "degree_repeat": degree_repeat,
        "degree_group": statistics.two_level_stats(degree_repeat, ["system", "degree"], ["probability"]),
    }


def reach(positions: DataFrame, pairs: DataFrame, box, primary: float = C.PRIMARY_CUTOFF_NM) -> dict[str, DataFrame]:
    """Hop classes and distances of the proteins linked to the anchor."""
    nodes = node_table(positions)
    near = pairs.where(F.col("d") < primary)
    edges = graph.node_pairs(near, KEYS, "molecule_i", "molecule_j")
    hops = materialise(graph.hop_classes(edges, nodes, KEYS), "hops")
    protein = positions.where(F.col("species") != C.ANCHOR_SPECIES)
    linked = protein.join(hops.select(*KEYS, F.col("node").alias("molecule")), [*KEYS, "molecule"], "left_semi")
    anchor = positions.where(F.col("species") == C.ANCHOR_SPECIES)
    distances = materialise(spatial.nearest_target_distance(linked, anchor, KEYS, box, carry=["species", "parent"]), "distances")
    weighted = quantiles.parent_weights(distances, KEYS)
    scopes = distances.withColumn("weight", F.lit(1.0)).withColumn("scope", F.lit("bead")).unionByName(weighted.withColumn("scope", F.lit("parent_weighted_bead")).select(*distances.columns, "weight", "scope"))
    typed = scopes.select("*", F.explode(F.array(F.lit("all"), F.col("species"))).alias("protein_type"))
    return {
        "hops": graph.hop_fractions(hops, nodes, KEYS),
        "distance_summary": quantiles.distance_summary(typed, [*KEYS, "scope", "protein_type"], weight="weight"),
        "pooled_histogram": histograms.pooled_histogram(distances, ["system", "replicate"]),
        "radial_histogram": histograms.frame_normalised_histogram(weighted, positions.select(*KEYS), ["system", "replicate"], weight="weight"),
        "contact_density": profiles.contact_density(near, positions, KEYS),
        "sibling_pairs": profiles.sibling_pairs(near, KEYS),
    }


def fixed_blocks(positions: DataFrame, pairs: DataFrame, primary: float = C.PRIMARY_CUTOFF_NM) -> dict[str, DataFrame]:
    """Parent and block graphs, and the residue share of the largest component under every covalent mask."""
    protein = positions.where(F.col("species") != C.ANCHOR_SPECIES)
    blocks = protein.groupBy(*KEYS, F.col("block").alias("node")).agg(*[F.first(c).alias(c) for c in ("parent", "species", "molecule")], F.count("*").alias("length"))
    parents = protein.groupBy(*KEYS, F.col("parent").alias("node")).agg(F.count("*").alias("length"))
    cross = pairs.where((F.col("d") < primary) & (F.col("species_i") != C.ANCHOR_SPECIES) & (F.col("species_j") != C.ANCHOR_SPECIES) & (F.col("parent_i") != F.col("parent_j")))
    block_edges = materialise(graph.node_pairs(cross, KEYS, "block_i", "block_j"), "block_edges")
    count = len(C.BLOCK_CUTS) + 1
    long_chain = blocks.where("species = 'MED1'").select(*KEYS, "parent", (F.col("node") % count).alias("block_index"), "node", "molecule")
    at = [*KEYS, "mask"]
    each = F.explode(F.array(*[F.lit(m) for m in C.MASK_BOUNDARIES])).alias("mask")
    masked = graph.union_edges(block_edges.select(*KEYS, "lo", "hi", each).select(*at, "lo", "hi"), graph.mask_edges(long_chain, KEYS, C.MASK_BOUNDARIES))
    inside = blocks.groupBy(*KEYS, "parent").agg(F.count("*").alias("_k")).groupBy(*KEYS).agg(F.sum(F.expr("_k * (_k - 1) / 2")).alias("within_pairs"))
    real = graph.union_edges(block_edges, graph.covalent_edges(long_chain, KEYS))
    return {
        "parent_graph": graph.graph_metrics(graph.node_pairs(cross, KEYS, "parent_i", "parent_j"), parents, KEYS),
        "block_graph": graph.graph_metrics(block_edges, blocks, KEYS, inside),
        "continuity": graph.weighted_largest_component(graph.connected_components(real, blocks, KEYS), KEYS, "length"),
        "masks": graph.weighted_largest_component(graph.connected_components(masked, blocks.select("*", each), at), at, "length"),
    }
