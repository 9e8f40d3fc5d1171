"""Contact graphs: projections of bead pairs, components, hop classes, degrees and anchor reach.

Shapes: ``edges(keys, lo, hi)`` undirected and distinct with lo < hi; ``nodes(keys, node, ...)`` one row per node.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions.scalars import cut_index, pair_count, ratio
from lattica.operators import frames
from lattica.operators.forest import _frame_components, _levelled, _star_labels, nested_components
from lattica.session import discard, materialise


# ---------------------------------------------------------------------------------------------- projections


def node_pairs(pairs: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    """Bead pairs lifted to distinct undirected node pairs; pairs inside one node or without a node drop out."""
    low, high = F.least(a, b), F.greatest(a, b)
    return pairs.where(F.col(a) != F.col(b)).select(*keys, low.alias("lo"), high.alias("hi")).distinct()


def lift_pairs(pairs: DataFrame, beads: DataFrame, keys: Sequence[str], columns: Sequence[str], id: str = "bead") -> DataFrame:
    """Attach bead attributes to both ends of a pair list (for pairs that did not carry them)."""
    out = pairs
    for end in ("i", "j"):
        lookup = beads.select(*keys, F.col(id).alias(end), *[F.col(c).alias(f"{c}_{end}") for c in columns])
        out = out.join(lookup, [*keys, end])
    return out


def pairs_by_cutoff(pairs: DataFrame, cutoffs: Sequence[float]) -> DataFrame:
    """One search at the largest radius serves every smaller cutoff (strictly below each of them)."""
    options = F.filter(F.array(*[F.lit(float(c)) for c in cutoffs]), lambda c: F.col("d") < c)
    return pairs.select("*", F.explode(options).alias("cutoff_nm"))


def levelled_pairs(pairs: DataFrame, keys: Sequence[str], a: str, b: str, cutoffs: Sequence[float]) -> DataFrame:
    """Undirected node pairs with the place, in rising order, of the first cutoff that their closest beads are below."""
    rule = F.coalesce(*[F.when(F.col("_d") < float(c), i) for i, c in enumerate(sorted(cutoffs))])
    near = pairs.where((F.col(a) != F.col(b)) & (F.col("d") < float(max(cutoffs))))
    near = near.groupBy(*keys, F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).agg(F.min("d").alias("_d"))
    return near.select(*keys, "lo", "hi", rule.alias("level"))


def block_key(parent, residue, cuts: Sequence[int]):
    """Node key of a fixed-resolution block: parent * (number of blocks) + block index."""
    return F.col(parent) * (len(cuts) + 1) + cut_index(residue, cuts)


def covalent_edges(blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Consecutive blocks of one parent that lie on the same physical chain.

    ``blocks(keys, parent, block_index, node, molecule)`` is joined to itself on the next index, so there is no
    window over a parent.
    """
    nxt = blocks.select(
        *keys, "parent", (F.col("block_index") - 1).alias("block_index"), F.col("node").alias("_n2"), F.col("molecule").alias("_m2")
    )
    return (
        blocks.join(nxt, [*keys, "parent", "block_index"])
        .where(F.col("molecule") == F.col("_m2"))
        .select(*keys, F.least("node", "_n2").alias("lo"), F.greatest("node", "_n2").alias("hi"))
    )


def mask_edges(blocks: DataFrame, keys: Sequence[str], masks: dict[str, list[int]]) -> DataFrame:
    """Covalent edges that each mask keeps, whatever the real chain looks like: ``(keys, mask, lo, hi)``."""
    kept = F.array(*[F.struct(F.lit(m).alias("mask"), F.lit(b).alias("b")) for m, bs in masks.items() for b in bs])
    nxt = blocks.select(*keys, "parent", (F.col("block_index") - 1).alias("block_index"), F.col("node").alias("_n2"))
    return (
        blocks.join(nxt, [*keys, "parent", "block_index"])
        .select(*keys, "block_index", F.least("node", "_n2").alias("lo"), F.greatest("node", "_n2").alias("hi"), F.explode(kept).alias("_k"))
        .where(F.col("_k.b") == F.col("block_index"))
        .select(*keys, F.col("_k.mask").alias("mask"), "lo", "hi")
    )


def union_edges(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


# ------------------------------------------------------------------------------------------------ components


def _fold_components(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Components of frames known to be small: the edges of one frame fold over one label array.

    Each edge replaces the larger of the two labels at its ends by the smaller, and does nothing when they agree.
    """
    keys = list(keys)
    packed = edges.groupBy(*keys).agg(F.collect_list(F.struct("lo", "hi")).alias("_edges"))
    packed = packed.selectExpr(
        *keys, "_edges", "array_sort(array_distinct(flatten(transform(_edges, e -> array(e.lo, e.hi))))) AS _nodes"
    ).selectExpr(
        *keys,
        "_nodes",
        "transform(_edges, e -> struct(CAST(array_position(_nodes, e.lo) AS INT) AS a, CAST(array_position(_nodes, e.hi) AS INT) AS b)) AS _edges",
    )
    return packed.selectExpr(
        *keys,
        """explode(arrays_zip(_nodes, aggregate(_edges, _nodes, (label, e) ->
             aggregate(array(struct(greatest(label[e.a - 1], label[e.b - 1]) AS high, least(label[e.a - 1], label[e.b - 1]) AS low)), label,
               (l, p) -> if(p.high = p.low, l, transform(l, v -> if(v = p.high, p.low, v))))))) AS _z""",
    ).selectExpr(*keys, "_z._nodes AS node", "_z.`1` AS label")


def _star_components(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Components of graphs of any size: alternating large-star and small-star steps until nothing moves.

    Each step is a min per node (combined before the shuffle) and an equi-join; no node's neighbours are ever
    collected. Every round is written to the shared folder, so lost executors only repeat that round.
    """
    keys = list(keys)
    current = materialise(edges.select(*keys, "lo", "hi"), "star")
    seen = None
    while True:
        # Large star: neighbours above u attach to the smallest node around u.
        both = current.select(*keys, F.col("lo").alias("u"), F.col("hi").alias("v")).unionByName(
            current.select(*keys, F.col("hi").alias("u"), F.col("lo").alias("v"))
        )
        least = both.groupBy(*keys, "u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, [*keys, "u"]).select(*keys, F.col("m").alias("lo"), F.col("v").alias("hi")).distinct()
        # Small star: the neighbours below u, and u itself, attach to the smallest of them.
        low = large.groupBy(*keys, "hi").agg(F.min("lo").alias("m"))
        moved = large.join(low, [*keys, "hi"])
        small = (
            moved.select(*keys, F.col("m").alias("lo"), F.col("lo").alias("hi"))
            .where(F.col("lo") != F.col("hi"))
            .unionByName(low.select(*keys, F.col("m").alias("lo"), "hi"))
            .distinct()
        )
        last, current = current, materialise(small, "star")
        discard(last)
        mark = current.agg(F.count("*").alias("n"), F.sum(F.hash(*keys, "lo", "hi").cast("long")).alias("h"), F.bit_xor(F.xxhash64(*keys, "lo", "hi")).alias("x")).first()
        if seen == tuple(mark):
            break
        seen = tuple(mark)
    roots = current.select(*keys, F.col("lo").alias("node"), F.col("lo").alias("label")).distinct()
    return current.select(*keys, F.col("hi").alias("node"), F.col("lo").alias("label")).unionByName(roots)


def connected_components(edges: DataFrame, nodes: DataFrame, keys: Sequence[str], *, method: str = "contract") -> DataFrame:
    """``nodes`` plus ``label``: the smallest node id of its component (its own id when isolated).

    ``contract`` takes graphs of any size: each round leaves at most half of the nodes that still have edges. ``star`` moves all edges
    in a number of rounds that grows with the logarithm of the diameter. Both work in tasks on frames of up to ``frames.LARGE`` edges. ``fold`` is for callers who know that their frames are small: it keeps one frame's edges in one row.
    """
    keys = list(keys)
    if method == "contract":
        return nested_components(edges.select(*keys, "lo", "hi", F.lit(0).alias("level")), nodes, keys).drop("level")
    if method == "fold":
        labels = _fold_components(edges, keys)
    elif nodes.schema["node"].dataType.simpleString() not in ("int", "bigint"):
        labels = _star_components(edges, keys)
    else:
        own = _levelled(edges.select(*keys, "lo", "hi", F.lit(0).alias("level")), keys, 1)
        large = frames.large_frames(own.groupBy(*keys).agg(F.count("*").alias("n")), keys)
        small = own if large is None else own.join(large, keys, "left_anti")
        kind = nodes.schema["node"].dataType.simpleString()
        labels = _frame_components(small, keys, 1, _star_labels).selectExpr(*keys, f"CAST(node AS {kind}) AS node", f"CAST(labels[0] AS {kind}) AS label")
        if large is not None:
            labels = labels.unionByName(_star_components(own.join(large, keys, "left_semi"), keys))
    return nodes.join(labels, [*keys, "node"], "left").withColumn("label", F.coalesce("label", "node"))


def species_components(edges: DataFrame, nodes: DataFrame, keys: Sequence[str], anchor: str = "DNA", **kw) -> DataFrame:
    """Components of the protein graph: the anchor neither belongs to it nor bridges it."""
    return connected_components(protein_edges(edges, nodes, keys, anchor).select(*keys, "lo", "hi"), nodes.where(F.col("species") != anchor), keys, **kw)


def protein_edges(edges: DataFrame, nodes: DataFrame, keys: Sequence[str], anchor: str = "DNA") -> DataFrame:
    anchors = nodes.where(F.col("species") == anchor).select(*keys, F.col("node").alias("_a"))
    for end in ("lo", "hi"):
        edges = edges.join(anchors.withColumnRenamed("_a", end), [*keys, end], "left_anti")
    return edges


def components_by_cutoff(edges: DataFrame, nodes: DataFrame, keys: Sequence[str], cutoffs: Sequence[float], anchor: str = "DNA") -> DataFrame:
    """Components of the protein graph at every cutoff, from one contraction of the levelled edges: with ``cutoff_nm``."""
    proteins = nodes.where(F.col("species") != anchor)
    labelled = nested_components(protein_edges(edges, nodes, keys, anchor), proteins, keys, len(cutoffs))
    return labelled.withColumn("cutoff_nm", F.element_at(F.array(*[F.lit(float(c)) for c in sorted(cutoffs)]), F.col("level") + 1)).drop("level")


def nested_mask_edges(contact: DataFrame, blocks: DataFrame, keys: Sequence[str], masks: dict[str, list[int]]) -> tuple[DataFrame, list[str]]:
    """Contacts and covalent edges of masks that each hold the one before, with levels, and the masks in that order."""
    order = sorted(masks, key=lambda m: len(masks[m]))
    if any(not set(masks[a]) <= set(masks[b]) for a, b in zip(order, order[1:])):
        raise ValueError("each mask must hold the bonds of the smaller one")
    place = F.coalesce(*[F.when(F.col("mask") == m, i) for i, m in enumerate(order)])
    bonds = mask_edges(blocks, keys, masks).groupBy(*keys, "lo", "hi").agg(F.min(place).alias("level"))
    return contact.select(*keys, "lo", "hi", F.lit(0).alias("level")).unionByName(bonds), order


def components_by_mask(contact: DataFrame, blocks: DataFrame, nodes: DataFrame, keys: Sequence[str], masks: dict[str, list[int]]) -> DataFrame:
    """Components under every covalent mask, from one contraction: ``nodes`` with ``mask`` and ``label``."""
    edges, order = nested_mask_edges(contact, blocks, keys, masks)
    labelled = nested_components(edges, nodes, keys, len(order))
    return labelled.withColumn("mask", F.element_at(F.array(*[F.lit(m) for m in order]), F.col("level") + 1)).drop("level")


# ---------------------------------------------------------------------------------------- component metrics


def component_sizes(labelled: DataFrame, keys: Sequence[str], weight: str | None = None) -> DataFrame:
    return labelled.groupBy(*keys, "label").agg(
        F.count("*").alias("size"), F.sum(F.col(weight) if weight else F.lit(1)).cast("double").alias("weight")
    )


def cluster_metrics(labelled: DataFrame, keys: Sequence[str], weight: str = "length") -> DataFrame:
    """Framewise cluster metrics. Ties for the largest cluster go to the one with the smallest label.

    Moments of the size distribution are plain sums, so a frame with very many clusters still combines before the
    shuffle: the largest comes from ``max`` over a struct and the second largest from the two highest sizes.
    """
    sizes = component_sizes(labelled, keys, weight)
    top = F.max(F.struct(F.col("size").alias("size"), (-F.col("label")).alias("neg"), F.col("weight").alias("weight")))
    base = sizes.groupBy(*keys).agg(
        top.alias("_top"),
        F.sum("size").alias("n"),
        F.sum("weight").alias("total_weight"),
        F.sum(F.col("size").cast("double") * F.col("size")).alias("_s2"),
        F.count_if(F.col("size") >= 2).alias("n_clusters_size_ge_2"),
        F.count_if(F.col("size") == 1).alias("_ones"),
    )
    rest = (
        sizes.join(base.select(*keys, (-F.col("_top.neg")).alias("label")), [*keys, "label"], "left_anti")
        .groupBy(*keys)
        .agg(F.max("size").alias("_second"))
    )
    big, n = F.col("_top.size"), F.col("n")
    return base.join(rest, list(keys), "left").select(
        *keys,
        big.alias("largest_cluster_size"),
        ratio(big, n).alias("largest_cluster_fraction"),
        ratio(F.col("_top.weight"), F.col("total_weight")).alias("largest_cluster_residue_fraction"),
        F.coalesce("_second", F.lit(0)).alias("second_cluster_size"),
        ratio(F.coalesce("_second", F.lit(0)), n).alias("second_cluster_fraction"),
        ratio(F.col("_s2") - big.cast("double") * big, n - big).alias("finite_cluster_mean_size"),
        "n_clusters_size_ge_2",
        ratio(F.col("_ones"), n).alias("monomer_fraction"),
    )


def weighted_largest_component(labelled: DataFrame, keys: Sequence[str], weight: str) -> DataFrame:
    sizes = labelled.groupBy(*keys, "label").agg(F.sum(weight).alias("_w"))
    return sizes.groupBy(*keys).agg(ratio(F.max("_w"), F.sum("_w")).alias("largest_weight_fraction"))


def augmented_metrics(labelled: DataFrame, keys: Sequence[str], anchor: str = "DNA") -> DataFrame:
    """On the graph with the anchor: largest protein count of a component, and the anchor's own component."""
    protein = F.col("species") != anchor
    per = labelled.groupBy(*keys, "label").agg(
        F.count_if(protein).alias("_p"),
        F.count_if(F.col("species") == "MED1").alias("_m"),
        F.count_if(F.col("species") == "OCT4").alias("_o"),
        F.max(F.when(~protein, True).otherwise(False)).alias("_has"),
    )
    return per.groupBy(*keys).agg(
        ratio(F.max("_p"), F.sum("_p")).alias("augmented_largest_protein_fraction"),
        F.sum(F.when(F.col("_has"), F.col("_m"))).alias("DNA_component_MED1"),
        F.sum(F.when(F.col("_has"), F.col("_o"))).alias("DNA_component_OCT4"),
        ratio(F.sum(F.when(F.col("_has"), F.col("_p"))), F.sum("_p")).alias("DNA_component_protein_fraction"),
    )


def largest_component_nodes(labelled: DataFrame, edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Nodes of the largest component; ties go to the one with more internal edges, then the smallest label."""
    keys = list(keys)
    sizes = labelled.groupBy(*keys, "label").agg(F.count("*").alias("size"))
    inside = (
        edges.join(labelled.select(*keys, F.col("node").alias("lo"), "label"), [*keys, "lo"])
        .groupBy(*keys, "label")
        .agg(F.count("*").alias("internal"))
    )
    ranked = sizes.join(inside, [*keys, "label"], "left").withColumn("internal", F.coalesce("internal", F.lit(0)))
    best = ranked.groupBy(*keys).agg(F.max(F.struct("size", "internal", (-F.col("label")).alias("neg"))).alias("_b"))
    chosen = best.select(*keys, (-F.col("_b.neg")).alias("label"), F.col("_b.size").alias("size"), F.col("_b.internal").alias("internal"))
    return labelled.join(chosen, [*keys, "label"])


# ------------------------------------------------------------------------------------- degrees and densities


def degrees(edges: DataFrame, nodes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Degree of every node, zero included."""
    ends = edges.select(*keys, F.explode(F.array("lo", "hi")).alias("node")).groupBy(*keys, "node").agg(F.count("*").alias("degree"))
    return nodes.join(ends, [*keys, "node"], "left").withColumn("degree", F.coalesce("degree", F.lit(0)).cast("long"))


def degree_histogram(node_degrees: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sparse: a degree that does not occur has no row. Probability is over the nodes of the frame."""
    counts = node_degrees.groupBy(*keys, "degree").agg(F.count("*").alias("count"))
    totals = node_degrees.groupBy(*keys).agg(F.count("*").alias("_n"))
    return counts.join(totals, list(keys)).select(*keys, "degree", "count", ratio("count", "_n").alias("probability"))


def graph_metrics(edges: DataFrame, nodes: DataFrame, keys: Sequence[str], within_parent_pairs=None) -> DataFrame:
    """Edges, density, mean partners and free nodes per frame; ``within_parent_pairs`` reduces the denominator."""
    deg = degrees(edges, nodes, keys)
    out = deg.groupBy(*keys).agg(
        F.count("*").alias("n_nodes"),
        (F.sum("degree") / 2).cast("long").alias("n_edges"),
        F.avg("degree").alias("mean_partner_number"),
        F.avg((F.col("degree") == 0).cast("double")).alias("free_fraction"),
    )
    possible = pair_count("n_nodes")
    if within_parent_pairs is not None:
        out = out.join(within_parent_pairs, list(keys), "left")
        possible = possible - F.coalesce("within_pairs", F.lit(0))
    return out.withColumn("edge_density", ratio(F.col("n_edges"), possible)).drop("within_pairs")


def pair_kind_counts(edges: DataFrame, nodes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Edges per pair of species with their possible pairs and contact probability, one row per frame and kind.

    Possible pairs come from the species counts; pairs of nodes are never enumerated.
    """
    keys = list(keys)
    sp = nodes.select(*keys, "node", "species")
    typed = edges.join(sp.withColumnRenamed("node", "lo").withColumnRenamed("species", "_a"), [*keys, "lo"]).join(
        sp.withColumnRenamed("node", "hi").withColumnRenamed("species", "_b"), [*keys, "hi"]
    )
    letters = F.array_sort(F.array(F.substring("_a", 1, 1), F.substring("_b", 1, 1)))
    names = {"OO": "OO", "MM": "MM", "MO": "OM", "DO": "OD", "DM": "MD"}
    lookup = F.create_map(*[F.lit(v) for kv in names.items() for v in kv])
    counted = typed.withColumn("kind", lookup[F.array_join(letters, "")]).where("kind IS NOT NULL").groupBy(*keys, "kind").agg(F.count("*").alias("edges"))
    n = nodes.groupBy(*keys).agg(*[F.count_if(F.col("species") == s).alias(s) for s in ("OCT4", "MED1", "DNA")])
    kinds = F.array(
        *[
            F.struct(F.lit(k).alias("kind"), p.alias("possible"))
            for k, p in [
                ("OO", pair_count("OCT4")),
                ("MM", pair_count("MED1")),
                ("OM", F.col("OCT4").cast("double") * F.col("MED1")),
                ("OD", F.col("OCT4").cast("double") * F.col("DNA")),
                ("MD", F.col("MED1").cast("double") * F.col("DNA")),
            ]
        ]
    )
    dense = n.select(*keys, F.explode(kinds).alias("_k")).select(*keys, "_k.kind", "_k.possible")
    joined = dense.join(counted, [*keys, "kind"], "left").withColumn("edges", F.coalesce("edges", F.lit(0)))
    return joined.select(*keys, "kind", "edges", "possible", ratio("edges", "possible").alias("contact_probability"))


# ------------------------------------------------------------------------------------------------ anchor reach


def hop_classes(edges: DataFrame, nodes: DataFrame, keys: Sequence[str], anchor: str = "DNA", **kw) -> DataFrame:
    """Proteins linked to the anchor, by class: ``direct``, ``second`` (next to a direct one) or ``third_plus``."""
    keys = list(keys)
    edges = materialise(edges.select(*keys, "lo", "hi"), "edges")
    labelled = connected_components(edges, nodes, keys, **kw)
    anchors = labelled.where(F.col("species") == anchor).select(*keys, "label").distinct()
    linked = labelled.where(F.col("species") != anchor).join(anchors, [*keys, "label"], "left_semi")
    anchor_nodes = nodes.where(F.col("species") == anchor).select(*keys, F.col("node").alias("from"))
    both = edges.select(*keys, F.col("lo").alias("from"), F.col("hi").alias("node")).unionByName(
        edges.select(*keys, F.col("hi").alias("from"), F.col("lo").alias("node"))
    )
    direct = both.join(anchor_nodes, [*keys, "from"], "left_semi").select(*keys, "node").distinct()
    near = both.join(direct.withColumnRenamed("node", "from"), [*keys, "from"], "left_semi").select(*keys, "node").distinct()
    return (
        linked.join(direct.withColumn("_d", F.lit(True)), [*keys, "node"], "left")
        .join(near.withColumn("_s", F.lit(True)), [*keys, "node"], "left")
        .withColumn("hop", F.when(F.col("_d"), "direct").when(F.col("_s"), "second").otherwise("third_plus"))
        .drop("_d", "_s", "label")
    )


def hop_fractions(hops: DataFrame, nodes: DataFrame, keys: Sequence[str], anchor: str = "DNA") -> DataFrame:
    """Chain, residue-weighted and parent-distinct fractions of every hop class and of all linked proteins."""
    keys = list(keys)
    proteins = nodes.where(F.col("species") != anchor)
    totals = proteins.groupBy(*keys).agg(
        F.count("*").alias("_n"), F.sum("length").alias("_r"), F.count_distinct("parent").alias("_p")
    )
    scoped = hops.select(*keys, "length", "parent", F.explode(F.array("hop", F.lit("linked"))).alias("hop_class"))
    per = scoped.groupBy(*keys, "hop_class").agg(
        F.count("*").alias("_cn"), F.sum("length").alias("_cr"), F.count_distinct("parent").alias("_cp")
    )
    classes = F.explode(F.array(*[F.lit(c) for c in ("linked", "direct", "second", "third_plus")])).alias("hop_class")
    dense = totals.select(*keys, "_n", "_r", "_p", classes)
    zero = F.lit(0)
    return dense.join(per, [*keys, "hop_class"], "left").select(
        *keys,
        "hop_class",
        ratio(F.coalesce("_cn", zero), "_n").alias("physical_fraction"),
        ratio(F.coalesce("_cr", zero), "_r").alias("residue_fraction"),
        ratio(F.coalesce("_cp", zero), "_p").alias("parent_fraction"),
    )


def component_with_anchor(edges: DataFrame, nodes: DataFrame, attached: DataFrame, keys: Sequence[str], **kw) -> DataFrame:
    """Nodes reachable from a virtual anchor tied to the ``attached`` nodes.

    The anchor adds nothing but a common neighbour, so the answer is the components that hold an attached node.
    """
    labelled = connected_components(edges, nodes, keys, **kw)
    hit = labelled.join(attached.select(*keys, "node"), [*keys, "node"], "left_semi").select(*keys, "label").distinct()
    return labelled.join(hit, [*keys, "label"], "left_semi")


def indirect_associates(edges: DataFrame, nodes: DataFrame, keys: Sequence[str], via: str = "OCT4", of: str = "MED1", anchor: str = "DNA") -> DataFrame:
    """Nodes of species ``of`` next to an anchor-bound ``via`` node and not bound themselves."""
    keys = list(keys)
    sp = nodes.select(*keys, "node", "species")
    both = edges.select(*keys, F.col("lo").alias("from"), F.col("hi").alias("node")).unionByName(
        edges.select(*keys, F.col("hi").alias("from"), F.col("lo").alias("node"))
    )
    typed = both.join(sp, [*keys, "node"]).join(sp.select(*keys, F.col("node").alias("from"), F.col("species").alias("_fs")), [*keys, "from"])
    bound = typed.where(F.col("_fs") == anchor).select(*keys, "node", "species").distinct()
    bound_via = bound.where(F.col("species") == via).select(*keys, F.col("node").alias("from"))
    return (
        typed.where(F.col("species") == of)
        .join(bound_via, [*keys, "from"], "left_semi")
        .join(bound, [*keys, "node"], "left_anti")
        .select(*keys, "node", "species")
        .distinct()
    )


def select_nodes(mode: str, edges: DataFrame, nodes: DataFrame, keys: Sequence[str], anchor: str = "DNA", **kw) -> DataFrame:
    """Nodes shown for one selection mode: full, largest_component, dna_neighborhood, dna_associated or dna_linked."""
    keys = list(keys)
    if mode == "full":
        return nodes
    if mode == "largest_component":
        return largest_component_nodes(species_components(edges, nodes, keys, anchor, **kw), edges, keys).select(*nodes.columns)
    anchors = nodes.where(F.col("species") == anchor)
    if mode == "dna_linked":
        return hop_classes(edges, nodes, keys, anchor, **kw).select(*nodes.columns).unionByName(anchors)
    a = anchors.select(*keys, F.col("node").alias("from"))
    both = edges.select(*keys, F.col("lo").alias("from"), F.col("hi").alias("node")).unionByName(
        edges.select(*keys, F.col("hi").alias("from"), F.col("lo").alias("node"))
    )
    chosen = both.join(a, [*keys, "from"], "left_semi").select(*keys, "node")
    if mode == "dna_associated":
        chosen = chosen.unionByName(indirect_associates(edges, nodes, keys, anchor=anchor).select(*keys, "node"))
    elif mode != "dna_neighborhood":
        raise ValueError(f"unknown mode {mode}")
    chosen = chosen.unionByName(anchors.select(*keys, "node")).distinct()
    return nodes.join(chosen, [*keys, "node"], "left_semi")


# --------------------------------------------------------------------------------------- pair opportunities


def binding_categories(edges: DataFrame, proteins: DataFrame, contacts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Edges and possible pairs of every binding category, for any number of windows.

    ``contacts(keys, node, window)`` says which anchor windows a protein touches. Possible pairs follow from counts: of
    proteins, of bound ones, and of distinct pairs that share a window. Only the last are listed, by an equi-join on the
    window; all others are never listed.
    """
    keys = list(keys)
    touched = contacts.join(proteins.select(*keys, "node"), [*keys, "node"], "left_semi").select(*keys, "node", "window").distinct()
    bound = touched.select(*keys, "node").distinct()
    sizes = proteins.groupBy(*keys).agg(F.count("*").alias("n")).join(bound.groupBy(*keys).agg(F.count("*").alias("b")), keys, "left")
    pairs = (
        touched.withColumnRenamed("node", "lo")
        .join(touched.withColumnRenamed("node", "hi"), [*keys, "window"])
        .where("lo < hi")
        .select(*keys, "lo", "hi")
        .distinct()
    )
    sizes = sizes.join(pairs.groupBy(*keys).agg(F.count("*").alias("s")), keys, "left").fillna({"b": 0, "s": 0})
    free, n_bound, shared = F.col("n") - F.col("b"), F.col("b"), F.col("s")
    names = {
        "neither_bound": free * (free - 1) / 2,
        "only_one_bound": (free * n_bound).cast("double"),
        "both_bound_different_windows": n_bound * (n_bound - 1) / 2 - shared,
        "shared_window": shared.cast("double"),
    }
    dense = sizes.select(*keys, F.explode(F.array(*[F.struct(F.lit(k).alias("binding_category"), v.alias("opportunities")) for k, v in names.items()])).alias("_o")).select(*keys, "_o.*")
    flags = bound.withColumn("_f", F.lit(True))
    linked = (
        shared_window_edges(edges, touched, keys)
        .join(flags.withColumnRenamed("node", "lo").withColumnRenamed("_f", "_a"), [*keys, "lo"], "left")
        .join(flags.withColumnRenamed("node", "hi").withColumnRenamed("_f", "_b"), [*keys, "hi"], "left")
    )
    category = (
        F.when(F.col("shared_window"), "shared_window")
        .when(F.col("_a").isNull() & F.col("_b").isNull(), "neither_bound")
        .when(F.col("_a").isNull() | F.col("_b").isNull(), "only_one_bound")
        .otherwise("both_bound_different_windows")
    )
    both_known = proteins.select(*keys, F.col("node").alias("lo")), proteins.select(*keys, F.col("node").alias("hi"))
    linked = linked.join(both_known[0], [*keys, "lo"], "left_semi").join(both_known[1], [*keys, "hi"], "left_semi")
    linked = linked.groupBy(*keys, category.alias("binding_category")).agg(F.count("*").alias("edges"))
    return dense.join(linked, [*keys, "binding_category"], "left").fillna({"edges": 0}).select(*keys, "binding_category", "edges", "opportunities")


def shared_window_edges(edges: DataFrame, contacts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Edges flagged by whether both ends touch a common anchor window (a join through the edges, not all pairs)."""
    keys = list(keys)
    c = contacts.select(*keys, "node", "window").distinct()
    shared = (
        edges.join(c.withColumnRenamed("node", "lo"), [*keys, "lo"])
        .join(c.withColumnRenamed("node", "hi"), [*keys, "hi", "window"], "left_semi")
        .select(*keys, "lo", "hi")
        .distinct()
        .withColumn("_s", F.lit(True))
    )
    return edges.join(shared, [*keys, "lo", "hi"], "left").select(*keys, "lo", "hi", F.coalesce("_s", F.lit(False)).alias("shared_window"))


def contact_anchors(pairs: DataFrame, keys: Sequence[str], a: str = "molecule_i", b: str = "molecule_j") -> DataFrame:
    """The closest bead pair of every node pair; ties go to the smallest bead ids."""
    swap = F.col(a) > F.col(b)
    bead_lo, bead_hi = F.when(swap, F.col("j")).otherwise(F.col("i")), F.when(swap, F.col("i")).otherwise(F.col("j"))
    return (
        pairs.where(F.col(a) != F.col(b))
        .select(*keys, F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"), "d", bead_lo.alias("bead_lo"), bead_hi.alias("bead_hi"))
        .groupBy(*keys, "lo", "hi")
        .agg(F.min(F.struct("d", "bead_lo", "bead_hi")).alias("_m"))
        .select(*keys, "lo", "hi", F.col("_m.bead_lo").alias("bead_lo"), F.col("_m.bead_hi").alias("bead_hi"), F.col("_m.d").alias("d"))
    )
