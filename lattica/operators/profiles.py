"""Residue profiles and binned contact maps from bead contacts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions.scalars import per_hundred, ratio


def directed_contacts(pairs: DataFrame, keys: Sequence[str], columns: Sequence[str], a: str, b: str, species: str = "species") -> DataFrame:
    """Contacts between species ``a`` and ``b`` with the ``a`` bead's attributes as ``x_*`` and the other's as ``y_*``."""
    straight = (F.col(f"{species}_i") == a) & (F.col(f"{species}_j") == b)
    crossed = (F.col(f"{species}_i") == b) & (F.col(f"{species}_j") == a)
    out = []
    for c in columns:
        out.append(F.when(straight, F.col(f"{c}_i")).otherwise(F.col(f"{c}_j")).alias(f"x_{c}"))
        out.append(F.when(straight, F.col(f"{c}_j")).otherwise(F.col(f"{c}_i")).alias(f"y_{c}"))
    return pairs.where(straight | crossed).select(*keys, *out)


def residue_profile(contacts: DataFrame, chains: DataFrame, trajectory: Sequence[str], frame: str, length: int, node: str, residue: str) -> DataFrame:
    """Contact probability of every residue: distinct (frame, chain, residue) contacts over frames x chains.

    ``chains(trajectory, denominator)`` gives frames x chains; trajectories with a zero denominator have no profile,
    and every other trajectory has all ``length`` residues.
    """
    keys = list(trajectory)
    hits = contacts.select(*keys, frame, node, residue).distinct().groupBy(*keys, F.col(residue).alias("residue")).agg(F.count("*").alias("hits"))
    dense = chains.where("denominator > 0").select(*keys, "denominator", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(length - 1).cast("long"))).alias("residue"))
    return dense.join(hits, [*keys, "residue"], "left").select(
        *keys, (F.col("residue") + 1).alias("residue_index"), ratio(F.coalesce("hits", F.lit(0)), "denominator").alias("contact_probability")
    )


def contact_map(contacts: DataFrame, chains: DataFrame, trajectory: Sequence[str], distinct: Sequence[str], x_bins: int, y_bins: int) -> DataFrame:
    """Dense 2-D map: rows distinct in ``distinct`` + (x_bin, y_bin), counted per cell over the denominator."""
    keys = list(trajectory)
    cells = contacts.select(*keys, *distinct, "x_bin", "y_bin").distinct().groupBy(*keys, "x_bin", "y_bin").agg(F.count("*").alias("hits"))
    dense = (
        chains.where("denominator > 0")
        .select(*keys, "denominator", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(x_bins - 1).cast("long"))).alias("x_bin"))
        .select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(y_bins - 1).cast("long"))).alias("y_bin"))
    )
    return dense.join(cells, [*keys, "x_bin", "y_bin"], "left").select(
        *keys, "x_bin", "y_bin", ratio(F.coalesce("hits", F.lit(0)), "denominator").alias("contact_probability")
    )


def coverage(contacts: DataFrame, keys: Sequence[str], target: str, total: int, species: str = "x_species") -> DataFrame:
    """Fraction of the target's beads touched by each species and by any of them."""
    # One row per touched bead with a flag per species: the distinct count becomes a plain sum.
    touched = contacts.groupBy(*keys, target).agg(
        F.max((F.col(species) == "OCT4").cast("int")).alias("_o"), F.max((F.col(species) == "MED1").cast("int")).alias("_m")
    )
    return touched.groupBy(*keys).agg(
        (F.sum("_o") / total).alias("fraction_OCT4"), (F.sum("_m") / total).alias("fraction_MED1"), (F.count("*") / total).alias("fraction_any")
    )


def contact_density(pairs: DataFrame, beads: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cross-parent protein contacts per 100 residues, and contact ends per 100 residues of each species."""
    keys = list(keys)
    cross = pairs.where("species_i <> 'DNA' AND species_j <> 'DNA' AND parent_i <> parent_j").groupBy(*keys).agg(
        F.count("*").alias("_c"), *[F.sum(F.expr(f"int(species_i = '{s}') + int(species_j = '{s}')")).alias(f"_{s}") for s in ("MED1", "OCT4")]
    )
    n = beads.groupBy(*keys).agg(F.count_if(F.col("species") != "DNA").alias("n"), *[F.count_if(F.col("species") == s).alias(f"n_{s}") for s in ("MED1", "OCT4")])
    zero = F.lit(0)
    return n.join(cross, keys, "left").select(
        *keys,
        per_hundred(F.coalesce("_c", zero), "n").alias("contacts_per_100"),
        *[per_hundred(F.coalesce(f"_{s}", zero), f"n_{s}").alias(f"{s}_incidences_per_100") for s in ("MED1", "OCT4")],
    )


def sibling_pairs(pairs: DataFrame, keys: Sequence[str], species: str = "MED1") -> DataFrame:
    """Contacts between different fragments of one parent (excluded from the graphs): bead pairs and molecule pairs."""
    sibling = pairs.where(F.expr(f"species_i = '{species}' AND species_j = '{species}' AND parent_i = parent_j AND molecule_i <> molecule_j"))
    per = sibling.groupBy(*keys, F.least("molecule_i", "molecule_j").alias("_a"), F.greatest("molecule_i", "molecule_j").alias("_b")).agg(F.count("*").alias("_n"))
    return per.groupBy(*keys).agg(F.sum("_n").alias("sibling_bead_pairs"), F.count("*").alias("sibling_molecule_pairs"))
