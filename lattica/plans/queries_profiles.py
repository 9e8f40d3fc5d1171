"""Queries over residue profiles, contact maps and radial distances."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattica.functions import scalars as S
from lattica.operators import contrasts, graph, histograms, polymer, profiles, quantiles, selection, spatial, statistics
from lattica.plans import roles
from lattica.plans.queries_graph import NEAREST_SQL, nearest
from lattica.plans.queries_sequences import WHOLE_SQL
from lattica.plans.registry import Tables, query
from lattica.session import materialise
from lattica.sources import tables
from lattica.plans.roles import BEADS_SQL, EDGES_SQL, KEYS, PAIRS_SQL

K = "system:s replicate:s frame:i"
TRAJ = ["system", "replicate"]
COLUMNS = ["molecule", "residue", "species"]


def primary(t: Tables) -> DataFrame:
    return roles.pairs(t, roles.PRIMARY).where("d < 1.2")


def chain_frames(t: Tables, species: str, other: str | None = None) -> DataFrame:
    """Frames x chains of a species (x chains of another one) per trajectory, from the molecules present."""
    n = roles.nodes(t).groupBy(*KEYS).agg(F.count_if(F.col("species") == species).alias("a"), F.count_if(F.col("species") == (other or species)).alias("b"))
    return n.groupBy(*TRAJ).agg(F.sum(F.col("a") * F.col("b") if other else F.col("a")).alias("denominator"))


CONTACT_SQL = (
    PAIRS_SQL
    + """
nodes AS MATERIALIZED (SELECT system, replicate, frame, molecule AS node, ANY_VALUE(species) AS species FROM beads GROUP BY ALL),
om AS MATERIALIZED (SELECT system, replicate, frame, molecule_i AS xm, residue_i AS xr, molecule_j AS ym, residue_j AS yr FROM pairs WHERE d < 1.2 AND species_i = 'MED1' AND species_j = 'OCT4'
   UNION ALL SELECT system, replicate, frame, molecule_j, residue_j, molecule_i, residue_i FROM pairs WHERE d < 1.2 AND species_i = 'OCT4' AND species_j = 'MED1'),
od AS MATERIALIZED (SELECT system, replicate, frame, molecule_i AS xm, residue_i AS xr, residue_j AS yr FROM pairs WHERE d < 1.2 AND species_i = 'OCT4' AND species_j = 'DNA'
   UNION ALL SELECT system, replicate, frame, molecule_j, residue_j, residue_i FROM pairs WHERE d < 1.2 AND species_i = 'DNA' AND species_j = 'OCT4'),
"""
)

# A side and its partner: whose residues are profiled, and what they touch.
PROFILES = [("MED1", "OCT4"), ("OCT4", "MED1"), ("MED1", "DNA"), ("OCT4", "DNA")]
RESIDUES = {"MED1": roles.MED1_RESIDUES, "OCT4": roles.OCT4_RESIDUES}

PROFILE_SQL = (
    CONTACT_SQL
    + """
sides AS MATERIALIZED (SELECT system, replicate, frame, species_i AS side, molecule_i AS m, residue_i AS r, species_j AS partner FROM pairs WHERE d < 1.2 AND species_i <> species_j
   UNION ALL SELECT system, replicate, frame, species_j, molecule_j, residue_j, species_i FROM pairs WHERE d < 1.2 AND species_i <> species_j),
profile AS (SELECT s.system, s.replicate, p.side, p.partner, k.r + 1 AS residue_index, COALESCE(h, 0) / den AS contact_probability FROM
   (VALUES ('MED1', 'OCT4', 200), ('OCT4', 'MED1', 60), ('MED1', 'DNA', 200), ('OCT4', 'DNA', 60)) p(side, partner, n)
   JOIN (SELECT system, replicate, species, COUNT(*) AS den FROM nodes GROUP BY ALL) s ON s.species = p.side
   JOIN (SELECT UNNEST(RANGE(0, 200)) AS r) k ON k.r < p.n
   LEFT JOIN (SELECT system, replicate, side, partner, r, COUNT(*) AS h FROM (SELECT DISTINCT system, replicate, frame, side, partner, m, r FROM sides) GROUP BY ALL) c
     ON c.system = s.system AND c.replicate = s.replicate AND c.side = p.side AND c.partner = p.partner AND c.r = k.r),
"""
)


def site_profiles(t: Tables) -> DataFrame:
    """Contact profiles of all four sides."""
    out = None
    for side, partner in PROFILES:
        c = profiles.directed_contacts(primary(t), KEYS, COLUMNS, side, partner)
        part = profiles.residue_profile(c, chain_frames(t, side).where("denominator > 0"), TRAJ, "frame", RESIDUES[side], "x_molecule", "x_residue")
        part = part.withColumn("side", F.lit(side)).withColumn("partner", F.lit(partner))
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "a9_residue_profile",
    "system:s side:s partner:s residue_index:i contact_probability_mean:f9 contact_probability_sd:f9 contact_probability_n:i",
    """SELECT system, side, partner, residue_index, AVG(contact_probability) AS contact_probability_mean, STDDEV_SAMP(contact_probability) AS contact_probability_sd,
         COUNT(*) AS contact_probability_n FROM profile GROUP BY ALL""",
    PROFILE_SQL,
)
def a9_residue_profile(t: Tables) -> DataFrame:
    """Dense contact profiles over residues, then mean and SD over trajectories."""
    return statistics.two_level_stats(site_profiles(t), ["system", "side", "partner", "residue_index"], ["contact_probability"])


@query(
    "p23_unfragmented_profile",
    "system:s side:s partner:s residue_index:i low:f9 high:f9 rank:i",
    """SELECT system, side, partner, residue_index, GREATEST(m - s, 0) AS low, m + s AS high, rank FROM (
         SELECT *, ROW_NUMBER() OVER (PARTITION BY system, side, partner ORDER BY ROUND(m, 12) DESC, residue_index) AS rank FROM (
           SELECT system, side, partner, residue_index, f * am AS m, f * asd AS s FROM (
             SELECT system, side, partner, residue_index, CASE WHEN side = 'MED1' THEN 2 ELSE 1 END AS f, AVG(contact_probability) AS am, STDDEV_SAMP(contact_probability) AS asd
             FROM profile GROUP BY system, side, partner, residue_index))) WHERE rank <= 10""",
    PROFILE_SQL,
)
def p23_unfragmented_profile(t: Tables) -> DataFrame:
    """Per-chain profiles to per-residue probability, SD band with floor 0, top ten residues."""
    g = statistics.two_level_stats(site_profiles(t), ["system", "side", "partner", "residue_index"], ["contact_probability"])
    g = g.withColumn("fragments", F.lit(2))
    m, s = (S.undo_fragments(f"contact_probability_{k}", "side", "fragments") for k in ("mean", "sd"))
    g = g.withColumn("low", F.greatest(m - s, F.lit(0.0))).withColumn("high", m + s).withColumn("_rank", F.round(m, 12))
    return selection.top_k(g, ["system", "side", "partner"], "_rank", ["residue_index"])


@query(
    "a10_contact_map_om",
    "system:s replicate:s x_bin:i y_bin:i contact_probability:f9",
    """SELECT s.system, s.replicate, x AS x_bin, y AS y_bin, COALESCE(h, 0) / den AS contact_probability FROM
         (SELECT system, replicate, SUM(m * o) AS den FROM (SELECT system, replicate, frame, COUNT(*) FILTER (species = 'MED1') AS m, COUNT(*) FILTER (species = 'OCT4') AS o
            FROM nodes GROUP BY ALL) GROUP BY ALL) s CROSS JOIN (SELECT UNNEST(RANGE(0, 4)) AS x) CROSS JOIN (SELECT UNNEST(RANGE(0, 3)) AS y)
         LEFT JOIN (SELECT system, replicate, xb, yb, COUNT(*) AS h FROM (SELECT DISTINCT system, replicate, frame, xm, ym, xr // 50 AS xb, yr // 20 AS yb FROM om) GROUP BY ALL) c
           ON c.system = s.system AND c.replicate = s.replicate AND c.xb = x AND c.yb = y""",
    CONTACT_SQL,
)
def a10_contact_map_om(t: Tables) -> DataFrame:
    """Binned contact map between the two protein species, distinct per pair of chains."""
    c = profiles.directed_contacts(primary(t), KEYS, COLUMNS, "MED1", "OCT4")
    c = c.withColumn("x_bin", S.int_div("x_residue", 50)).withColumn("y_bin", S.int_div("y_residue", 20))
    return profiles.contact_map(c, chain_frames(t, "MED1", "OCT4"), TRAJ, ["frame", "x_molecule", "y_molecule"], 4, 3)


@query(
    "a10_contact_map_od",
    "system:s replicate:s x_bin:i y_bin:i contact_probability:f9",
    """SELECT s.system, s.replicate, x AS x_bin, y AS y_bin, COALESCE(h, 0) / den AS contact_probability FROM
         (SELECT system, replicate, COUNT(*) FILTER (species = 'OCT4') AS den FROM nodes GROUP BY ALL) s CROSS JOIN (SELECT UNNEST(RANGE(0, 3)) AS x) CROSS JOIN (SELECT UNNEST(RANGE(0, 4)) AS y)
         LEFT JOIN (SELECT system, replicate, xb, yb, COUNT(*) AS h FROM (SELECT DISTINCT system, replicate, frame, xm, xr // 20 AS xb, LEAST(yr, 79 - yr) // 10 AS yb FROM od) GROUP BY ALL) c
           ON c.system = s.system AND c.replicate = s.replicate AND c.xb = x AND c.yb = y""",
    CONTACT_SQL,
)
def a10_contact_map_od(t: Tables) -> DataFrame:
    """Contact map of a species against base-pair bins of the anchor."""
    c = profiles.directed_contacts(primary(t), KEYS, COLUMNS, "OCT4", "DNA")
    c = c.withColumn("x_bin", S.int_div("x_residue", 20)).withColumn("y_bin", S.int_div(S.base_pair_index("y_residue", roles.DNA_BEADS), 10))
    return profiles.contact_map(c, chain_frames(t, "OCT4"), TRAJ, ["frame", "x_molecule"], 3, 4)


@query(
    "a10_contact_map_md",
    "system:s replicate:s x_bin:i y_bin:i contact_probability:f9",
    """SELECT s.system, s.replicate, x AS x_bin, y AS y_bin, COALESCE(h, 0) / den AS contact_probability FROM
         (SELECT system, replicate, COUNT(*) FILTER (species = 'MED1') AS den FROM nodes GROUP BY ALL) s CROSS JOIN (SELECT UNNEST(RANGE(0, 4)) AS x) CROSS JOIN (SELECT UNNEST(RANGE(0, 4)) AS y)
         LEFT JOIN (SELECT system, replicate, xb, yb, COUNT(*) AS h FROM (SELECT DISTINCT system, replicate, frame, xm, xr // 50 AS xb, LEAST(yr, 79 - yr) // 10 AS yb FROM md) GROUP BY ALL) c
           ON c.system = s.system AND c.replicate = s.replicate AND c.xb = x AND c.yb = y""",
    CONTACT_SQL
    + """
md AS MATERIALIZED (SELECT system, replicate, frame, molecule_i AS xm, residue_i AS xr, residue_j AS yr FROM pairs WHERE d < 1.2 AND species_i = 'MED1' AND species_j = 'DNA'
   UNION ALL SELECT system, replicate, frame, molecule_j, residue_j, residue_i FROM pairs WHERE d < 1.2 AND species_i = 'DNA' AND species_j = 'MED1'),
""",
)
def a10_contact_map_md(t: Tables) -> DataFrame:
    """Contact map of the other species against base-pair bins of the anchor."""
    c = profiles.directed_contacts(primary(t), KEYS, COLUMNS, "MED1", "DNA")
    c = c.withColumn("x_bin", S.int_div("x_residue", 50)).withColumn("y_bin", S.int_div(S.base_pair_index("y_residue", roles.DNA_BEADS), 10))
    return profiles.contact_map(c, chain_frames(t, "MED1"), TRAJ, ["frame", "x_molecule"], 4, 4)


@query(
    "a18_anchor_coverage",
    f"{K} fraction_OCT4:f fraction_MED1:f fraction_any:f",
    """SELECT system, replicate, frame, COUNT(DISTINCT r) FILTER (s = 'OCT4') / 80 AS fraction_OCT4, COUNT(DISTINCT r) FILTER (s = 'MED1') / 80 AS fraction_MED1, COUNT(DISTINCT r) / 80 AS fraction_any
       FROM (SELECT system, replicate, frame, CASE WHEN species_i = 'DNA' THEN residue_i ELSE residue_j END AS r, CASE WHEN species_i = 'DNA' THEN species_j ELSE species_i END AS s
         FROM pairs WHERE d < 1.2 AND (species_i = 'DNA') <> (species_j = 'DNA')) GROUP BY ALL""",
    PAIRS_SQL,
)
def a18_anchor_coverage(t: Tables) -> DataFrame:
    """Share of the anchor's beads touched by each species and by any."""
    p = primary(t).where("(species_i = 'DNA') <> (species_j = 'DNA')")
    c = p.selectExpr(*KEYS, "if(species_i = 'DNA', residue_i, residue_j) AS target", "if(species_i = 'DNA', species_j, species_i) AS x_species")
    return profiles.coverage(c, KEYS, "target", roles.DNA_BEADS)


@query(
    "a22_contacts_per_100",
    f"{K} contacts_per_100:f MED1_incidences_per_100:f OCT4_incidences_per_100:f",
    """SELECT b.system, b.replicate, b.frame, COALESCE(c, 0) * 100.0 / n AS contacts_per_100, COALESCE(cm, 0) * 100.0 / NULLIF(nm, 0) AS MED1_incidences_per_100,
         COALESCE(co, 0) * 100.0 / NULLIF(no, 0) AS OCT4_incidences_per_100
       FROM (SELECT system, replicate, frame, COUNT(*) FILTER (species <> 'DNA') AS n, COUNT(*) FILTER (species = 'MED1') AS nm, COUNT(*) FILTER (species = 'OCT4') AS no FROM beads GROUP BY ALL) b
       LEFT JOIN (SELECT frame, COUNT(*) AS c, SUM((species_i = 'MED1')::INT + (species_j = 'MED1')::INT) AS cm, SUM((species_i = 'OCT4')::INT + (species_j = 'OCT4')::INT) AS co
         FROM pairs WHERE d < 1.2 AND species_i <> 'DNA' AND species_j <> 'DNA' AND parent_i <> parent_j GROUP BY ALL) USING (frame)""",
    PAIRS_SQL,
)
def a22_contacts_per_100(t: Tables) -> DataFrame:
    """Contacts and contact ends per 100 residues."""
    return profiles.contact_density(primary(t), roles.beads(t), KEYS)


@query(
    "a23_sibling_pairs",
    f"{K} sibling_bead_pairs:i sibling_molecule_pairs:i",
    """SELECT system, replicate, frame, COUNT(*) AS sibling_bead_pairs, COUNT(DISTINCT (LEAST(molecule_i, molecule_j), GREATEST(molecule_i, molecule_j))) AS sibling_molecule_pairs
       FROM pairs WHERE d < 1.2 AND species_i = 'MED1' AND species_j = 'MED1' AND parent_i = parent_j AND molecule_i <> molecule_j GROUP BY ALL""",
    PAIRS_SQL,
)
def a23_sibling_pairs(t: Tables) -> DataFrame:
    """Contacts between fragments of one parent, which the graphs leave out."""
    return profiles.sibling_pairs(primary(t), KEYS)


# ------------------------------------------------------------------------------------------------ radial distances


@query(
    "a11_pooled_histogram",
    "system:s replicate:s bin:i count:i probability:f9 cumulative_probability:f9",
    """SELECT system, replicate, bin, count, count / SUM(count) OVER (PARTITION BY system, replicate) AS probability,
         SUM(count) OVER (PARTITION BY system, replicate ORDER BY bin) / SUM(count) OVER (PARTITION BY system, replicate) AS cumulative_probability FROM (
         SELECT s.system, s.replicate, b AS bin, COALESCE(n, 0) AS count FROM (SELECT DISTINCT system, replicate FROM nearest) s CROSS JOIN (SELECT UNNEST(RANGE(1, 33)) AS b)
         LEFT JOIN (SELECT system, replicate, LEAST(FLOOR(distance / 0.25), 31)::BIGINT + 1 AS bin, COUNT(*) AS n FROM nearest GROUP BY ALL) h ON h.system = s.system AND h.replicate = s.replicate AND h.bin = b)""",
    NEAREST_SQL,
)
def a11_pooled_histogram(t: Tables) -> DataFrame:
    """Pooled distance histogram with its running total; the last bin takes the overflow (here from 7.75)."""
    return histograms.pooled_histogram(nearest(t), TRAJ, high=7.75, bins=31)


A12_SQL = (
    NEAREST_SQL
    + """
wd AS (SELECT *, 1.0 / COUNT(*) OVER (PARTITION BY frame, parent) AS w, LEAST(FLOOR(distance / 0.25), 31)::BIGINT + 1 AS bin FROM nearest),
typed AS (SELECT *, 'all' AS type FROM wd UNION ALL SELECT *, species AS type FROM wd),
perbin AS (SELECT system, replicate, type, frame, bin, SUM(w) AS w FROM typed GROUP BY ALL),
perframe AS (SELECT frame, type, SUM(w) AS tot FROM perbin GROUP BY ALL),
fn AS (SELECT s.system, s.replicate, v.type, b AS bin, COALESCE(w, 0) / n_frames AS frame_mean_count, COALESCE(p, 0) / valid_frames AS frame_mean_probability, valid_frames FROM
   (SELECT system, replicate, COUNT(DISTINCT frame) AS n_frames FROM beads GROUP BY ALL) s
   JOIN (SELECT system, replicate, type, COUNT(DISTINCT frame) AS valid_frames FROM perbin GROUP BY ALL) v USING (system, replicate)
   CROSS JOIN (SELECT UNNEST(RANGE(1, 33)) AS b)
   LEFT JOIN (SELECT system, replicate, type, bin, SUM(w) AS w, SUM(w / tot) AS p FROM perbin JOIN perframe USING (frame, type) GROUP BY ALL) h
     ON h.system = s.system AND h.replicate = s.replicate AND h.type = v.type AND h.bin = b),
"""
)


def weighted_histogram(t: Tables) -> DataFrame:
    """Histograms of parent-weighted distances for all proteins and for each species."""
    d = quantiles.parent_weights(materialise(nearest(t), "distances"), KEYS)
    d = d.withColumn("type", F.explode(F.array(F.lit("all"), F.col("species"))))
    frames = roles.beads(t).select(*KEYS).distinct().withColumn("type", F.explode(F.array(*[F.lit(x) for x in ("all", "OCT4", "MED1")])))
    return histograms.frame_normalised_histogram(d, frames, [*TRAJ, "type"], weight="weight", high=7.75, bins=31)


@query(
    "a12_frame_normalised_histogram",
    "system:s replicate:s type:s bin:i frame_mean_count:f9 frame_mean_probability:f9 cumulative_probability:f9 valid_frames:i",
    "SELECT *, SUM(frame_mean_probability) OVER (PARTITION BY system, replicate, type ORDER BY bin) AS cumulative_probability FROM fn",
    A12_SQL,
)
def a12_frame_normalised_histogram(t: Tables) -> DataFrame:
    """Parent-weighted distances, normalised per frame, averaged over frames, by type."""
    return weighted_histogram(t)


@query(
    "a29_rebinned_profile",
    "system:s type:s bin_start_nm:f frame_mean_count:f9",
    """SELECT system, type, bin_start_nm, AVG(v) AS frame_mean_count FROM (SELECT system, replicate, type, FLOOR((bin - 1) * 0.25) AS bin_start_nm, SUM(frame_mean_count) AS v FROM fn GROUP BY ALL) GROUP BY ALL""",
    A12_SQL,
)
def a29_rebinned_profile(t: Tables) -> DataFrame:
    """Fine bins summed to 1 nm per trajectory, then averaged, by type."""
    return histograms.rebin(weighted_histogram(t), [*TRAJ, "type"], ["system", "type"], "frame_mean_count")


@query(
    "a13_frame_reach",
    f"{K} q90:f within:f",
    "SELECT system, replicate, frame, QUANTILE_CONT(distance, 0.9) AS q90, AVG(CASE WHEN distance <= 3 THEN 1.0 ELSE 0.0 END) AS within FROM nearest GROUP BY ALL",
    NEAREST_SQL,
)
def a13_frame_reach(t: Tables) -> DataFrame:
    """Interpolated q90 of every frame and the share of distances within a threshold."""
    d = materialise(nearest(t), "distances")
    near = d.groupBy(*KEYS).agg(F.avg((F.col("distance") <= 3).cast("double")).alias("within"))
    return quantiles.stored_linear_quantile(d, KEYS, "distance", 0.9, out="q90").join(near, KEYS)


@query(
    "a16_distance_summary",
    f"{K} species:s count:i total_weight:f mean_nm:f q90_nm:f",
    """SELECT a.*, b.q90_nm FROM (SELECT system, replicate, frame, species, COUNT(*) AS count, SUM(w) AS total_weight, SUM(distance * w) / SUM(w) AS mean_nm FROM wq GROUP BY ALL) a JOIN
         (SELECT frame, species, MIN(distance) AS q90_nm FROM (SELECT *, SUM(w) OVER (PARTITION BY frame, species ORDER BY distance) AS c, SUM(w) OVER (PARTITION BY frame, species) AS tot FROM wq)
          WHERE c >= CAST(0.9 AS DOUBLE) * tot GROUP BY ALL) b USING (frame, species)""",
    NEAREST_SQL + "wq AS MATERIALIZED (SELECT *, CAST(1 + molecule % 4 AS DOUBLE) AS w FROM nearest),",
)
def a16_distance_summary(t: Tables) -> DataFrame:
    """Count, weight, weighted mean and step q90 per frame and species."""
    return quantiles.stored_distance_summary(materialise(nearest(t), "distances").withColumn("w", 1 + F.col("molecule") % 4), [*KEYS, "species"], weight="w")


SCOPE_SQL = (
    NEAREST_SQL
    + WHOLE_SQL.removeprefix(BEADS_SQL)
    + """
centres AS MATERIALIZED (SELECT system, replicate, frame, 'chain_centre' AS scope, species, molecule AS id, AVG(ux) AS x, AVG(uy) AS y, AVG(uz) AS z FROM whole WHERE species <> 'DNA' GROUP BY ALL
   UNION ALL SELECT system, replicate, frame, 'block_centre', species, block, AVG(ux), AVG(uy), AVG(uz) FROM whole WHERE species <> 'DNA' GROUP BY ALL),
cdist AS MATERIALIZED (SELECT c.system, c.replicate, c.frame, c.scope, c.species, c.id, MIN(SQRT("""
    + " + ".join(f"POWER(c.{a} - b.{a} - 20.0 * ROUND_EVEN(CAST((c.{a} - b.{a}) / 20.0 AS DOUBLE), 0), 2)" for a in "xyz")
    + """)) AS distance FROM centres c JOIN beads b ON b.frame = c.frame AND b.species = 'DNA' GROUP BY ALL),
scoped AS (SELECT system, replicate, frame, 'bead' AS scope, species, distance, 1.0::DOUBLE AS w FROM nearest
   UNION ALL SELECT system, replicate, frame, 'parent_weighted_bead', species, distance, 1.0::DOUBLE / COUNT(*) OVER (PARTITION BY frame, parent) FROM nearest
   UNION ALL SELECT system, replicate, frame, scope, species, distance, 1.0::DOUBLE FROM cdist),
scope_type AS MATERIALIZED (SELECT *, 'all' AS protein_type FROM scoped UNION ALL SELECT *, species AS protein_type FROM scoped),
"""
)


def centre_distances(t: Tables) -> DataFrame:
    """Distance of every chain's and every block's centre to the nearest anchor bead of its frame."""
    proteins = roles.beads(t).where("species <> 'DNA' AND x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL")
    whole = polymer.unwrap_frames(proteins, KEYS, "molecule", "bead", roles.BOX, ["species", "block"], roles.frame_sizes(t), clustered=True)
    kinds = F.explode(F.array(F.struct(F.lit("chain_centre").alias("scope"), F.col("molecule").alias("id")), F.struct(F.lit("block_centre").alias("scope"), F.col("block").alias("id"))))
    each = whole.select(*KEYS, "species", "ux", "uy", "uz", kinds.alias("_k")).select(*KEYS, "species", "ux", "uy", "uz", "_k.*")
    centres = each.groupBy(*KEYS, "species", "scope", "id").agg(*[F.avg(f"u{a}").alias(a) for a in "xyz"])
    return spatial.nearest_target_distance(
        centres.withColumn("bead", F.struct("scope", "id")), roles.beads(t).where("species = 'DNA'"), KEYS, roles.BOX, carry=["species"]
    ).select(*KEYS, "bead.scope", "species", "distance")


@query(
    "a14_scope_summary",
    f"{K} scope:s protein_type:s count:i total_weight:f mean_nm:f q90_nm:f",
    """SELECT a.*, b.q90_nm FROM (SELECT system, replicate, frame, scope, protein_type, COUNT(*) AS count, SUM(w) AS total_weight, SUM(distance * w) / SUM(w) AS mean_nm FROM scope_type GROUP BY ALL) a JOIN
         (SELECT frame, scope, protein_type, MIN(distance) AS q90_nm FROM (SELECT *, SUM(w) OVER (PARTITION BY frame, scope, protein_type ORDER BY distance) AS c,
            SUM(w) OVER (PARTITION BY frame, scope, protein_type) AS tot FROM scope_type) WHERE c >= CAST(0.9 AS DOUBLE) * tot * (1 - 1e-12) GROUP BY ALL) b USING (frame, scope, protein_type)""",
    SCOPE_SQL,
)
def a14_scope_summary(t: Tables) -> DataFrame:
    """Distances of beads, parent-weighted beads, chain centres and block centres, for all proteins and each species."""
    beads = materialise(nearest(t), "distances")
    plain = beads.select(*KEYS, F.lit("bead").alias("scope"), "species", "distance", F.lit(1.0).alias("weight"))
    weighted = quantiles.parent_weights(beads, KEYS).select(*KEYS, F.lit("parent_weighted_bead").alias("scope"), "species", "distance", "weight")
    scoped = plain.unionByName(weighted).unionByName(centre_distances(t).withColumn("weight", F.lit(1.0)))
    return quantiles.stored_distance_summary(materialise(scoped, "scopes"), [*KEYS, "scope"], weight="weight", kind="species", out="protein_type")


@query(
    "v7_histogram_additivity",
    "system:s replicate:s gap:i last:f",
    """SELECT system, replicate, MAX(ABS(al - a - b)) AS gap, MAX(c) AS last FROM (SELECT system, replicate, bin, COUNT(*) AS al, COUNT(*) FILTER (species = 'OCT4') AS a, COUNT(*) FILTER (species = 'MED1') AS b, 1.0 AS c
         FROM (SELECT *, FLOOR(distance / 0.25) AS bin FROM nearest) GROUP BY ALL) GROUP BY ALL""",
    NEAREST_SQL,
)
def v7_histogram_additivity(t: Tables) -> DataFrame:
    """V7: species histograms add up to the whole one and its running total ends at 1."""
    d = materialise(nearest(t), "distances")
    both = histograms.pooled_histogram(d, TRAJ, high=7.75, bins=31)
    split = histograms.pooled_histogram(d, [*TRAJ, "species"], high=7.75, bins=31).groupBy(*TRAJ, "bin").agg(F.sum("count").alias("parts"))
    return both.join(split, [*TRAJ, "bin"]).groupBy(*TRAJ).agg(F.max(F.abs(F.col("count") - F.col("parts"))).alias("gap"), F.max("cumulative_probability").alias("last"))


# ------------------------------------------------------------------------------------------------ tables of panels


@query(
    "a28_arm_pivot",
    "replicate:s S0:f S1:f S2:f S3:f",
    """SELECT replicate, MAX(v) FILTER (system = 'S0') AS S0, MAX(v) FILTER (system = 'S1') AS S1, MAX(v) FILTER (system = 'S2') AS S2, MAX(v) FILTER (system = 'S3') AS S3
       FROM (SELECT system, replicate, AVG(distance) AS v FROM nearest GROUP BY ALL) GROUP BY ALL HAVING COUNT(v) = 4""",
    NEAREST_SQL,
)
def a28_arm_pivot(t: Tables) -> DataFrame:
    """Long to wide by arm, complete arms only."""
    rep = nearest(t).groupBy(*TRAJ).agg(F.avg("distance").alias("value"))
    return contrasts.arms_wide(rep, ["replicate"], "system", {s: s for s in ("S0", "S1", "S2", "S3")})


@query(
    "a31_contact_matrix",
    "system:s OO:f9 OM:f9 MM:f9 maximum:f9",
    """SELECT *, MAX(GREATEST(OO, OM, MM)) OVER () AS maximum FROM (SELECT system, AVG(v) FILTER (kind = 'OO') AS OO, AVG(v) FILTER (kind = 'OM') AS OM, AVG(v) FILTER (kind = 'MM') AS MM
       FROM (SELECT system, replicate, kind, AVG(p) AS v FROM (
         SELECT b.*, CASE WHEN possible > 0 THEN COALESCE(e, 0) / possible END AS p FROM (
           SELECT system, replicate, frame, UNNEST(['OO', 'MM', 'OM']) AS kind, UNNEST([o * (o - 1) / 2, m * (m - 1) / 2, o * m]) AS possible
           FROM (SELECT system, replicate, frame, COUNT(*) FILTER (species = 'OCT4')::DOUBLE AS o, COUNT(*) FILTER (species = 'MED1')::DOUBLE AS m FROM nodes GROUP BY ALL)) b
         LEFT JOIN (SELECT e.frame, CASE WHEN a.species <> c.species THEN 'OM' WHEN a.species = 'OCT4' THEN 'OO' ELSE 'MM' END AS kind, COUNT(*) AS e
           FROM edges e JOIN nodes a ON e.frame = a.frame AND e.lo = a.node JOIN nodes c ON e.frame = c.frame AND e.hi = c.node
           WHERE a.species <> 'DNA' AND c.species <> 'DNA' GROUP BY ALL) h USING (frame, kind)) GROUP BY ALL) GROUP BY ALL)""",
    EDGES_SQL,
)
def a31_contact_matrix(t: Tables) -> DataFrame:
    """Contact probabilities of systems x pair kinds, means over frames, then trajectories, and the overall maximum."""
    kinds = graph.pair_kind_counts(roles.edges(t), roles.nodes(t), KEYS).where("kind IN ('OO', 'OM', 'MM')")
    rep = statistics.trajectory_means(kinds, [*TRAJ, "kind"], ["contact_probability"])
    matrix = rep.groupBy("system").agg(*[F.avg(F.when(F.col("kind") == k, F.col("contact_probability"))).alias(k) for k in ("OO", "OM", "MM")])
    return matrix.withColumn("maximum", F.max(F.greatest("OO", "OM", "MM")).over(W.partitionBy()))  # a row per system


@query(
    "a32_repeat_counts",
    "system:s planned:i available:i included:i basis:s",
    """SELECT system, COUNT(*) AS planned, COUNT(*) FILTER (av) AS available, COUNT(*) FILTER (inc) AS included,
         STRING_AGG(DISTINCT CASE WHEN NOT av THEN 'unavailable' WHEN ex THEN 'explicit_third_repeat' WHEN inc THEN 'standard' ELSE 'excluded' END, ',' ORDER BY
           CASE WHEN NOT av THEN 'unavailable' WHEN ex THEN 'explicit_third_repeat' WHEN inc THEN 'standard' ELSE 'excluded' END) AS basis
       FROM (SELECT *, av AND (o_orderpriority = '5-LOW' OR ex) AS inc FROM (SELECT 'P' || o_orderpriority AS system, o_orderpriority, o_orderstatus <> 'P' AS av,
         o_custkey % 100 = 7 AS ex FROM orders)) GROUP BY ALL""",
)
def a32_repeat_counts(t: Tables) -> DataFrame:
    """Planned, available and included repeats, and the labels of the inclusion rules."""
    o = t.orders.selectExpr(
        "concat('P', o_orderpriority) AS system", "o_orderstatus <> 'P' AS available", "o_custkey % 100 = 7 AS explicit", "o_orderpriority = '5-LOW' AS standard"
    ).withColumn("included", F.expr("available AND (standard OR explicit)"))
    o = o.withColumn("basis", S.inclusion_basis("available", "explicit", "included"))
    # Few labels exist, so the set of labels stays small whatever the number of rows.
    return o.groupBy("system").agg(
        F.count("*").alias("planned"), F.count_if("available").alias("available"), F.count_if("included").alias("included"), F.array_join(F.array_sort(F.collect_set("basis")), ",").alias("basis")
    )


@query(
    "p15_expected_partners",
    "c_custkey:i own:f cross_partners:f",
    """SELECT c_custkey, CASE WHEN n > 0 THEN COALESCE(p, 0) * (n - 1) + COALESCE(q, 0) * m END AS own, CASE WHEN m = 0 THEN 0.0 ELSE q * m END AS cross_partners FROM (
         SELECT c_custkey, COUNT(o_orderkey) FILTER (o_orderstatus = 'F') AS n, COUNT(o_orderkey) FILTER (o_orderstatus = 'O') AS m,
           AVG(o_totalprice / 1000000) FILTER (o_orderstatus = 'F') AS p, AVG(o_totalprice / 1000000) FILTER (o_orderstatus = 'O') AS q
         FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY ALL)""",
)
def p15_expected_partners(t: Tables) -> DataFrame:
    """Derived columns that know the difference between undefined and zero."""
    o = t.orders.withColumn("p", F.col("o_totalprice") / 1000000)
    per = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        *[F.count_if(F.col("o_orderstatus") == s).alias(n) for s, n in (("F", "n"), ("O", "m"))],
        *[F.avg(F.when(F.col("o_orderstatus") == s, F.col("p"))).alias(n) for s, n in (("F", "p"), ("O", "q"))],
    )
    full = t.customer.select("c_custkey").join(per, "c_custkey", "left").fillna({"n": 0, "m": 0})
    return full.select("c_custkey", S.expected_partners("p", "n", "q", "m").alias("own"), S.cross_partners("q", "m").alias("cross_partners"))


@query(
    "p_scalars",
    "l_orderkey:i l_linenumber:i l_partkey:i mic:f image:f wrapped:f base_pair:i cut:i bin:i tenth:i safe:f same:b milli:f box:f charge:f key:s",
    """SELECT l_orderkey, l_linenumber, l_partkey, x - 20.0 * ROUND_EVEN(CAST(x / 20.0 AS DOUBLE), 0) AS mic,
         3.0 + (x - 3.0) - 20.0 * FLOOR((x - 3.0) / CAST(20.0 AS DOUBLE) + 0.5) AS image, x - 20.0 * FLOOR(x / CAST(20.0 AS DOUBLE)) AS wrapped,
         LEAST(r, 79 - r) AS base_pair, (r >= 20)::INT + (r >= 45)::INT + (r >= 70)::INT AS cut, CASE WHEN l_quantity >= 40 THEN 161 ELSE FLOOR(l_quantity / 0.25) + 1 END AS bin,
         r // 10 AS tenth, CASE WHEN l_tax <> 0 THEN l_discount / l_tax END AS safe, ABS(l_discount - 0.05) <= 1e-8 + 1e-5 * 0.05 AS same,
         l_quantity / CAST(6.02214076e23 AS DOUBLE) / (POWER(20, 3) * CAST(1e-24 AS DOUBLE)) * 1e3 AS milli, 75 * CBRT(l_quantity * 1000 / 36000) AS box,
         CASE l_returnflag WHEN 'A' THEN 1.0 WHEN 'R' THEN -1.0 ELSE 0.0 END AS charge, l_returnflag || '__' || l_linestatus AS key
       FROM (SELECT *, l_extendedprice * CAST(0.0137 AS DOUBLE) - 300.0 AS x, l_orderkey % 80 AS r FROM lineitem)""",
)
def p_scalars(t: Tables) -> DataFrame:
    """P3-P9, P11, P14, P16, P20, P22 and V17's box rule as column expressions."""
    li = t.lineitem.selectExpr("*", "l_extendedprice * 0.0137D - 300D AS x", "l_orderkey % 80 AS r", "20D AS box_nm", "CASE l_returnflag WHEN 'A' THEN 'ARG' WHEN 'R' THEN 'ASP' ELSE 'GLY' END AS residue")
    return li.select(
        "l_orderkey", "l_linenumber", "l_partkey",
        S.minimum_image("x", 20.0).alias("mic"), S.nearest_image("x", F.lit(3.0), 20.0).alias("image"), S.wrap("x", 20.0).alias("wrapped"),
        S.base_pair_index("r", 80).alias("base_pair"), S.cut_index("r", [20, 45, 70]).alias("cut"), S.radial_bin("l_quantity", 40.0, 160).alias("bin"),
        S.int_div("r", 10).alias("tenth"), S.ratio("l_discount", "l_tax").alias("safe"), S.close("l_discount", 0.05).alias("same"),
        S.millimolar("l_quantity", "box_nm").alias("milli"), S.fixed_box_nm(F.col("l_quantity") * 1000).alias("box"),
        S.residue_charge("residue").alias("charge"), S.task_key("l_returnflag", "l_linestatus").alias("key"),
    )


@query(
    "p21_reverse_complement",
    "item_id:i rc:s tagged:b",
    "SELECT item_id, REVERSE(TRANSLATE(text, 'ATCG', 'TAGC')) AS rc, list_contains(string_split(text, ','), ' the') AS tagged FROM benchmark",
)
def p21_reverse_complement(t: Tables) -> DataFrame:
    """Base complement of whole texts, and membership in a comma list."""
    return t.benchmark.select("item_id", S.reverse_complement("text").alias("rc"), S.has_tag("text", " the").alias("tagged"))


@query(
    "s8_fixed_width_records",
    "doc_id:i records:i first_name:s n_numbers:i",
    """SELECT doc_id, COUNT(*) AS records, ARG_MIN(name, k) AS first_name, COUNT(*) FILTER (regexp_full_match(seq, '[+-]?[0-9]+')) AS n_numbers FROM (
         SELECT doc_id, k, TRIM(SUBSTRING(line, 13, 4)) AS name, TRIM(SUBSTRING(line, 23, 4)) AS seq FROM (
           SELECT doc_id, UNNEST(string_split(text, chr(10))) AS line, UNNEST(RANGE(LEN(string_split(text, chr(10))))) AS k FROM documents)) GROUP BY ALL""",
)
def s8_fixed_width_records(t: Tables) -> DataFrame:
    """Fixed-width fields of every line of whole texts; the first value per key in line order."""
    lines = t.documents.selectExpr("doc_id", "posexplode(split(text, '\\n', -1)) AS (k, value)")
    rec = tables.fixed_width_fields(lines, ["doc_id", "k"])
    return rec.groupBy("doc_id").agg(F.count("*").alias("records"), F.min_by(F.coalesce("name", F.lit("")), "k").alias("first_name"), F.count("res_seq").alias("n_numbers"))


@query("s12_content_digests", "page_id:i sha256:s bytes:i", "SELECT page_id, sha256(html) AS sha256, strlen(html) AS bytes FROM pages")
def s12_content_digests(t: Tables) -> DataFrame:
    """Digest and size of whole contents."""
    return tables.content_digests(t.pages, ["page_id"], "html")


@query(
    "a36_group_charge",
    "o_orderkey:i charge:f mismatched:i",
    """SELECT l_orderkey AS o_orderkey, SUM(CASE l_returnflag WHEN 'A' THEN 1.0 WHEN 'R' THEN -1.0 ELSE 0.0 END) AS charge,
         COUNT(*) FILTER ((CASE l_returnflag WHEN 'A' THEN 1.0 WHEN 'R' THEN -1.0 ELSE 0.0 END) <> (CASE o_orderstatus WHEN 'F' THEN 1.0 WHEN 'O' THEN -1.0 ELSE 0.0 END)) AS mismatched
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL""",
)
def a36_group_charge(t: Tables) -> DataFrame:
    """Net charge per group and the number of particles that differ from the reference array."""
    code = "CASE {} WHEN '{}' THEN 'ARG' WHEN '{}' THEN 'ASP' ELSE 'GLY' END"
    beads = t.lineitem.selectExpr("l_orderkey AS o_orderkey", f"{code.format('l_returnflag', 'A', 'R')} AS a").join(
        t.orders.selectExpr("o_orderkey", f"{code.format('o_orderstatus', 'F', 'O')} AS b"), "o_orderkey"
    )
    q = beads.select("o_orderkey", S.residue_charge("a").alias("qa"), S.residue_charge("b").alias("qb"))
    return q.groupBy("o_orderkey").agg(F.sum("qa").alias("charge"), F.count_if(F.col("qa") != F.col("qb")).alias("mismatched"))


@query(
    "a34_residue_centres",
    "p_brand:s p_size:i x:f n_atoms:i first_serial:i",
    "SELECT p_brand, p_size, AVG(p_retailprice) AS x, COUNT(*) AS n_atoms, MIN(p_partkey) AS first_serial FROM part GROUP BY ALL",
)
def a34_residue_centres(t: Tables) -> DataFrame:
    """One bead per residue at the mean of its atoms."""
    from lattica.operators.topology import residue_centres

    atoms = t.part.selectExpr("p_brand", "p_size", "p_retailprice AS x", "0D AS y", "0D AS z", "p_name AS res_name", "p_partkey AS serial")
    return residue_centres(atoms, ["p_brand", "p_size"])


@query(
    "u2_union_of_controls",
    "system:s replicate:s level:f",
    """SELECT system, replicate, AVG(v) AS level FROM (SELECT event_type AS system, 'R' || CAST(user_id % 3 AS VARCHAR) AS replicate, value AS v FROM events WHERE value IS NOT NULL
         UNION ALL SELECT 'control', 'R' || CAST(o_orderkey % 3 AS VARCHAR), o_totalprice / 1000 FROM orders) GROUP BY ALL""",
)
def u2_union_of_controls(t: Tables) -> DataFrame:
    """Control and treated tables aligned by name and united."""
    a = t.events.where("value IS NOT NULL").selectExpr("event_type AS system", "concat('R', CAST(user_id % 3 AS STRING)) AS replicate", "value AS v")
    b = t.orders.selectExpr("o_totalprice / 1000 AS v", "concat('R', CAST(o_orderkey % 3 AS STRING)) AS replicate", "'control' AS system")
    return statistics.trajectory_means(a.unionByName(b).withColumnRenamed("v", "level"), TRAJ, ["level"])


@query(
    "j11_membership_filter",
    "l_returnflag:s lines:i",
    "SELECT l_returnflag, COUNT(*) AS lines FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT') GROUP BY ALL",
)
def j11_membership_filter(t: Tables) -> DataFrame:
    """Rows whose node is in a list, as a semi-join."""
    listed = t.orders.where("o_orderpriority = '1-URGENT'").selectExpr("o_orderkey AS l_orderkey")
    return t.lineitem.join(listed, "l_orderkey", "left_semi").groupBy("l_returnflag").agg(F.count("*").alias("lines"))
