"""Queries of the statistics layer: two-level means, contrasts, selections and data-quality ledgers.

Events are a table of frame metrics: the event type is the system, ``user_id % 3`` the replicate, the hour the frame.
Line items give the arms of matched contrasts: return flag is the condition, line status and supplier the arm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions import scalars as S
from lattica.operators import contrasts, digests, quality, quantiles, selection, statistics
from lattica.plans.registry import Tables, query

HOUR = "CAST(floor((unix_timestamp(ts) - 1704067200) / 3600) AS BIGINT)"


def frames(t: Tables) -> DataFrame:
    """Frame metrics: one row per (system, replicate, hour)."""
    return (
        t.events.selectExpr("event_type AS system", "concat('R', CAST(user_id % 3 AS STRING)) AS replicate", f"{HOUR} + 1 AS frame", "value")
        .groupBy("system", "replicate", "frame")
        .agg(F.sum("value").alias("total"), F.avg("value").alias("level"), F.count("*").alias("n"))
        .withColumn("time_us", S.time_us("frame"))
    )


FRAMES_SQL = """
frames AS MATERIALIZED (SELECT event_type AS system, 'R' || CAST(user_id % 3 AS VARCHAR) AS replicate,
   CAST(FLOOR((epoch(ts) - 1704067200) / 3600) AS BIGINT) + 1 AS frame,
   SUM(value) AS total, AVG(value) AS level, COUNT(*) AS n, (CAST(FLOOR((epoch(ts) - 1704067200) / 3600) AS BIGINT) + 1) * CAST(0.001 AS DOUBLE) AS time_us
  FROM events GROUP BY ALL),
frames_repeat AS (SELECT system, replicate, AVG(total) AS total, AVG(level) AS level FROM frames GROUP BY ALL),
"""


@query("a1_trajectory_means", "system:s replicate:s total:f level:f", "SELECT * FROM frames_repeat", FRAMES_SQL)
def a1_trajectory_means(t: Tables) -> DataFrame:
    """A1: mean of every metric over the frames of a trajectory; the metric list comes from the columns."""
    f = frames(t)
    metrics = [m for m in statistics.metric_columns(f, ["system", "replicate", "frame", "time_us"]) if m != "n"]
    return statistics.trajectory_means(f, ["system", "replicate"], metrics)


@query(
    "a2_two_level_stats",
    "system:s total_mean:f total_sd:f total_n:i level_mean:f level_sd:f level_n:i",
    """SELECT system, AVG(total) AS total_mean, STDDEV_SAMP(total) AS total_sd, COUNT(total) AS total_n, AVG(level) AS level_mean,
         STDDEV_SAMP(level) AS level_sd, COUNT(level) AS level_n FROM frames_repeat GROUP BY ALL""",
    FRAMES_SQL,
)
def a2_two_level_stats(t: Tables) -> DataFrame:
    """A2: mean, sample SD and count over trajectory means."""
    return statistics.frames_to_groups(frames(t), ["total", "level"])


@query(
    "a4_block_means",
    "system:s production_block:i total_mean:f total_sd:f total_n:i",
    """SELECT system, production_block, AVG(v) AS total_mean, STDDEV_SAMP(v) AS total_sd, COUNT(v) AS total_n FROM (
         SELECT system, replicate, (frame - 1) // 1000 AS production_block, AVG(total) AS v FROM frames GROUP BY ALL) GROUP BY ALL""",
    FRAMES_SQL,
)
def a4_block_means(t: Tables) -> DataFrame:
    """Means per production block, then over trajectories."""
    return statistics.two_level_stats(statistics.block_means(frames(t), ["total"]), ["system", "production_block"], ["total"])


@query(
    "a37_numerical_summary",
    "source:s system:s metric:s mean:f sd:f n_trajectories:i n_frames:i",
    """SELECT source, system, metric, AVG(v) AS mean, STDDEV_SAMP(v) AS sd, COUNT(v) AS n_trajectories, SUM(k) AS n_frames FROM (
         SELECT 'events' AS source, system, replicate, metric, AVG(value) AS v, COUNT(value) AS k FROM (
           SELECT system, replicate, frame, UNNEST(['total', 'level']) AS metric, UNNEST([total, level]) AS value FROM frames) GROUP BY ALL
         UNION ALL SELECT 'rates' AS source, system, replicate, 'n' AS metric, AVG(n) AS v, COUNT(n) AS k FROM frames GROUP BY ALL) GROUP BY ALL""",
    FRAMES_SQL,
)
def a37_numerical_summary(t: Tables) -> DataFrame:
    """Several metric tables unpivoted into one long summary."""
    f = frames(t)
    return statistics.numerical_summary({"events": f, "rates": f}, {"events": ["total", "level"], "rates": ["n"]})


@query(
    "a33_medians", "system:s median_total:f", "SELECT system, MEDIAN(total) AS median_total FROM frames GROUP BY ALL", FRAMES_SQL
)
def a33_medians(t: Tables) -> DataFrame:
    """Median per group without keeping a group in one task."""
    return quantiles.linear_quantile(frames(t), ["system"], "total", 0.5, out="median_total")


# ----------------------------------------------------------------------------------------------------- quantiles

WQ_SQL = """
samples AS (SELECT l_returnflag, l_linestatus, l_extendedprice AS v, SUM(l_quantity) AS w FROM lineitem GROUP BY ALL),
cum AS (SELECT *, SUM(w) OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY v) AS c, SUM(w) OVER (PARTITION BY l_returnflag, l_linestatus) AS tot FROM samples),
"""


@query(
    "a14_weighted_step_quantile",
    "l_returnflag:s l_linestatus:s q90:f",
    "SELECT l_returnflag, l_linestatus, MIN(v) AS q90 FROM cum WHERE c >= CAST(0.9 AS DOUBLE) * tot GROUP BY ALL",
    WQ_SQL,
)
def a14_weighted_step_quantile(t: Tables) -> DataFrame:
    """Smallest value whose cumulative weight reaches q, by bucket refinement."""
    return quantiles.weighted_step_quantile(t.lineitem, ["l_returnflag", "l_linestatus"], "l_extendedprice", "l_quantity", 0.9, out="q90", rounds=2)


@query(
    "a13_linear_quantile",
    "l_returnflag:s l_linestatus:s q90:f",
    "SELECT l_returnflag, l_linestatus, QUANTILE_CONT(l_extendedprice, 0.9) AS q90 FROM lineitem GROUP BY ALL",
)
def a13_linear_quantile(t: Tables) -> DataFrame:
    """Interpolated quantile of groups of any size."""
    return quantiles.linear_quantile(t.lineitem, ["l_returnflag", "l_linestatus"], "l_extendedprice", 0.9, out="q90", rounds=2)


@query(
    "a15_weighted_mean",
    "l_returnflag:s count:i total_weight:f2 mean_nm:f q90_nm:f within:f",
    """SELECT a.l_returnflag, a.count, a.total_weight, a.mean_nm, b.q90_nm, a.within FROM
         (SELECT l_returnflag, COUNT(*) AS count, SUM(l_quantity) AS total_weight, SUM(l_extendedprice * l_quantity) / SUM(l_quantity) AS mean_nm,
            AVG(CASE WHEN l_extendedprice <= 50000 THEN 1.0 ELSE 0.0 END) AS within FROM lineitem GROUP BY ALL) a
       JOIN (SELECT l_returnflag, MIN(v) AS q90_nm FROM (SELECT *, SUM(w) OVER (PARTITION BY l_returnflag ORDER BY v) AS c, SUM(w) OVER (PARTITION BY l_returnflag) AS tot
          FROM (SELECT l_returnflag, l_extendedprice AS v, SUM(l_quantity) AS w FROM lineitem GROUP BY ALL)) WHERE c >= CAST(0.9 AS DOUBLE) * tot GROUP BY ALL) b USING (l_returnflag)""",
)
def a15_weighted_mean(t: Tables) -> DataFrame:
    """Count, weighted mean, step quantile and share within a threshold."""
    li = t.lineitem
    near = li.groupBy("l_returnflag").agg(F.avg((F.col("l_extendedprice") <= 50000).cast("double")).alias("within"))
    return quantiles.distance_summary(li, ["l_returnflag"], "l_extendedprice", "l_quantity").join(near, "l_returnflag")


# ----------------------------------------------------------------------------------------------------- contrasts


def arm_long(t: Tables) -> DataFrame:
    """Replicate means in long form: condition (A = without, N = with, R = a third one), arm (by supplier), replicate, metric."""
    li = t.lineitem.selectExpr(
        "l_returnflag AS condition",
        "CASE (l_suppkey div 3) % 3 WHEN 0 THEN 'Full' WHEN 1 THEN 'Split-2' ELSE 'Split-4' END AS arm",
        "concat('R', CAST(l_suppkey % 3 AS STRING)) AS replicate",
        "l_quantity",
        "l_discount",
    )
    rep = statistics.trajectory_means(li, ["condition", "arm", "replicate"], ["l_quantity", "l_discount"])
    return statistics.to_long(rep, ["condition", "arm", "replicate"], ["l_quantity", "l_discount"])


ARMS_SQL = """
arm_wide AS (SELECT l_returnflag AS condition, CASE (l_suppkey // 3) % 3 WHEN 0 THEN 'Full' WHEN 1 THEN 'Split-2' ELSE 'Split-4' END AS arm,
   'R' || CAST(l_suppkey % 3 AS VARCHAR) AS replicate, AVG(l_quantity) AS l_quantity, AVG(l_discount) AS l_discount
   FROM lineitem GROUP BY ALL),
arm_long AS MATERIALIZED (SELECT condition, arm, replicate, UNNEST(['l_quantity', 'l_discount']) AS metric, UNNEST([l_quantity, l_discount]) AS value FROM arm_wide),
eff AS (SELECT condition, replicate, metric, MAX(value) FILTER (arm = 'Full') AS f, MAX(value) FILTER (arm = 'Split-2') AS s2, MAX(value) FILTER (arm = 'Split-4') AS s4
   FROM arm_long GROUP BY ALL),
"""


@query(
    "c1_paired_difference",
    "comparison:s replicate:s metric:s without_DNA:f with_DNA:f delta_with_minus_without:f",
    """SELECT a.arm AS comparison, a.replicate, a.metric, a.value AS without_DNA, b.value AS with_DNA, b.value - a.value AS delta_with_minus_without
       FROM arm_long a JOIN arm_long b USING (arm, replicate, metric) WHERE a.condition = 'A' AND b.condition = 'N'""",
    ARMS_SQL,
)
def c1_paired_difference(t: Tables) -> DataFrame:
    """With minus without, matched on the replicate."""
    long = arm_long(t).withColumn("system", F.concat_ws("-", "arm", "condition"))
    pairs = long.select("arm").distinct().selectExpr("arm AS comparison", "concat(arm, '-A') AS without", "concat(arm, '-N') AS with")
    return contrasts.paired_difference(long.drop("arm", "condition"), pairs, ["replicate", "metric"])


@query(
    "c2_arm_differences",
    "condition:s metric:s Full_minus_Split_2_mean:f Full_minus_Split_2_sd:f Full_minus_Split_2_n:i Full_minus_Split_4_mean:f Full_minus_Split_4_sd:f Full_minus_Split_4_n:i",
    """SELECT condition, metric, AVG(f - s2) AS Full_minus_Split_2_mean, STDDEV_SAMP(f - s2) AS Full_minus_Split_2_sd, COUNT(*) AS Full_minus_Split_2_n,
         AVG(f - s4) AS Full_minus_Split_4_mean, STDDEV_SAMP(f - s4) AS Full_minus_Split_4_sd, COUNT(*) AS Full_minus_Split_4_n FROM eff GROUP BY ALL""",
    ARMS_SQL,
)
def c2_arm_differences(t: Tables) -> DataFrame:
    """Full minus split arms per replicate, then mean and SD."""
    eff = contrasts.arm_differences(arm_long(t), ["condition", "replicate", "metric"], "arm")
    return statistics.two_level_stats(eff, ["condition", "metric"], ["Full_minus_Split_2", "Full_minus_Split_4"])


@query(
    "c3_difference_in_differences",
    "replicate:s metric:s without_DNA:f with_DNA:f difference_in_differences:f",
    """SELECT replicate, metric, MAX(f - s4) FILTER (condition = 'A') AS without_DNA, MAX(f - s4) FILTER (condition = 'N') AS with_DNA,
         MAX(f - s4) FILTER (condition = 'N') - MAX(f - s4) FILTER (condition = 'A') AS difference_in_differences FROM eff GROUP BY ALL""",
    ARMS_SQL,
)
def c3_difference_in_differences(t: Tables) -> DataFrame:
    """Effect of the split with the anchor minus the effect without it."""
    eff = contrasts.arm_differences(arm_long(t), ["condition", "replicate", "metric"], "arm")
    did = contrasts.difference_in_differences(eff, ["replicate", "metric"], "condition", "Full_minus_Split_4", "A", "N")
    return did.withColumnRenamed("Full_minus_Split_4_without_DNA", "without_DNA").withColumnRenamed("Full_minus_Split_4_with_DNA", "with_DNA")


@query(
    "c4_reversed_differences",
    "condition:s replicate:s metric:s Split_2_minus_Full:f Split_4_minus_Full:f range_across_definitions:f",
    """SELECT condition, replicate, metric, s2 - f AS Split_2_minus_Full, s4 - f AS Split_4_minus_Full,
         GREATEST(f, s2, s4) - LEAST(f, s2, s4) AS range_across_definitions FROM eff""",
    ARMS_SQL,
)
def c4_reversed_differences(t: Tables) -> DataFrame:
    """Split minus full, and the range over the arms."""
    keys = ["condition", "replicate", "metric"]
    long = arm_long(t)
    return contrasts.arm_differences(long, keys, "arm", reverse=True).join(contrasts.arm_range(long, keys), keys)


DECOMP_SQL = """
cells AS (SELECT l_returnflag AS condition, 'R' || CAST(l_suppkey % 3 AS VARCHAR) AS replicate,
   CASE (l_suppkey // 3) % 3 WHEN 0 THEN 'Full' WHEN 1 THEN 'Split-2' ELSE 'Split-4' END AS ensemble,
   AVG(l_quantity) AS m_full, AVG(l_quantity * (1 - l_discount)) AS m_2, AVG(l_quantity * (1 - l_tax)) AS m_4 FROM lineitem GROUP BY ALL),
transfer AS (SELECT condition, replicate, ensemble, UNNEST(['Full', 'Split-2', 'Split-4']) AS covalent_mask, UNNEST([m_full, m_2, m_4]) AS residue_LCC_fraction FROM cells),
"""


def transfer(t: Tables) -> DataFrame:
    cells = (
        t.lineitem.selectExpr(
            "l_returnflag AS condition",
            "concat('R', CAST(l_suppkey % 3 AS STRING)) AS replicate",
            "CASE (l_suppkey div 3) % 3 WHEN 0 THEN 'Full' WHEN 1 THEN 'Split-2' ELSE 'Split-4' END AS ensemble",
            "l_quantity",
            "l_quantity * (1 - l_discount) AS q2",
            "l_quantity * (1 - l_tax) AS q4",
        )
        .groupBy("condition", "replicate", "ensemble")
        .agg(F.avg("l_quantity").alias("m_full"), F.avg("q2").alias("m_2"), F.avg("q4").alias("m_4"))
    )
    return contrasts.mask_transfer(cells, ["condition", "replicate", "ensemble"], {"m_full": "Full", "m_2": "Split-2", "m_4": "Split-4"})


@query(
    "c6_mask_transfer",
    "condition:s ensemble:s covalent_mask:s residue_LCC_fraction_mean:f residue_LCC_fraction_sd:f residue_LCC_fraction_n:i",
    """SELECT condition, ensemble, covalent_mask, AVG(residue_LCC_fraction) AS residue_LCC_fraction_mean, STDDEV_SAMP(residue_LCC_fraction) AS residue_LCC_fraction_sd,
         COUNT(*) AS residue_LCC_fraction_n FROM transfer GROUP BY ALL""",
    DECOMP_SQL,
)
def c6_mask_transfer(t: Tables) -> DataFrame:
    """Mask columns unpivoted, then mean and SD."""
    return statistics.two_level_stats(transfer(t), ["condition", "ensemble", "covalent_mask"], ["residue_LCC_fraction"])


@query(
    "c5_mask_decomposition",
    "condition:s replicate:s contrast:s total_diagonal_effect:f direct_mask_effect:f coordinate_ensemble_effect:f additivity_error:f",
    """SELECT condition, replicate, 'Full-' || s AS contrast, ff - ss AS total_diagonal_effect, ff - fs AS direct_mask_effect,
         fs - ss AS coordinate_ensemble_effect, (ff - ss) - (ff - fs) - (fs - ss) AS additivity_error FROM (
         SELECT condition, replicate, s, MAX(residue_LCC_fraction) FILTER (ensemble = 'Full' AND covalent_mask = 'Full') AS ff,
           MAX(residue_LCC_fraction) FILTER (ensemble = 'Full' AND covalent_mask = s) AS fs, MAX(residue_LCC_fraction) FILTER (ensemble = s AND covalent_mask = s) AS ss
         FROM transfer CROSS JOIN (SELECT UNNEST(['Split-2', 'Split-4']) AS s) GROUP BY ALL)""",
    DECOMP_SQL,
)
def c5_mask_decomposition(t: Tables) -> DataFrame:
    """Total effect split into the mask's own effect and the effect of the coordinates."""
    return contrasts.mask_decomposition(transfer(t), ["condition", "replicate"], "ensemble", "covalent_mask", "residue_LCC_fraction")


DESIGN_SQL = """
design AS (SELECT 'N' || CAST(c_nationkey AS VARCHAR) AS system, COUNT(*) AS n_chains FROM customer GROUP BY ALL),
rep AS (SELECT 'N' || CAST(c_nationkey AS VARCHAR) AS system, 'R' || CAST(o_orderkey % 3 AS VARCHAR) AS replicate, COUNT(*) AS n_edges,
   AVG(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) AS fraction FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
"""


@query(
    "c9_c10_counts_and_partners",
    "system:s replicate:s partners_per_chain:f absolute:f ratio_to_design:f",
    """SELECT system, replicate, 2.0 * n_edges / n_chains AS partners_per_chain, fraction * n_chains AS absolute, n_edges / n_chains AS ratio_to_design
       FROM rep JOIN design USING (system)""",
    DESIGN_SQL,
)
def c9_c10_counts_and_partners(t: Tables) -> DataFrame:
    """Partners per chain, fraction to absolute count, ratio to a design constant."""
    c = t.customer.selectExpr("c_custkey", "concat('N', CAST(c_nationkey AS STRING)) AS system")
    design = c.groupBy("system").agg(F.count("*").alias("n_chains"))
    rep = (
        t.orders.selectExpr("o_custkey AS c_custkey", "concat('R', CAST(o_orderkey % 3 AS STRING)) AS replicate", "o_orderstatus")
        .join(c, "c_custkey")
        .groupBy("system", "replicate")
        .agg(F.count("*").alias("n_edges"), F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("fraction"))
    )
    out = contrasts.absolute_count(rep, design, "fraction", "n_chains", "absolute").join(design, "system")
    return statistics.ratio_to_design(contrasts.partners_per_chain(out, "n_edges", "n_chains"), design, "n_edges", "n_chains", "ratio_to_design")


@query(
    "j12_replicate_alignment",
    "system:s replicate:s n_orders:i share:f",
    """SELECT system, replicate, n_orders, n_orders / NULLIF(SUM(n_orders) OVER (PARTITION BY system), 0) AS share FROM
         (SELECT DISTINCT c_mktsegment || '-' || CAST(c_custkey % 50 AS VARCHAR) AS system FROM customer)
       CROSS JOIN (SELECT UNNEST(['1-URGENT', '2-HIGH', '3-MEDIUM', '6-NONE']) AS replicate)
       LEFT JOIN (SELECT c_mktsegment || '-' || CAST(c_custkey % 50 AS VARCHAR) AS system, o_orderpriority AS replicate, COUNT(*) AS n_orders
          FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL) USING (system, replicate)""",
)
def j12_replicate_alignment(t: Tables) -> DataFrame:
    """Every system with all expected replicates; missing ones stay missing."""
    systems = t.customer.selectExpr("c_custkey", "concat(c_mktsegment, '-', CAST(c_custkey % 50 AS STRING)) AS system")
    counts = (
        t.orders.selectExpr("o_custkey AS c_custkey", "o_orderpriority AS replicate").join(systems, "c_custkey").groupBy("system", "replicate").agg(F.count("*").alias("n_orders"))
    )
    full = statistics.align_replicates(counts, systems, ["1-URGENT", "2-HIGH", "3-MEDIUM", "6-NONE"])
    totals = full.groupBy("system").agg(F.sum("n_orders").alias("_t"))
    return full.join(totals, "system").withColumn("share", S.ratio("n_orders", "_t"))


# ----------------------------------------------------------------------------------------------------- selection


@query(
    "k3_top_ten",
    "l_returnflag:s l_linestatus:s rank:i l_orderkey:i l_linenumber:i l_partkey:i l_extendedprice:f",
    """SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS rank
       FROM lineitem) WHERE rank <= 10""",
)
def k3_top_ten(t: Tables) -> DataFrame:
    """Top ten per group with rank."""
    return selection.top_k(t.lineitem, ["l_returnflag", "l_linestatus"], "l_extendedprice", ["l_orderkey", "l_linenumber", "l_partkey"])


@query(
    "k4_first_per_key",
    "o_custkey:i o_orderkey:i o_totalprice:f",
    "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rk FROM orders) WHERE rk = 1",
)
def k4_first_per_key(t: Tables) -> DataFrame:
    """K4: first row of every key, by an aggregate instead of a window."""
    return selection.first_per_key(t.orders, ["o_custkey"], ["o_orderdate", "o_orderkey"])


@query(
    "k1_configured_order",
    "system:s replicate:s total:f",
    """SELECT * FROM (SELECT system, replicate, AVG(total) AS total FROM frames GROUP BY ALL)
       ORDER BY list_position(['purchase', 'view', 'click'], system) NULLS LAST, replicate LIMIT 7""",
    FRAMES_SQL,
)
def k1_configured_order(t: Tables) -> DataFrame:
    """K1, K2: rows in configured order, then the first n of them."""
    rep = statistics.trajectory_means(frames(t), ["system", "replicate"], ["total"])
    return selection.ordered_by(rep, {"system": ["purchase", "view", "click"]}, ["replicate"]).limit(7)


SCORE_SQL = (
    FRAMES_SQL
    + """
centre AS (SELECT system, MEDIAN(total) AS mt, GREATEST(COALESCE(STDDEV_SAMP(total), 0), 1e-8) AS st, MEDIAN(level) AS ml, GREATEST(COALESCE(STDDEV_SAMP(level), 0), 1e-8) AS sl
  FROM frames GROUP BY ALL),
scored AS (SELECT f.*, ABS(total - mt) / st + ABS(level - ml) / sl AS dev, 0.05 * ABS(time_us - 3.0) AS tie FROM frames f JOIN centre USING (system)),
"""
)


@query(
    "k5_representative_frame",
    "system:s replicate:s frame:i selection_score:f",
    """SELECT system, replicate, frame, dev + tie AS selection_score FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY system ORDER BY dev + tie, replicate, frame) AS rk FROM scored) WHERE rk = 1""",
    SCORE_SQL,
)
def k5_representative_frame(t: Tables) -> DataFrame:
    """K5: the frame nearest the pooled medians in units of SD."""
    return selection.representative(frames(t), ["system"], ["total", "level"])


@query(
    "k6_matched_representative",
    "system:s replicate:s frame:i total:f selection_score:f",
    """SELECT f.system, f.replicate, f.frame, f.total, b.score AS selection_score FROM frames f JOIN (
         SELECT replicate, frame, SUM(dev) + MIN(tie) AS score FROM scored WHERE system IN ('click', 'view') GROUP BY ALL HAVING COUNT(DISTINCT system) = 2
         ORDER BY score, replicate, frame LIMIT 1) b USING (replicate, frame) WHERE f.system IN ('click', 'view')""",
    SCORE_SQL,
)
def k6_matched_representative(t: Tables) -> DataFrame:
    """K6: one frame present in both arms with the least summed deviation."""
    return selection.matched_representative(frames(t), "system", ["click", "view"], ["total", "level"])


@query(
    "k7_nearest_to_median",
    "system:s replicate:s frame:i selection_score:f",
    """SELECT system, replicate, frame, score AS selection_score FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY system ORDER BY score, replicate, frame) AS rk FROM
         (SELECT f.*, ABS(total - mt) + 0.01 * ABS(time_us - 3.0) AS score FROM frames f JOIN centre USING (system))) WHERE rk = 1""",
    SCORE_SQL,
)
def k7_nearest_to_median(t: Tables) -> DataFrame:
    """K7: the frame nearest the median of one metric."""
    return selection.nearest_to_median(frames(t), ["system"], "total")


# ------------------------------------------------------------------------------------------------------- quality


@query(
    "v1_sampling_report",
    "system:s replicate:s n_rows:i n_frames:i off_grid:i passed:b",
    """SELECT system, replicate, COUNT(*) AS n_rows, COUNT(DISTINCT frame) AS n_frames, COUNT(*) FILTER (NOT (frame >= 1 AND frame <= 720)) AS off_grid,
         COUNT(*) = 720 AND COUNT(DISTINCT frame) = 720 AND COUNT(*) FILTER (NOT (frame >= 1 AND frame <= 720)) = 0 AS passed FROM frames GROUP BY ALL""",
    FRAMES_SQL,
)
def v1_sampling_report(t: Tables) -> DataFrame:
    """V1: is every group sampled on exactly the expected grid?"""
    return quality.sampling_report(frames(t), ["system", "replicate"], first=1, last=720, step=1)


@query(
    "v1_missing_frames",
    "system:s replicate:s frame:i",
    """SELECT system, replicate, g.frame FROM (SELECT DISTINCT system, replicate FROM frames) CROSS JOIN (SELECT UNNEST(RANGE(1, 721)) AS frame) g
       WHERE NOT EXISTS (SELECT 1 FROM frames f WHERE f.system = system AND f.replicate = replicate AND f.frame = g.frame)""".replace(
        "f.system = system AND f.replicate = replicate", "f.system = d.system AND f.replicate = d.replicate"
    ).replace("FROM (SELECT DISTINCT system, replicate FROM frames) CROSS", "FROM (SELECT DISTINCT system, replicate FROM frames) d CROSS"),
    FRAMES_SQL,
)
def v1_missing_frames(t: Tables) -> DataFrame:
    """Frames of the grid that a group lacks."""
    return quality.missing_frames(frames(t), ["system", "replicate"], 1, 720, 1)


@query(
    "v2_ledger",
    "check:s value:s required:s passed:b",
    """SELECT 'discount range' AS "check", CAST(MIN(l_discount) + 0.0 AS VARCHAR) || '..' || CAST(MAX(l_discount) AS VARCHAR) AS value, '0.0..0.1' AS required,
         MIN(l_discount) >= 0 AND MAX(l_discount) <= CAST(0.1 AS DOUBLE) AS passed FROM lineitem
       UNION ALL SELECT 'whole quantities', CAST(COUNT(*) FILTER (l_quantity <> FLOOR(l_quantity)) AS VARCHAR), '0 fractional values', COUNT(*) FILTER (l_quantity <> FLOOR(l_quantity)) = 0 FROM lineitem
       UNION ALL SELECT 'unique orders', CAST(COUNT(*) - COUNT(DISTINCT o_orderkey) AS VARCHAR), '0 duplicate keys', COUNT(*) = COUNT(DISTINCT o_orderkey) FROM orders
       UNION ALL SELECT 'orders have customers', CAST(COUNT(*) AS VARCHAR), '0 orphans', COUNT(*) = 0 FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
       UNION ALL SELECT 'ordered keys', CAST(COUNT(*) AS VARCHAR), '0 keys on one side', COUNT(*) = 0 FROM (
          SELECT o_orderkey, MIN(s) AS a, MAX(s) AS b FROM (SELECT o_orderkey, 1 AS s FROM orders UNION ALL SELECT l_orderkey, 2 FROM lineitem) GROUP BY ALL) WHERE a = b
       UNION ALL SELECT 'region of nation', '5', '= 5', MIN(n) = 5 AND MAX(n) = 5 FROM (SELECT n_regionkey, COUNT(*) AS n FROM nation GROUP BY ALL)
       UNION ALL SELECT 'customers complete', CAST(COUNT(*) - COUNT(c_acctbal) AS VARCHAR), '0 missing values', COUNT(*) = COUNT(c_acctbal) FROM customer
       UNION ALL SELECT 'exact sampling grid', CAST(COUNT(*) FILTER (n <> 720) AS VARCHAR), '0 groups off the grid', COUNT(*) FILTER (n <> 720) = 0 FROM (
          SELECT event_type, user_id % 3 AS r, COUNT(DISTINCT date_trunc('hour', ts)) AS n FROM events GROUP BY ALL)""",
)
def v2_ledger(t: Tables) -> DataFrame:
    """Checks of several kinds in one ledger."""
    li, o = t.lineitem, t.orders
    per_region = t.nation.groupBy("n_regionkey").agg(F.count("*").alias("n"))
    return quality.ledger(
        quality.within(li, "discount range", "l_discount", 0.0, 0.1),
        quality.integral(li, "whole quantities", "l_quantity"),
        quality.unique_key(o, "unique orders", ["o_orderkey"]),
        quality.no_orphans(o.selectExpr("o_custkey AS c_custkey"), t.customer, ["c_custkey"], "orders have customers"),
        quality.same_keys(o.select("o_orderkey"), li.selectExpr("l_orderkey AS o_orderkey"), ["o_orderkey"], "ordered keys"),
        quality.constant_value(per_region, "region of nation", "n", 5),
        quality.complete_arms(t.customer, "c_acctbal", "customers complete"),
        quality.exact_sampling(frames(t), ["system", "replicate"], first=1, last=720, step=1),
    )


@query(
    "v8_one_to_one_agreement",
    "o_orderkey:i d:f",
    """SELECT o_orderkey, ABS(o_totalprice - s) AS d FROM orders JOIN (SELECT l_orderkey, SUM(l_extendedprice) AS s FROM lineitem GROUP BY ALL) ON o_orderkey = l_orderkey""",
)
def v8_one_to_one_agreement(t: Tables) -> DataFrame:
    """Validated one-to-one join of two analyses and the gap between them."""
    s = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_extendedprice").alias("s"))
    return quality.one_to_one(t.orders.select("o_orderkey", "o_totalprice"), s, ["o_orderkey"]).withColumn("d", F.abs(F.col("o_totalprice") - F.col("s")))


@query(
    "v8_agreement",
    "status:s n_both:i one_sided:i passed:b",
    """SELECT status, COUNT(a IS NOT NULL AND b IS NOT NULL OR NULL) AS n_both, COUNT((a IS NULL) <> (b IS NULL) OR NULL) AS one_sided,
         COUNT((a IS NULL) <> (b IS NULL) OR NULL) = 0 AND COALESCE(MAX(ABS(a - b)), 0) <= 0.01 AS passed FROM (
         SELECT l_linestatus AS status, l_orderkey, SUM(l_extendedprice * (1 - l_discount)) AS a FROM lineitem GROUP BY ALL) FULL JOIN (
         SELECT l_linestatus AS status, l_orderkey, SUM(l_extendedprice) - SUM(l_extendedprice * l_discount) AS b FROM lineitem
         WHERE l_linestatus = 'F' OR l_quantity > 1 GROUP BY ALL) USING (status, l_orderkey) GROUP BY status""",
)
def v8_agreement(t: Tables) -> DataFrame:
    """V8: one quantity from two analyses, within a tolerance and with none missing; the second one here lacks some rows."""
    keys = [F.col("l_linestatus").alias("status"), "l_orderkey"]
    first = t.lineitem.groupBy(*keys).agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"))
    some = t.lineitem.where("l_linestatus = 'F' OR l_quantity > 1")
    second = some.groupBy(*keys).agg((F.sum("l_extendedprice") - F.sum(F.col("l_extendedprice") * F.col("l_discount"))).alias("net"))
    return quality.agreement(first, second, ["l_orderkey"], "net", ["status"], 0.01)


@query(
    "v9_block_counts",
    "system:s n_replicates:i fewest:i most:i passed:b",
    """SELECT system, COUNT(*) AS n_replicates, MIN(n) AS fewest, MAX(n) AS most, COUNT(*) = 3 AND MIN(n) = 25 AND MAX(n) = 25 AS passed FROM (
         SELECT o_orderpriority AS system, o_orderstatus, COUNT(DISTINCT o_orderkey % 25) AS n FROM orders GROUP BY ALL) GROUP BY system""",
)
def v9_block_counts(t: Tables) -> DataFrame:
    """V9: replicates of each system and frames of each replicate against required numbers."""
    frames = t.orders.select(F.col("o_orderpriority").alias("system"), "o_orderstatus", (F.col("o_orderkey") % 25).alias("frame"))
    return quality.block_counts(frames, ["system"], "o_orderstatus", "frame", 3, 25)


@query(
    "v10_root_digests",
    "supplier:i n_rows:i root:s",
    """SELECT supplier, SUM(n)::BIGINT AS n_rows, sha256(string_agg(chunk || ':' || d, '|' ORDER BY chunk)) AS root FROM (
         SELECT l_suppkey AS supplier, (l_orderkey * 8 + l_linenumber) // 4096 AS chunk, COUNT(*) AS n,
           sha256(string_agg((l_orderkey * 8 + l_linenumber) || ',=' || l_partkey || ',=' || l_linestatus, '|' ORDER BY l_orderkey * 8 + l_linenumber,
             (l_orderkey * 8 + l_linenumber) || ',=' || l_partkey || ',=' || l_linestatus)) AS d FROM lineitem GROUP BY ALL) GROUP BY supplier""",
)
def v10_root_digests(t: Tables) -> DataFrame:
    """A digest of each supplier's rows in order, from digests of chunks."""
    rows = t.lineitem.select(F.col("l_suppkey").alias("supplier"), F.expr("l_orderkey * 8 + l_linenumber").cast("long").alias("pos"), F.col("l_partkey").cast("long").alias("part"), "l_linestatus")
    return digests.root_digests(digests.chunk_digests(rows, ["supplier"], "pos", ["part", "l_linestatus"], 4096), ["supplier"])


@query(
    "v16_prefix_identity",
    "task:i kept:i added:i broken:i first_broken:i passed:b",
    """SELECT l_orderkey AS task, COUNT(*) FILTER (l_linenumber <= 4) AS kept, COUNT(*) FILTER (l_linenumber > last) AS added,
         COUNT(DISTINCT l_linenumber) FILTER (l_linenumber <= 4 AND l_returnflag = 'R') AS broken, MIN(l_linenumber) FILTER (l_linenumber <= 4 AND l_returnflag = 'R') AS first_broken,
         COUNT(*) FILTER (l_linenumber <= 4 AND l_returnflag = 'R') = 0 AS passed
       FROM (SELECT *, MAX(CASE WHEN l_linenumber <= 4 THEN l_linenumber END) OVER (PARTITION BY l_orderkey) AS last FROM lineitem)
       WHERE last IS NOT NULL GROUP BY l_orderkey""",
)
def v16_prefix_identity(t: Tables) -> DataFrame:
    """A child repeats its parent's rows and adds others; here returned rows have changed and must be found."""
    rows = t.lineitem.select(F.col("l_orderkey").alias("task"), F.col("l_linenumber").cast("long").alias("bead"), F.col("l_partkey").cast("long").alias("x"), "l_returnflag")
    child = rows.withColumn("x", F.when(F.col("l_returnflag") == "R", F.col("x") + 1).otherwise(F.col("x")))
    return digests.prefix_identity(rows.where("bead <= 4").drop("l_returnflag"), child.drop("l_returnflag"), ["task"], "bead", ["x"])


@query(
    "j15_matched_fields",
    "task:i parent:i changed:s",
    """SELECT * FROM (SELECT c.o_orderkey AS task, c.parent, CONCAT_WS(',', CASE WHEN c.o_orderstatus IS DISTINCT FROM p.o_orderstatus THEN 'o_orderstatus' END,
          CASE WHEN c.o_orderpriority IS DISTINCT FROM p.o_orderpriority THEN 'o_orderpriority' END) AS changed
        FROM (SELECT *, CASE WHEN o_orderkey % 2 = 1 THEN o_orderkey - 1 END AS parent FROM orders) c JOIN orders p ON c.parent = p.o_orderkey) WHERE changed <> ''""",
)
def j15_matched_fields(t: Tables) -> DataFrame:
    """Fields of a child row that must equal those of its parent."""
    o = t.orders.selectExpr("*", "if(o_orderkey % 2 = 1, o_orderkey - 1, NULL) AS parent")
    return quality.matched_fields(o, "o_orderkey", "parent", ["o_orderstatus", "o_orderpriority"]).select(
        F.col("o_orderkey").alias("task"), "parent", F.array_join("changed", ",").alias("changed")
    )


@query(
    "v11_nested_metadata",
    "system:s rows:i mean_k:f above:i default_used:i",
    """SELECT event_type AS system, COUNT(*) AS rows, AVG(k) AS mean_k, COUNT(*) FILTER (k > 50) AS above, COUNT(*) FILTER (ts_fs = 10.0) AS default_used FROM (
         SELECT event_type, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, COALESCE(CAST(json_extract_string(props, '$.timestep_fs') AS DOUBLE), 10.0) AS ts_fs FROM events) GROUP BY ALL""",
)
def v11_nested_metadata(t: Tables) -> DataFrame:
    """Nested run metadata with defaults for absent fields."""
    parsed = t.events.select(F.col("event_type").alias("system"), F.from_json("props", "k DOUBLE, timestep_fs DOUBLE").alias("m"))
    with_default = parsed.select("system", F.col("m.k").alias("k"), F.coalesce("m.timestep_fs", F.lit(10.0)).alias("ts_fs"))
    return with_default.groupBy("system").agg(
        F.count("*").alias("rows"), F.avg("k").alias("mean_k"), F.count_if(F.col("k") > 50).alias("above"), F.count_if(F.col("ts_fs") == 10.0).alias("default_used")
    )
