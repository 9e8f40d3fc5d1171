"""Registered queries against their SQL, and the composed analyses, on the smallest given tables.

``check.py`` compares every registered query; here a selection of each kind keeps the suite short.
"""

import os
import subprocess
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from check import TABLES, rows
from lattica.operators import frames
from lattica.plans import analyses, roles
from lattica.plans.registry import Tables

FOLDER = "/root/testdata/sf0.001"
SELECTED = [
    "j1_periodic_pairs", "j3_open_pairs", "j4_nearest_anchor", "j17_shadow_contacts", "g3_cluster_metrics", "g5_hop_fractions", "g11_mask_lcc",
    "a6_pair_kinds", "a10_contact_map_od", "a12_frame_normalised_histogram", "a13_linear_quantile", "a14_weighted_step_quantile", "a20_binding_categories",
    "a9_residue_profile", "a10_contact_map_md", "a28_arm_pivot", "a29_rebinned_profile", "a31_contact_matrix", "p23_unfragmented_profile", "s8_fixed_width_records", "s12_content_digests",
    "c2_arm_differences", "k8_largest_component_nodes", "a37_numerical_summary", "c3_difference_in_differences", "c5_mask_decomposition", "k5_representative_frame", "k6_matched_representative", "v2_ledger",
    "v8_agreement", "v10_root_digests", "v16_prefix_identity", "w2_unwrap_two_strands", "w5_moving_average", "w8_pairs_in_one_run", "t2_opposite_strand_pairs", "i1_changed_signatures", "i2_health_stream",
]


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{FOLDER}/{name}.parquet')")
    return con


@pytest.mark.parametrize("name", SELECTED)
def test_query_matches_sql(spark, db, name):
    df = entry.queries()[name](spark, FOLDER)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = db.execute(entry.oracle_sql()[name])
    assert got == rows([d[0] for d in cur.description], cur.fetchall())


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 100


def test_entry_without_the_pipeline_operators():
    """The other queries are there when the subpackage is not, and any other import error shows."""
    root = os.path.dirname(os.path.abspath(entry.__file__))
    code = "import sys; sys.path.insert(0, {!r}); sys.modules[{!r}] = None; import __spark_entry__ as e; print(sum(k.startswith('op') or k == 'pipeline' for k in e.queries()), len(e.queries()))"
    run = lambda name: subprocess.run([sys.executable, "-c", code.format(root, name)], capture_output=True, text=True)
    own, all_queries = map(int, run("lattica.llm").stdout.split())
    assert own == 0 and all_queries > 100
    assert run("lattica.operators.graph").returncode != 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["system", "cutoff_nm", "largest_cluster_fraction_mean", "largest_cluster_fraction_sd", "largest_cluster_fraction_n"]
    assert df.count() > 0


def test_analyses_agree_and_conserve(spark):
    """The composed analyses share one contact table; their results obey the conservation rules."""
    positions = roles.beads(Tables(spark, FOLDER))
    pairs = analyses.contacts(positions, roles.BOX)
    net = analyses.network(positions, pairs)
    assert net["cluster_group"].where("largest_cluster_fraction_mean > 1 OR largest_cluster_fraction_mean <= 0").count() == 0
    assert net["clusters"].where("largest_cluster_size < second_cluster_size").count() == 0
    far = analyses.reach(positions, pairs, roles.BOX)
    hops = far["hops"].groupBy("frame").agg(
        F.abs(F.sum(F.when(F.col("hop_class") == "linked", -F.col("physical_fraction")).otherwise(F.col("physical_fraction")))).alias("gap")
    )
    assert hops.where("gap > 1e-9").count() == 0
    last = far["radial_histogram"].groupBy("system", "replicate").agg(F.max("cumulative_probability").alias("end"))
    assert last.where("abs(end - 1) > 1e-9").count() == 0
    blocks = analyses.fixed_blocks(positions, pairs)
    masks = blocks["masks"].groupBy("frame").pivot("mask", ["Full", "Split-2", "Split-4"]).max("largest_weight_fraction")
    assert masks.where("`Full` < `Split-2` - 1e-12 OR `Split-2` < `Split-4` - 1e-12").count() == 0
    assert analyses.sampled(positions, 1, 9, 4).where("(frame - 1) % 4 <> 0 OR frame > 9").count() == 0


def test_chains_are_unwrapped_after_one_exchange(spark):
    """No beads are joined or sorted anew however many there are."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("w1_unwrap_chains", "w2_unwrap_two_strands", "a27_chain_centres"):
            plan = entry.queries()[name](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
            assert "Join" not in plan and "Window" not in plan, name
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("large", [frames.LARGE, 620, 0])
def test_chains_with_missing_values_match_sql(spark, tmp_path, monkeypatch, large):
    """Beads without frame, molecule, id or coordinate are kept as in SQL, whatever the size of the frames (here 545 to 640 beads)."""
    con = duckdb.connect()
    changes = {"l_suppkey": "n % 29 = 0", "l_partkey": "n % 31 = 0", "l_extendedprice": "n % 7 = 0", "l_linenumber": "n % 601 = 0"}
    holes = ", ".join(f"CASE WHEN {where} THEN NULL ELSE {c} END AS {c}" for c, where in changes.items())
    con.execute(
        f"""COPY (SELECT * REPLACE ({holes}) FROM (SELECT *, file_row_number AS n FROM read_parquet('{FOLDER}/lineitem.parquet', file_row_number = true)))
            TO '{tmp_path}/holes.parquet'"""
    )
    # beads without an id follow each other in any order: one in a chain is kept
    con.execute(
        f"""COPY (SELECT * EXCLUDE (n) FROM read_parquet('{tmp_path}/holes.parquet') QUALIFY l_partkey * l_linenumber IS NOT NULL
            OR ROW_NUMBER() OVER (PARTITION BY l_suppkey, if(l_partkey % 15 = 0, 0, l_partkey % 150), l_partkey * l_linenumber IS NULL ORDER BY n) = 1) TO '{tmp_path}/lineitem.parquet'"""
    )
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{tmp_path}/lineitem.parquet')")
    monkeypatch.setattr(frames, "LARGE", large)
    for name in ("w1_unwrap_chains", "w2_unwrap_two_strands", "a27_chain_centres"):
        df = entry.queries()[name](spark, str(tmp_path))
        cur = con.execute(entry.oracle_sql()[name])
        want = rows([d[0] for d in cur.description], cur.fetchall())
        assert rows(df.columns, [tuple(r) for r in df.collect()]) == want, name
        assert any("None" in r for r in want[1])
