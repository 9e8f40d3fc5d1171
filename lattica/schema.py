"""Explicit schemas of every source; nothing is inferred from data."""

from __future__ import annotations

MANIFEST = (
    "task_id STRING, system STRING, replicate STRING, tier STRING, series_tags STRING, n_med1 INT, n_oct4 INT, n_dna INT, "
    "med1_fragments INT, box_nm DOUBLE, coord_seed BIGINT, seed BIGINT, total_steps BIGINT, output_interval BIGINT, "
    "parent_task STRING, coordinate_source STRING"
)
MOLECULE_MAP = (
    "molecule_id STRING, molecule_type STRING, parent_med1 INT, fragment INT, particle_start INT, particle_stop_exclusive INT, "
    "residue_start INT, residue_stop_inclusive INT"
)
POSITIONS = "system STRING, replicate STRING, frame INT, bead INT, x FLOAT, y FLOAT, z FLOAT"
FRAME_MAP = "schema STRING, purpose STRING, source_frame_count INT, source_frames_one_based ARRAY<INT>"
RUN_METADATA = (
    "exclusion_audit STRUCT<assembled_exclusions: INT, custom_nonbonded_force_exclusions: ARRAY<INT>, "
    "med1_exclusions_per_chain: STRUCT<before_filter_refresh: INT, after_filter_refresh: INT, after_split: INT, fragments: INT, stale_removed: INT>, "
    "particles: INT, med1_physical_chains: INT, med1_sequence_equivalents: INT>, "
    "run_parameters STRUCT<timestep_fs: DOUBLE, total_steps: BIGINT, output_interval: BIGINT>, "
    "start_pdb_sha256 STRING, system_xml_sha256 STRING"
)
STATE_REPORT = "task_id STRING, step BIGINT, potential_kj_mol DOUBLE, kinetic_kj_mol DOUBLE, temperature_k DOUBLE"
