"""Readers of manifests, molecule maps, run metadata, frame maps, atom records, result tables and checksum lists."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica import constants as C
from lattica import schema
from lattica.functions.scalars import inclusion_basis
from lattica.operators.sequences import expand_interval

# <root>/<replicate>/<system>/<file>
_PATH = r"([^/]+)/([^/]+)/[^/]+$"


def _task_columns(path="path"):
    return [F.regexp_extract(path, _PATH, 2).alias("system"), F.regexp_extract(path, _PATH, 1).alias("replicate")]


def manifest(spark: SparkSession, path: str, systems: Sequence[str] | None = None) -> DataFrame:
    """Task manifest (TSV), restricted to the designated systems."""
    df = spark.read.csv(path, sep="\t", header=True, schema=schema.MANIFEST)
    return df.where(F.col("system").isin(list(systems))) if systems else df


def present_tasks(spark: SparkSession, root: str, required: Sequence[str] = tuple(C.TASK_FILES)) -> DataFrame:
    """Tasks whose folder holds every required file. Only paths are read, never contents."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    names = files.select(*_task_columns(), F.element_at(F.split("path", "/"), -1).alias("name")).where(F.col("name").isin(list(required)))
    counted = names.groupBy("system", "replicate").agg(F.count_distinct("name").alias("_n"))
    return counted.where(F.col("_n") == len(required)).select("system", "replicate", F.lit(True).alias("available"))


def json_per_task(spark: SparkSession, root: str, name: str, ddl: str) -> DataFrame:
    """One JSON document per task folder, with the task taken from the path."""
    df = spark.read.schema(ddl).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", name).json(root)
    return df.select(*_task_columns(F.col("_metadata.file_path")), "*")


def run_parameters(metadata: DataFrame, tasks: DataFrame) -> DataFrame:
    """Run parameters with their defaults, and the derived spacing and duration."""
    given = metadata.select("system", "replicate", "run_parameters.*").toDF("system", "replicate", "_ts", "_steps", "_interval")
    out = tasks.join(given, ["system", "replicate"], "left")
    out = (
        out.withColumn("timestep_fs", F.coalesce("_ts", F.lit(C.DEFAULT_TIMESTEP_FS)))
        .withColumn("total_steps", F.coalesce("_steps", "total_steps"))
        .withColumn("output_interval", F.coalesce("_interval", "output_interval"))
        .drop("_ts", "_steps", "_interval")
    )
    return out.withColumn("output_spacing_ns", F.col("timestep_fs") * F.col("output_interval") / 1e6).withColumn(
        "duration_us", F.col("timestep_fs") * F.col("total_steps") / 1e9
    )


def include_tasks(tasks: DataFrame, present: DataFrame, explicit: DataFrame) -> DataFrame:
    """Availability, inclusion and its basis. ``explicit(system, replicate)`` lists keys that are always included."""
    out = tasks.join(present, ["system", "replicate"], "left").join(explicit.withColumn("_explicit", F.lit(True)), ["system", "replicate"], "left")
    out = out.withColumn("available", F.coalesce("available", F.lit(False))).withColumn("_explicit", F.coalesce("_explicit", F.lit(False)))
    out = out.withColumn("analysis_included", F.col("available") & ((F.col("timestep_fs") == C.DEFAULT_TIMESTEP_FS) | F.col("_explicit")))
    return out.withColumn("inclusion_basis", inclusion_basis("available", "_explicit", "analysis_included")).drop("_explicit")


def molecule_maps(spark: SparkSession, root: str) -> DataFrame:
    """Molecule intervals of all tasks; a molecule's number is its rank by first particle."""
    df = (
        spark.read.schema(schema.MOLECULE_MAP)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "molecule_map.tsv")
        .csv(root, sep="\t", header=True)
    )
    return df.select(*_task_columns(F.col("_metadata.file_path")), "*")


def bead_table(maps: DataFrame) -> DataFrame:
    """One row per bead: molecule, species, parent and zero-based residue."""
    beads = expand_interval(maps, "particle_start", "particle_stop_exclusive", residue_start="residue_start")
    return beads.select(
        "system", "replicate", "bead", F.col("particle_start").alias("molecule"), F.col("molecule_type").alias("species"), "residue", (F.col("parent_med1") - 1).alias("parent")
    )


def frame_maps(spark: SparkSession, root: str) -> DataFrame:
    return json_per_task(spark, root, C.FRAME_MAP_NAME, schema.FRAME_MAP)


def stored_indices(maps: DataFrame, requested: Sequence[int]) -> DataFrame:
    """Original frame -> stored index (zero-based); requested frames that are not stored have a missing index.

    A range stays a sequence expression; nothing is joined or broadcast to list the requested frames.
    """
    if isinstance(requested, range):
        wanted_frames = F.sequence(F.lit(requested[0]), F.lit(requested[-1]), F.lit(requested.step))
    else:
        wanted_frames = F.array(*[F.lit(int(f)) for f in requested])
    stored = maps.select("system", "replicate", F.posexplode("source_frames_one_based").alias("stored_index", "frame"))
    wanted = maps.select("system", "replicate", F.explode(wanted_frames).alias("frame"))
    return wanted.join(stored, ["system", "replicate", "frame"], "left")


# Field name -> (first column, width, type) of the Protein Data Bank's atom record.
ATOM_FIELDS = {
    "recname": (1, 6, "STRING"), "serial": (7, 5, "INT"), "name": (13, 4, "STRING"), "alt_loc": (17, 1, "STRING"), "res_name": (18, 3, "STRING"),
    "chain": (22, 1, "STRING"), "res_seq": (23, 4, "INT"), "i_code": (27, 1, "STRING"), "x": (31, 8, "DOUBLE"), "y": (39, 8, "DOUBLE"), "z": (47, 8, "DOUBLE"),
    "occupancy": (55, 6, "DOUBLE"), "temp_factor": (61, 6, "DOUBLE"), "element": (77, 2, "STRING"), "charge": (79, 2, "STRING"),
}


def fixed_width_fields(lines: DataFrame, keep: Sequence[str], value: str = "value", fields: dict[str, tuple[int, int, str]] = ATOM_FIELDS) -> DataFrame:
    """Fields of fixed-width lines of any length, beside the columns to keep. A blank field, or one that isn't of its type,
    is missing."""
    columns = [f"try_cast(nullif(trim(substring({value}, {a}, {n})), '') AS {kind}) AS {name}" for name, (a, n, kind) in fields.items()]
    return lines.selectExpr(*keep, *columns)


def atom_records(spark: SparkSession, path: str) -> DataFrame:
    """Fixed-width atom records of many files (Protein Data Bank columns)."""
    lines = spark.read.text(path, recursiveFileLookup=True).where("startswith(value, 'ATOM  ') OR startswith(value, 'HETATM')")
    out = fixed_width_fields(lines, ["_metadata.file_path AS file"])
    return out.fillna({"occupancy": 0.0, "temp_factor": 0.0, "element": "", "charge": ""})


def checksum_list(spark: SparkSession, path: str) -> DataFrame:
    """``<sha256>  <path>`` lines; a star before the path marks binary mode and is dropped."""
    parts = F.split("value", r"\s+", 2)
    return spark.read.text(path).where("length(value) > 0").select(F.lower(parts[0]).alias("sha256"), F.regexp_replace(parts[1], r"^\*", "").alias("path"))


def content_digests(rows: DataFrame, keep: Sequence[str], content: str = "content") -> DataFrame:
    """SHA-256 and size in bytes of each row's whole content, beside the columns to keep."""
    return rows.select(*keep, F.sha2(content, 256).alias("sha256"), F.octet_length(content).cast("long").alias("bytes"))


def file_digests(spark: SparkSession, root: str) -> DataFrame:
    """Digest of every whole file below ``root``, by path relative to it. A file is one value, so 2 GiB is the most it may
    have; larger trajectories are verified by the digests of their parts."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    relative = F.regexp_extract("path", re.escape(root.rstrip("/")) + "/(.*)$", 1)
    return content_digests(files.withColumn("path", relative), ["path"])


def result_table(spark: SparkSession, path: str, ddl: str, kind: str = "parquet") -> DataFrame:
    """A stored result with an explicit schema; a missing path is an error."""
    reader = spark.read.schema(ddl)
    return reader.parquet(path) if kind == "parquet" else reader.csv(path, header=True)


def initial_frames(positions: DataFrame, starts: DataFrame) -> DataFrame:
    """Start structures as frame 0 next to the production frames."""
    return positions.withColumn("frame_scope", F.lit("production")).unionByName(starts.withColumn("frame", F.lit(0)).withColumn("frame_scope", F.lit("initial")))
