"""Values fixed by the definition of the analyses."""

# Sampling grid (one-based frames), contact cutoffs and the primary cutoff in nm.
FIRST_FRAME = 1001
LAST_FRAME = 5000
FRAME_STEP = 4
FRAMES_PER_BLOCK = 1000
US_PER_FRAME = 0.001
CUTOFFS_NM = [1.0, 1.2, 1.4]
PRIMARY_CUTOFF_NM = 1.2

# Species codes and chain lengths.
SPECIES_CODE = {"MED1": 0, "OCT4": 1, "DNA": 2}
SPECIES_LENGTH = {"MED1": 1581, "OCT4": 360, "DNA": 400}
ANCHOR_SPECIES = "DNA"

# Cuts of the long chain into four blocks (after these residues).
BLOCK_CUTS = [354, 807, 1171]

# Radial histogram, 0.25 nm bins on [0, 60) and one overflow bin.
HISTOGRAM_MAX_NM = 60.0
HISTOGRAM_BINS = 240
WITHIN_NM = 10.0

# Covalent masks and the block boundaries that each of them keeps.
MASK_BOUNDARIES = {"Full": [0, 1, 2], "Split-2": [0, 2], "Split-4": []}

# Residue charges (histidine 0.25).
RESIDUE_CHARGE = {"ARG": 1.0, "LYS": 1.0, "HIS": 0.25, "ASP": -1.0, "GLU": -1.0}

# Physical constants and the reference box of the composition series.
AVOGADRO = 6.02214076e23
BASE_BOX_NM = 75.0
BASE_BOX_RESIDUES = 36000

# Run parameter default, and the tag of a selected-frame map.
DEFAULT_TIMESTEP_FS = 10.0
FRAME_MAP_NAME = "trajectory_frames.json"
TASK_FILES = ["DONE", "start.pdb", "output.dcd", "molecule_map.tsv"]
REPLICATES = ["work", "work-1", "work-2"]
TIE_PREFERENCE_US = 3.0
TIE_WEIGHT_PER_US = 0.05
SCALE_FLOOR = 1e-8
