"""Fixed values that must equal the reference's for the same results.

Fixed values (stated as in the reference's defaults and notebooks):
- blended-distance weight alpha: 0.85
- clustering distance threshold: 2.0
- linkage used by the splitter: average
- boundary-detection threshold when none is given: 0.4
- topic pages sampled by the random strategy: at most 5
- gold page ranges of the hand-labelled input (inclusive):
  (0,0) (1,8) (9,11) (12,21) (22,29) (30,36) (37,38) (39,43) (44,45) (46,47) (48,48) (49,74)
- alpha grid: 0.75 0.8 0.825 0.85 0.875 0.9 0.925 0.95 1.0 1.1 1.2
- threshold grid: 1.3 1.4 1.5 1.6 1.7 1.8 1.9 2.0 2.1 2.15 2.2 2.25
- linkage grid: complete average single
- split level: 0.1 to 5.0 in steps of 0.1, default 2.0
- page file name: {stem}_page_{n} with n 1-based; output name: document_{n}_{topic}
- accepted page-image suffixes: .pdf .jpg .png (case-sensitive)
"""

DEFAULT_ALPHA = 0.85
DEFAULT_THRESHOLD = 2.0
DEFAULT_LINKAGE = "average"
DEFAULT_BOUNDARY_THRESHOLD = 0.4
TOPIC_SAMPLE_PAGES = 5

GOLD_RANGES = [(0, 0), (1, 8), (9, 11), (12, 21), (22, 29), (30, 36), (37, 38), (39, 43), (44, 45), (46, 47), (48, 48), (49, 74)]
ALPHA_GRID = [0.75, 0.8, 0.825, 0.85, 0.875, 0.9, 0.925, 0.95, 1.0, 1.1, 1.2]
THRESHOLD_GRID = [1.3, 1.4, 1.5, 1.6, 1.7, 1.8, 1.9, 2.0, 2.1, 2.15, 2.2, 2.25]
LINKAGE_GRID = ["complete", "average", "single"]
LINKAGES = ("average", "complete", "single")

SPLIT_LEVEL_MIN = 0.1
SPLIT_LEVEL_MAX = 5.0
SPLIT_LEVEL_STEP = 0.1
SPLIT_LEVEL_DEFAULT = 2.0

PAGE_NAME_FORMAT = "%s_page_%d"
DOCUMENT_NAME_FORMAT = "document_%d_%s"
PAGE_FILE_SUFFIXES = (".pdf", ".jpg", ".png")

# Our own choices (not the reference's): rounding used before comparing distances so that
# engines summing in different orders agree; hashed-term vector width; seed of the page sample.
DIST_DECIMALS = 9
HASH_CELLS = 64
SAMPLE_SEED = "quire"
