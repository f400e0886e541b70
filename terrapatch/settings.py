"""Defaults and names."""

from __future__ import annotations

import json
import os

NEIGHBOURHOOD = "8"
NODATA = 0
#: Side of the square tiles in which rasters are worked on; a tile is what one task holds.
TILE = 256
#: Cells are square if width and height differ by no more than this share.
SQUARE_RTOL = 0.001
#: k of the clusterings that are compared.
K_RANGE = tuple(range(2, 8))

# The names of the metrics, as users of such libraries know them (misspelt ones included).
PATCH = ("area", "perimeter", "perimeter_area_ratio", "shape_index", "fractal_dimension", "core_area", "number_of_core_areas", "core_area_index", "euclidean_nearest_neighbor")
DISTRIBUTED = ("area", "perimeter", "perimeter_area_ratio", "shape_index", "fractal_dimension", "core_area", "disjunct_core_area", "core_area_index", "euclidean_nearest_neighbor")
SUFFIXES = ("mn", "am", "md", "ra", "sd", "cv")
ENTROPIES = ("entropy", "shannon_diversity_index", "joint_entropy", "conditional_entropy", "mutual_information", "relative_mutual_information", "contagion")
OF_CLASSES = (
    "total_area",
    "proportion_of_landscape",
    "number_of_patches",
    "patch_density",
    "largest_patch_index",
    "total_edge",
    "edge_density",
    "total_core_area",
    "core_area_proportion_of_landscape",
    "number_of_disjunct_core_areas",
    "landscape_shape_index",
    "effective_mesh_size",
)
OF_LANDSCAPES = (
    "total_area",
    "number_of_patches",
    "patch_density",
    "largest_patch_index",
    "total_edge",
    "edge_density",
    "total_core_area",
    "number_of_disjunct_core_areas",
    "landscape_shape_index",
    "effective_mesh_size",
)
#: May be asked for, but are in no default list.
EXTRA = ("disjunct_core_area_density",)
#: Known names without a definition yet, besides the distributions of the first two.
UNDEFINED_NAMES = ("continguity_index", "proximity", "interspersion_juxtaposition_index")
#: Abbreviations.
SHORT = {
    "area": "AREA",
    "perimeter": "PERIM",
    "perimeter_area_ratio": "PARA",
    "shape_index": "SHAPE",
    "fractal_dimension": "FRAC",
    "core_area": "CORE",
    "core_area_index": "CAI",
    "euclidean_nearest_neighbor": "ENN",
}
SHORT_OTHERS = {
    "number_of_core_areas": "NCORE",
    "total_area": "TA",
    "proportion_of_landscape": "PLAND",
    "number_of_patches": "NP",
    "patch_density": "PD",
    "largest_patch_index": "LPI",
    "total_edge": "TE",
    "edge_density": "ED",
    "landscape_shape_index": "LSI",
    "effective_mesh_size": "MESH",
    "contagion": "CONTAG",
    "shannon_diversity_index": "SHDI",
}
# End of the fixed values.

DISTRIBUTIONS = tuple(f"{m}_{s}" for m in DISTRIBUTED for s in SUFFIXES)
CLASS = (*OF_CLASSES, *DISTRIBUTIONS)
LANDSCAPE = (*OF_LANDSCAPES, *ENTROPIES, *DISTRIBUTIONS)
UNDEFINED = (*UNDEFINED_NAMES, *(f"{m}_{s}" for m in UNDEFINED_NAMES[:2] for s in SUFFIXES))
#: Metrics over patches that are sums over cells, however the cells are cut into patches.
ADDITIVE = ("total_area", "proportion_of_landscape", "total_core_area", "core_area_proportion_of_landscape")
#: What an absent class counts as, where frames are filled.
FILL = {f"{m}_{s}": 0 for m in ("area", "perimeter", "core_area") for s in ("mn", "am", "md", "ra", "sd")} | {m: 0 for m in ("total_area", "proportion_of_landscape", "number_of_patches", "patch_density", "largest_patch_index", "total_edge", "edge_density", "landscape_shape_index")}

#: Of disjunct core areas the suffix stays in lower case.
LABELS = SHORT | SHORT_OTHERS | {f"{m}_{s}": f"{short}_{s.upper()}" for m, short in SHORT.items() for s in SUFFIXES} | {f"disjunct_core_area_{s}": f"DCORE_{s}" for s in SUFFIXES}
LABELS |= json.loads(os.environ.get("METRIC_LABEL_DICT") or "{}")
