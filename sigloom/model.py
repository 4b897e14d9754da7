"""Shared vocabulary: ranks, relation labels and the frame layouts used across the package.

Frames are plain DataFrames with agreed column names:

* contigs     ``genome_id, ord, name, seq``
* signatures  ``id, sig ARRAY<DOUBLE>`` plus optional ``ord``, ``lineage ARRAY<STRING>`` (nine ranks), ``weight``
* pairs       ``id_a, id_b, relation INT, dist DOUBLE``
"""

# --- fixed values -----------------------------------------------------------------------------
RANKS = ("kingdom", "phylum", "class", "order", "family", "genus", "species", "strain", "uniqueid")
RANK_PREFIXES = ("k__", "p__", "c__", "o__", "f__", "g__", "s__", "t__", "i__")
RELATION_LABELS = (
    "Different_Phyla",
    "Same_Phylum",
    "Same_Class",
    "Same_Order",
    "Same_Family",
    "Same_Genus",
    "Same_Species",
    "Same_Subgroup",
    "Replicate",
)
UNKNOWN_RELATION = "?"
DEFAULT_MIN_CONTIG = 2000
DEFAULT_THETA = 0.02
DEFAULT_BIN_WIDTH = 0.001
# ----------------------------------------------------------------------------------------------

N_RANKS = len(RANKS)
RELATION_CODE = {label: code for code, label in enumerate(RELATION_LABELS)}
RELATION_CODE[UNKNOWN_RELATION] = -1


def relation_code(name):
    """Code of a relation label; ``?`` is the unknown relation, anything else must be a known label."""
    try:
        return RELATION_CODE[name]
    except KeyError:
        raise ValueError(f"unknown relation {name!r}; expected one of {sorted(RELATION_CODE)}") from None
