"""Lineages, taxonomy trees and the relation of two genomes.

A lineage is an array of nine prefixed taxon names, one per rank, NULL where a rank is missing.  A tree is a table
``name, level, parent, label``; the root is its own parent.
"""

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from sigloom.model import N_RANKS, RANK_PREFIXES, RANKS, RELATION_LABELS, UNKNOWN_RELATION
from sigloom.session import cut_lineage

# --- fixed values -----------------------------------------------------------------------------
RANK_LEVELS = {
    "domain": -1.0,
    "kingdom": 0.0,
    "phylum": 1.0,
    "class": 2.0,
    "order": 3.0,
    "family": 4.0,
    "genus": 5.0,
    "species": 6.0,
    "sp.": 6.0,
    "subspecies": 6.5,
    "ssp.": 6.5,
    "strain": 7.0,
    "st.": 7.0,
}
UNRANKED_LEVEL = -1.0
LEAF_LEVEL = 8.0
LABEL_PREFIX = "#&@"
SCIENTIFIC_NAME = "scientific name"
WORD_SEPARATORS = " _-.:"
# ----------------------------------------------------------------------------------------------

GENUS, SPECIES = RANKS.index("genus"), RANKS.index("species")
PHYLUM, FAMILY = RANKS.index("phylum"), RANKS.index("family")


def _col(c):
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------- parsing

def gtdb_lineage(text):
    """Lineage of ``d__…;p__…;…`` text; the domain fills the first rank."""
    parts = F.transform(F.split(_col(text), ";"), lambda p: F.regexp_replace(F.trim(p), "^d__", RANK_PREFIXES[0]))

    def first_with(prefix):
        return F.get(F.filter(parts, lambda p: F.startswith(p, F.lit(prefix))), F.lit(0))

    return F.array(*[first_with(prefix) for prefix in RANK_PREFIXES])


def _ranked(values):
    """Nine-slot lineage from a ``{rank index: name expression}`` mapping."""
    slots = [F.concat(F.lit(RANK_PREFIXES[r]), values[r]) if r in values else F.lit(None).cast("string") for r in range(N_RANKS)]
    return F.array(*slots)


def pcof_lineage(text):
    """Lineage of ``PhylumClassOrderFamily_Genus_species_strain_id`` file-name text and its short forms.

    Capitalised words before the first underscore are the ranks ending at family.  Text without an underscore is
    ``Genus species`` or ``Genus.species``.  One capitalised word is a genus when a lower-case word or its own
    repetition follows, and a family otherwise.  Six or more capitalised words are not a lineage.
    """
    text = _col(text)
    head = F.regexp_extract(text, "^([^_]*)", 1)
    tail = F.regexp_extract(text, "^[^_]*_(.*)$", 1)
    parts = F.split(tail, "_")
    underscores = F.length(text) - F.length(F.translate(text, "_", ""))
    capitals = F.length(F.regexp_replace(head, "[^A-Z]", ""))

    plain_first = F.regexp_extract(text, "^([^. ]*)", 1)
    plain_rest = F.regexp_extract(text, "^[^. ]*[. ](.*)$", 1)
    plain = F.when(text.rlike("[. ]"), _ranked({GENUS: plain_first, SPECIES: plain_rest})).otherwise(_ranked({GENUS: text}))

    genus_species = ~tail.rlike("^[A-Z]") | F.startswith(tail, head)
    single = F.when(genus_species, _ranked({GENUS: head, SPECIES: tail})).otherwise(_ranked({FAMILY: head, GENUS: tail}))

    words = F.when(capitals == 0, F.array(head)).otherwise(F.regexp_extract_all(head, F.lit("([A-Z][^A-Z]*)"), F.lit(1)))
    n = F.size(words)
    upper = [F.get(words, n - 1 - (FAMILY - r)) for r in range(FAMILY + 1)]
    genus = F.when(underscores == 1, tail).otherwise(F.get(parts, F.lit(0)))
    last = F.size(parts) - 1
    species = F.when(underscores > 1, F.get(parts, F.lit(1)))
    strain = F.when(underscores == 3, F.get(parts, F.lit(2))).when(
        underscores > 3, F.array_join(F.slice(parts, F.lit(3), F.greatest(last - 2, F.lit(0))), "_"))
    unique = F.when(underscores > 3, F.get(parts, last))
    full = _ranked({**dict(enumerate(upper)), GENUS: genus, SPECIES: species, RANKS.index("strain"): strain,
                    RANKS.index("uniqueid"): unique})
    return F.when(underscores == 0, plain).when(capitals == 1, single).when(capitals < 6, full)


def rank_level(rank):
    """Numeric level of an NCBI rank name; the first letter's case does not matter, unknown ranks are unranked."""
    rank = _col(rank)
    name = F.concat(F.lower(F.substring(rank, 1, 1)), F.substring(rank, F.lit(2), F.length(rank)))
    table = F.create_map(*[F.lit(v) for item in RANK_LEVELS.items() for v in item])
    return F.coalesce(F.try_element_at(table, name), F.lit(UNRANKED_LEVEL))


# ---------------------------------------------------------------- relations

def relation(lineage_a, lineage_b):
    """Deepest common rank of two lineages: -1 when either is absent, never below 0 otherwise.

    Ranks missing on a side are skipped; the scan ends at the first rank where both are present and differ.
    """
    a, b = _col(lineage_a), _col(lineage_b)
    def at(lineage, r):
        taxon = F.get(lineage, F.lit(r))
        return F.coalesce(taxon, F.lit("")) if r == 0 else taxon
    differs = [F.coalesce((at(a, r) != at(b, r)).cast("int"), F.lit(0)) for r in range(N_RANKS)]
    stop = reduce(lambda deeper, r: F.when(differs[r] == 1, F.lit(r)).otherwise(deeper), reversed(range(N_RANKS)), F.lit(N_RANKS))
    common = [F.when((at(a, r) == at(b, r)) & (F.lit(r) < stop), F.lit(r)).otherwise(F.lit(-1)) for r in range(N_RANKS)]
    return F.when(a.isNull() | b.isNull(), F.lit(-1)).otherwise(F.greatest(*common)).cast("int")


def relation_label(code):
    labels = F.array(*[F.lit(x) for x in RELATION_LABELS])
    return F.coalesce(F.get(labels, _col(code).cast("int")), F.lit(UNKNOWN_RELATION))


def rank_of(lineage, rank):
    return F.get(_col(lineage), F.lit(RANKS.index(rank)))


def deepest_rank(lineage):
    """Index of the last present rank, -1 when there is none."""
    ranks = F.transform(_col(lineage), lambda x, i: F.when(x.isNotNull(), i).otherwise(F.lit(-1)))
    return F.coalesce(F.array_max(ranks), F.lit(-1))


def parent_level(lineage):
    """Index of the present rank just above the deepest one, -1 when there is none."""
    lineage = _col(lineage)
    last = deepest_rank(lineage)
    ranks = F.transform(lineage, lambda x, i: F.when(x.isNotNull() & (i < last), i).otherwise(F.lit(-1)))
    return F.coalesce(F.array_max(ranks), F.lit(-1))


def readable_name(lineage):
    """Human-readable name of the deepest taxon.

    Down to genus: the taxon, followed by its phylum in brackets.  From species on: genus, species and the next
    name below, each without its rank prefix and without a repetition of the name before it.
    """
    lineage = _col(lineage)
    deepest = deepest_rank(lineage)
    own, phylum = F.get(lineage, deepest), F.get(lineage, F.lit(PHYLUM))
    high = F.when((deepest > PHYLUM) & phylum.isNotNull(), F.concat(own, F.lit(" ("), phylum, F.lit(")"))).otherwise(own)

    bare = F.transform(lineage, lambda x: F.regexp_replace(x, "^[a-z]__", ""))
    genus, species = F.get(bare, F.lit(GENUS)), F.get(bare, F.lit(SPECIES))
    below = F.coalesce(F.get(bare, F.lit(SPECIES + 1)), F.get(bare, F.lit(SPECIES + 2)))

    def without(name, previous):
        rest = F.substring(name, F.length(previous) + 2, F.length(name))
        follows = F.contains(F.lit(WORD_SEPARATORS), F.substring(name, F.length(previous) + 1, F.lit(1)))
        return F.when(F.startswith(name, previous) & (F.length(name) > F.length(previous)) & follows, rest).otherwise(name)

    low = F.concat_ws(" ", genus, F.coalesce(without(species, genus), species), F.coalesce(without(below, species), below))
    return F.when(deepest < 0, F.lit("unclassified")).when(deepest < SPECIES, high).otherwise(low)


# ---------------------------------------------------------------- trees

def tree_from_lineages(lineages: DataFrame, lineage_col="lineage", order_col="ord") -> DataFrame:
    """``name, level, parent``: every taxon once, under the parent it was first seen with."""
    entries = lineages.select(F.col(order_col).alias("_ord"), F.filter(
        F.transform(lineage_col, lambda x, i: F.struct(x.alias("name"), i.alias("level"))), lambda s: s["name"].isNotNull()).alias("_path"))
    steps = entries.select("_ord", "_path", F.posexplode("_path").alias("_i", "_node"))
    parent = F.when(F.col("_i") > 0, F.get("_path", F.col("_i") - 1)["name"]).otherwise(F.lit("root"))
    return (
        steps.select("_ord", F.col("_node.name").alias("name"), F.col("_node.level").cast("double").alias("level"), parent.alias("parent"))
        .groupBy("name").agg(F.min_by(F.struct("level", "parent"), F.struct("_ord", "level", "parent")).alias("_first"))
        .select("name", "_first.level", "_first.parent"))


def add_leaves(nodes: DataFrame, leaves: DataFrame) -> DataFrame:
    """Attach samples ``name, taxon`` to the tree at leaf level."""
    rows = leaves.select(F.col("name"), F.lit(LEAF_LEVEL).alias("level"), F.col("taxon").alias("parent"))
    return nodes.select("name", "level", "parent").unionByName(rows)


def add_labels(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """Attach the scientific names of ``names(id, name, class)`` as labels."""
    scientific = names.where(F.col("class") == SCIENTIFIC_NAME).groupBy("id").agg(F.min("name").alias("label"))
    return nodes.join(scientific, nodes["name"] == scientific["id"], "left").drop("id")


def apply_aliases(nodes: DataFrame, aliases: DataFrame) -> DataFrame:
    """Rename or merge taxa by ``aliases(old, new)`` and keep every old name usable.

    Both known: the old name takes over level and parent of the new one.  Only the old known: it is renamed.  Only
    the new known: the old name becomes a redirect.  Neither known: an unranked taxon is created below the root.
    The result has ``name, level, parent, alias_of``; ``alias_of`` is set on redirecting names.
    """
    known = nodes.select(F.col("name"), F.col("level"), F.col("parent"))
    old = known.select(F.col("name").alias("old"), F.col("level").alias("_ol"), F.col("parent").alias("_op"), F.lit(True).alias("_ok"))
    new = known.select(F.col("name").alias("new"), F.col("level").alias("_nl"), F.col("parent").alias("_np"), F.lit(True).alias("_nk"))
    matched = aliases.dropDuplicates(["old"]).join(old, "old", "left").join(new, "new", "left")
    old_known, new_known = F.col("_ok").isNotNull(), F.col("_nk").isNotNull()
    level = F.when(new_known, F.col("_nl")).when(old_known, F.col("_ol")).otherwise(F.lit(UNRANKED_LEVEL))
    parent = F.when(new_known, F.col("_np")).when(old_known, F.col("_op")).otherwise(F.lit("root"))
    redirects = matched.select(F.col("old").alias("name"), level.alias("level"), parent.alias("parent"), F.col("new").alias("alias_of"))
    created = matched.where(~new_known).select(
        F.col("new").alias("name"), level.alias("level"), parent.alias("parent"), F.lit(None).cast("string").alias("alias_of")
    ).dropDuplicates(["name"])
    untouched = known.join(aliases.select(F.col("old").alias("name")).distinct(), "name", "left_anti").withColumn(
        "alias_of", F.lit(None).cast("string"))
    merged = untouched.unionByName(redirects).unionByName(created)
    # children of a renamed taxon follow it
    moved = aliases.dropDuplicates(["old"]).select(F.col("old").alias("parent"), F.col("new").alias("_moved"))
    return merged.join(moved, "parent", "left").select("name", "level", F.coalesce("_moved", "parent").alias("parent"), "alias_of")


def ancestor_lineages(nodes: DataFrame, max_rounds=32) -> DataFrame:
    """``name, lineage``: for every node the names of its ancestors-or-self at the nine integer levels.

    Pointer doubling: each round joins the table with itself and doubles the walked distance, so a tree of depth
    ``d`` takes ``log2 d`` joins.  On a repeated level the ancestor nearest to the root wins.
    """
    root = nodes["parent"].isNull() | (nodes["parent"] == nodes["name"])
    level = F.col("level")
    slots = F.array(*[F.when(level == r, F.col("name")) for r in range(N_RANKS)])
    walk = nodes.select("name", F.when(~root, F.col("parent")).alias("up"), slots.alias("lineage"))
    walk = cut_lineage(walk)
    for _ in range(max_rounds):
        # rows that have reached their root leave the join: their NULL would be one key for nearly all rows in the late rounds
        above = walk.select(F.col("name").alias("up"), F.col("up").alias("_up2"), F.col("lineage").alias("_above"))
        joined = walk.where(F.col("up").isNotNull()).join(above, "up", "left")
        merged = F.when(F.col("_above").isNull(), F.col("lineage")).otherwise(
            F.zip_with("_above", "lineage", lambda high, low: F.coalesce(high, low)))
        moved = joined.select("name", F.col("_up2").alias("up"), merged.alias("lineage"))
        walk = cut_lineage(walk.where(F.col("up").isNull()).unionByName(moved))
        if walk.where(F.col("up").isNotNull()).isEmpty():
            return walk.select("name", "lineage")
    raise ValueError("the parent chain does not end: the tree has a cycle")


def resolve_taxon(names: DataFrame, nodes: DataFrame, name_col="name") -> DataFrame:
    """``…, taxon``: the node of a name, or the parent of the entry labelled with it, NULL when unknown."""
    direct = nodes.select(F.col("name").alias("_n"), F.col("name").alias("_direct"))
    labelled = nodes.where(F.startswith("name", F.lit(LABEL_PREFIX))).select(
        F.substr("name", F.lit(len(LABEL_PREFIX) + 1)).alias("_l"), F.col("parent").alias("_labelled"))
    return (names.join(direct, F.col(name_col) == F.col("_n"), "left").join(labelled, F.col(name_col) == F.col("_l"), "left")
            .withColumn("taxon", F.coalesce("_direct", "_labelled")).drop("_n", "_l", "_direct", "_labelled"))


def assign_lineage(sigs: DataFrame, lineages: DataFrame, keys=("filepath", "name")) -> DataFrame:
    """Left-join lineages ``name, lineage`` by each key in turn; the first match wins."""
    table = lineages.dropDuplicates(["name"])
    out, found = sigs.drop("lineage"), []
    for i, key in enumerate(k for k in keys if k in sigs.columns):
        side = table.select(F.col("name").alias(f"_k{i}"), F.col("lineage").alias(f"_v{i}"))
        out = out.join(side, out[key] == F.col(f"_k{i}"), "left").drop(f"_k{i}")
        found.append(f"_v{i}")
    return out.withColumn("lineage", F.coalesce(*found)).drop(*found)


def apply_name_aliases(sigs: DataFrame, aliases: DataFrame, lineage_labels=False) -> DataFrame:
    """Rename signatures by ``aliases(old, new)``; with ``lineage_labels`` unnamed ones take their readable taxon name."""
    side = aliases.dropDuplicates(["old"]).select(F.col("old").alias("name"), F.col("new").alias("_new"))
    fallback = readable_name("lineage") if lineage_labels else F.col("name")
    return sigs.join(side, "name", "left").withColumn("name", F.coalesce("_new", fallback, "name")).drop("_new")


# ---------------------------------------------------------------- filters and weights

def matches_term(term, name_cols=("name",), lineage_col="lineage"):
    """A taxon of the lineage, an equal name, or a name starting with the term."""
    tests = [F.startswith(_col(c), F.lit(term)) for c in name_cols]
    if lineage_col is not None:
        tests.append(F.coalesce(F.array_contains(_col(lineage_col), term), F.lit(False)))
    return reduce(lambda x, y: x | y, tests)


def include_exclude(sigs: DataFrame, include=(), exclude=(), name_cols=("name",), lineage_col="lineage") -> DataFrame:
    """Keep what matches any ``include`` term (all when none are given), then drop what matches any ``exclude`` term."""
    if include:
        sigs = sigs.where(reduce(lambda x, y: x | y, [matches_term(t, name_cols, lineage_col) for t in include]))
    if exclude:
        sigs = sigs.where(~reduce(lambda x, y: x | y, [matches_term(t, name_cols, lineage_col) for t in exclude]))
    return sigs


WEIGHT_SALTS = 16
WEIGHT_RANKS = {"subspecies": 7, "subgroup": 7, **{r: i for i, r in enumerate(RANKS[:7]) if i > 0}}


def genome_weights(sigs: DataFrame, rank="species", approach="identity") -> DataFrame:
    """Add ``weight``, which shrinks with the number of genomes sharing the lineage through ``rank``.

    ``identity`` 1/n, ``sqrt`` 1/sqrt(n), ``log`` 1/ln(n), ``no_single`` 1/ln(n) above one else 0, an integer ``m`` 1/ln(n) from ``m`` genomes on
    else 0.  A logarithm of one leaves the weight NULL.  Group sizes are counted with map-side partial sums and joined back
    over ``WEIGHT_SALTS`` copies of each group, so a dominating group is spread over that many tasks; rows without the rank need no join.
    """
    through = WEIGHT_RANKS[rank]
    key = F.when(F.get("lineage", F.lit(through)).isNotNull(),
                 F.concat_ws("\u0001", *[F.coalesce(F.get("lineage", F.lit(r)), F.lit("")) for r in range(through + 1)]))
    keyed = sigs.withColumn("_key", key).withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(WEIGHT_SALTS)))
    sizes = keyed.where(F.col("_key").isNotNull()).groupBy("_key").agg(F.count("*").alias("_n"))
    n = F.coalesce(F.col("_n"), F.lit(1)).cast("double")
    log_share = F.when(n > 1, 1.0 / F.log(n))
    if approach == "identity":
        weight = 1.0 / n
    elif approach == "sqrt":
        weight = 1.0 / F.sqrt(n)
    elif approach == "log":
        weight = log_share
    elif approach == "no_single":
        weight = F.when(n > 1, log_share).otherwise(0.0)
    else:
        least = int(approach)
        weight = F.when(n >= (least if least > 0 else 2), log_share).otherwise(0.0)
    copies = sizes.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(WEIGHT_SALTS - 1).cast("long"))))
    known = keyed.where(F.col("_key").isNotNull()).join(copies, ["_key", "_salt"])
    alone = keyed.where(F.col("_key").isNull()).withColumn("_n", F.lit(1).cast("long"))
    return known.unionByName(alone).withColumn("weight", weight).drop("_key", "_salt", "_n")
