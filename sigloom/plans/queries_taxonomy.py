"""Queries on lineages and trees: nations as classes, parts as file-name lineages, orders as the lowest rank."""

from pyspark.sql import functions as F

from sigloom.functions import text as X
from sigloom.operators import taxonomy as T
from sigloom.operators.pairs import PairJob
from sigloom.plans.catalog import query, table
from sigloom.plans.queries_vectors import S_SQL, supplier_lineages
from sigloom.sources.fasta import genome_name

# ---------------------------------------------------------------- inputs

_CUSTOMER_TEXT = "'d__World;p__' || r_name || ';c__' || n_name || ';o__' || c_mktsegment || case when c_custkey % 5 = 0 then '' else ';s__' || c_name end"


def customer_lineage_text(spark, d):
    text = F.concat(F.lit("d__World;p__"), "r_name", F.lit(";c__"), "n_name", F.lit(";o__"), "c_mktsegment",
                    F.when(F.col("c_custkey") % 5 == 0, "").otherwise(F.concat(F.lit(";s__"), "c_name")))
    return (table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
            .join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(F.col("c_custkey").alias("ord"), F.col("c_name").alias("name"), text.alias("text")))


def customer_lineages(spark, d):
    return customer_lineage_text(spark, d).select("ord", "name", T.gtdb_lineage("text").alias("lineage"))


C_SQL = f"""c as (select c_custkey as ord, c_name as name, r_name, n_name, c_mktsegment as seg,
  case when c_custkey % 5 = 0 then null else 's__' || c_name end as sp from customer
  join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey)"""
_SLOTS = [f"l{i}" for i in range(9)]


def slots(df, *keep):
    return df.select(*keep, *[F.get("lineage", F.lit(i)).alias(n) for i, n in enumerate(_SLOTS)])


def world_nodes(spark, d):
    """Adjacency form of region > nation > customer > order; orders sit two levels below their customer."""
    node = lambda df, name, level, parent: df.select(name.alias("name"), F.lit(level).alias("level"), parent.alias("parent"))
    r, n, c, o = (table(spark, d, t) for t in ("region", "nation", "customer", "orders"))
    key = lambda prefix, col: F.concat(F.lit(prefix), F.col(col).cast("string"))
    root = spark.range(1).select(F.lit("root").alias("name"), F.lit(-2.0).alias("level"), F.lit("root").alias("parent"))
    return (root.unionByName(node(r, key("r", "r_regionkey"), 1.0, F.lit("root")))
            .unionByName(node(n, key("n", "n_nationkey"), 2.0, key("r", "n_regionkey")))
            .unionByName(node(c, key("c", "c_custkey"), 4.0, key("n", "c_nationkey")))
            .unionByName(node(o, key("o", "o_orderkey"), 6.0, key("c", "o_custkey"))))


N_SQL = """nodes as (select 'root' as name, -2.0::double as level, 'root' as parent
  union all select 'r' || r_regionkey, 1.0, 'root' from region union all select 'n' || n_nationkey, 2.0, 'r' || n_regionkey from nation
  union all select 'c' || c_custkey, 4.0, 'n' || c_nationkey from customer union all select 'o' || o_orderkey, 6.0, 'c' || o_custkey from orders)"""

# fixed values, written out here so that the SQL does not share the table under test
_RANK_NAMES = ["domain", "kingdom", "phylum", "class", "order", "family", "genus", "species", "sp.", "subspecies", "ssp.", "strain", "st.",
               "Species", "Domain", "clade", "no rank"]
_RANK_VALUES = [-1.0, 0.0, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 6.0, 6.5, 6.5, 7.0, 7.0, 6.0, -1.0, -1.0, -1.0]
_LABELS = ["Different_Phyla", "Same_Phylum", "Same_Class", "Same_Order"]
_PREFIXES = ["k__", "p__", "c__", "o__", "f__", "g__", "s__", "t__", "i__"]

# ---------------------------------------------------------------- parsing


@query("gtdb_parse", f"""with {C_SQL} select name, 'k__World' as l0, 'p__' || r_name as l1, 'c__' || n_name as l2, 'o__' || seg as l3,
  null::varchar as l4, null::varchar as l5, sp as l6, null::varchar as l7, null::varchar as l8 from c""")
def gtdb_parse(spark, d):
    return slots(customer_lineages(spark, d), "name")


_PCOF_CASES = {
    0: ("initcap_type || brand || '_' || w1", {4: "brand", 3: "initcap_type", 5: "w1"}),
    1: ("initcap_type || brand || '_' || w1 || '_' || w2", {4: "brand", 3: "initcap_type", 5: "w1", 6: "w2"}),
    2: ("initcap_type || brand || '_' || w1 || '_' || w2 || '_' || key", {4: "brand", 3: "initcap_type", 5: "w1", 6: "w2", 7: "key"}),
    3: ("initcap_type || brand || '_' || w1 || '_' || w2 || '_x_y_' || key", {4: "brand", 3: "initcap_type", 5: "w1", 6: "w2", 7: "'x_y'", 8: "key"}),
    4: ("initcap_type || '_' || w1", {5: "initcap_type", 6: "w1"}),
    5: ("initcap_type || '_' || brand", {4: "initcap_type", 5: "brand"}),
    6: ("initcap_type || '_' || initcap_type || '.' || w1", {5: "initcap_type", 6: "initcap_type || '.' || w1"}),
    7: ("initcap_type || ' ' || w1", {5: "initcap_type", 6: "w1"}),
    8: ("initcap_type || '.' || w1", {5: "initcap_type", 6: "w1"}),
    9: ("'AaBbCcDdEeFf_' || w1", {}),
}
_PCOF_COLUMNS = ["p_partkey", "p_partkey % 10 as form", "upper(left(p_type, 1)) || lower(substr(p_type, 2)) as initcap_type", "replace(p_brand, '#', '') as brand",
                 "split_part(p_name, ' ', 1) as w1", "split_part(p_name, ' ', 2) as w2", "cast(p_partkey as {text}) as key"]
_PCOF_TEXT = "case form " + " ".join(f"when {i} then {text}" for i, (text, _) in _PCOF_CASES.items()) + " end"


def _pcof_slot(r):
    arms = " ".join(f"when {i} then '{_PREFIXES[r]}' || {found[r]}" for i, (_, found) in _PCOF_CASES.items() if r in found)
    return f"case form {arms} end" if arms else "null::varchar"


@query("pcof_parse", f"with q as (select {', '.join(_PCOF_COLUMNS).format(text='varchar')} from part) select p_partkey, {_PCOF_TEXT} as text, "
       + ", ".join(f"{_pcof_slot(r)} as l{r}" for r in range(9)) + " from q")
def pcof_parse(spark, d):
    """File-name lineages in all ten written forms, cycling over the parts."""
    columns = [c.format(text="string") for c in _PCOF_COLUMNS]
    texts = table(spark, d, "part").selectExpr(*columns).selectExpr("p_partkey", f"{_PCOF_TEXT} as text")
    return slots(texts.withColumn("lineage", T.pcof_lineage("text")), "p_partkey", "text")


@query("rank_levels", f"""select o_orderkey, {_RANK_NAMES!r}[(o_orderkey % {len(_RANK_NAMES)})::int + 1] as rank,
  {_RANK_VALUES!r}[(o_orderkey % {len(_RANK_NAMES)})::int + 1]::double as level from orders""")
def rank_levels(spark, d):
    names = F.array(*[F.lit(n) for n in _RANK_NAMES])
    named = table(spark, d, "orders").select("o_orderkey", F.get(names, (F.col("o_orderkey") % len(_RANK_NAMES)).cast("int")).alias("rank"))
    return named.withColumn("level", T.rank_level("rank"))


@query("lineage_levels", f"""with {C_SQL} select name, case when sp is null then 3 else 6 end::int as deepest, case when sp is null then 2 else 3 end::int as above,
  case when sp is null then 'o__' || seg || ' (p__' || r_name || ')' else name end as readable, 'c__' || n_name as class from c""")
def lineage_levels(spark, d):
    return customer_lineages(spark, d).select(
        "name", T.deepest_rank("lineage").cast("int").alias("deepest"), T.parent_level("lineage").cast("int").alias("above"),
        T.readable_name("lineage").alias("readable"), T.rank_of("lineage", "class").alias("class"))


@query("readable_species", """with q as (select p_partkey, split_part(p_name, ' ', 1) as g, split_part(p_name, ' ', 2) as s, p_partkey::varchar as k from part)
select p_partkey, case p_partkey % 3 when 0 then g || ' ' || s when 1 then g || ' ' || s || ' ' || k else g || ' ' || s end as readable from q""")
def readable_species(spark, d):
    """Species repeating their genus and strains repeating their species lose the repetition."""
    words = F.split("p_name", " ")
    g, s = F.get(words, F.lit(0)), F.get(words, F.lit(1))
    species = F.concat(F.lit("s__"), g, F.lit(" "), s)
    form = F.col("p_partkey") % 3
    strain = F.when(form == 1, F.concat(F.lit("t__"), g, F.lit(" "), s, F.lit("_"), F.col("p_partkey")))
    plain = F.when(form == 2, F.concat(F.lit("s__"), s)).otherwise(species)
    none = F.lit(None).cast("string")
    lineage = F.array(*[none] * 5, F.concat(F.lit("g__"), g), plain, strain, none)
    return table(spark, d, "part").select("p_partkey", T.readable_name(lineage).alias("readable"))


# ---------------------------------------------------------------- relations


@query("relatedness_pairs", f"""with {S_SQL} select a.id as id_a, b.id as id_b,
  (case when a.r_name <> b.r_name then 0 when a.n_name <> b.n_name then 1 else 2 end)::int as relation from s a join s b on a.id < b.id""")
def relatedness_pairs(spark, d):
    return PairJob(supplier_lineages(spark, d)).pairs()


@query("relatedness_adjacent", f"""with {C_SQL}, p as (select a.ord, a.r_name = b.r_name as r, a.n_name = b.n_name as n, a.seg = b.seg as s
  from c a join c b on b.ord = a.ord + 1)
select ord, case when not r then 0 when not n then 1 when not s then 2 else 3 end::int as relation,
  {_LABELS!r}[case when not r then 0 when not n then 1 when not s then 2 else 3 end + 1] as label from p""")
def relatedness_adjacent(spark, d):
    rows = customer_lineages(spark, d)
    following = rows.select((F.col("ord") - 1).alias("ord"), F.col("lineage").alias("next"))
    found = rows.join(following, "ord").select("ord", T.relation("lineage", "next").alias("relation"))
    return found.withColumn("label", T.relation_label("relation"))


# ---------------------------------------------------------------- trees


@query("tree_from_lineages", f"""with {C_SQL}, e as (select ord, 'k__World' as name, 0.0::double as level, 'root' as parent from c
  union all select ord, 'p__' || r_name, 1.0, 'k__World' from c union all select ord, 'c__' || n_name, 2.0, 'p__' || r_name from c
  union all select ord, 'o__' || seg, 3.0, 'c__' || n_name from c union all select ord, sp, 6.0, 'o__' || seg from c where sp is not null)
select name, level, parent from e qualify row_number() over (partition by name order by ord, level, parent) = 1""")
def tree_from_lineages(spark, d):
    return T.tree_from_lineages(customer_lineages(spark, d))


@query("ancestor_walk", f"""with recursive {N_SQL}, walk as (select name as leaf, name, level, parent from nodes
  union all select leaf, n.name, n.level, n.parent from walk w join nodes n on n.name = w.parent where w.parent <> w.name)
select leaf as name, """ + ", ".join(f"max(name) filter (where level = {i}) as l{i}" for i in range(9)) + " from walk group by leaf")
def ancestor_walk(spark, d):
    return slots(T.ancestor_lineages(world_nodes(spark, d)), "name")


@query("add_leaves", f"""with {N_SQL} select * from nodes union all
  select 'item' || l_orderkey || '.' || l_linenumber || '.' || l_partkey || '.' || l_suppkey || '.' || floor(l_extendedprice)::bigint, 8.0, 'o' || l_orderkey from lineitem""")
def add_leaves(spark, d):
    name = F.concat(F.lit("item"), F.concat_ws(".", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.floor("l_extendedprice").cast("long")))
    leaves = table(spark, d, "lineitem").select(name.alias("name"), F.concat(F.lit("o"), "l_orderkey").alias("taxon"))
    return T.add_leaves(world_nodes(spark, d), leaves)


@query("node_labels", f"""with {N_SQL}, names as (select 'c' || c_custkey as id, c_name as name from customer where c_custkey % 2 = 0)
select nodes.*, names.name as label from nodes left join names on names.id = nodes.name""")
def node_labels(spark, d):
    cls = F.when(F.col("c_custkey") % 2 == 0, "scientific name").otherwise("synonym")
    names = table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.col("c_name").alias("name"), cls.alias("class"))
    return T.add_labels(world_nodes(spark, d), names)


@query("merge_taxa", f"""with {N_SQL},
al as (select 'c' || c_custkey as old, case c_custkey % 3 when 0 then 'n' || c_nationkey when 1 then c_name else 'once ' || c_name end as new from customer
  union all select 'x' || s_suppkey, case s_suppkey % 2 when 0 then 'n' || s_nationkey else s_name end from supplier),
m as (select al.*, o.level as ol, o.parent as op, o.name is not null as ok, n.level as nl, n.parent as np, n.name is not null as nk
  from al left join nodes o on o.name = old left join nodes n on n.name = new),
every as (select name, level, parent, null::varchar as alias_of from nodes where name not in (select old from al)
  union all select old, case when nk then nl when ok then ol else -1.0 end, case when nk then np when ok then op else 'root' end, new from m
  union all select distinct new, case when ok then ol else -1.0 end, case when ok then op else 'root' end, null from m where not nk)
select name, level, coalesce(al.new, parent) as parent, alias_of from every left join al on al.old = parent""")
def merge_taxa(spark, d):
    """Customers merge into their nation or are renamed; unknown names are redirected or created."""
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    known = c.select(
        F.concat(F.lit("c"), "c_custkey").alias("old"),
        F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("n"), "c_nationkey")).when(F.col("c_custkey") % 3 == 1, F.col("c_name"))
         .otherwise(F.concat(F.lit("once "), "c_name")).alias("new"))
    unknown = s.select(F.concat(F.lit("x"), "s_suppkey").alias("old"),
                       F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("n"), "s_nationkey")).otherwise(F.col("s_name")).alias("new"))
    return T.apply_aliases(world_nodes(spark, d), known.unionByName(unknown))


@query("resolve_taxon", f"""with {N_SQL}, lab as (select s_name as label, 'n' || s_nationkey as parent from supplier),
asked as (select c_custkey as k, case c_custkey % 3 when 0 then 'c' || c_custkey when 1 then 'Supplier#' || lpad((c_custkey // 3)::varchar, 9, '0') else 'nobody' end as name from customer)
select k, asked.name, coalesce(nodes.name, lab.parent) as taxon from asked left join nodes on nodes.name = asked.name left join lab on lab.label = asked.name""")
def resolve_taxon(spark, d):
    labels = table(spark, d, "supplier").select(
        F.concat(F.lit(T.LABEL_PREFIX), "s_name").alias("name"), F.lit(8.0).alias("level"), F.concat(F.lit("n"), "s_nationkey").alias("parent"))
    k = F.col("c_custkey")
    asked = table(spark, d, "customer").select(k.alias("k"), F.when(k % 3 == 0, F.concat(F.lit("c"), k)).when(
        k % 3 == 1, F.concat(F.lit("Supplier#"), F.lpad(F.floor(k / 3).cast("string"), 9, "0"))).otherwise("nobody").alias("name"))
    return T.resolve_taxon(asked, world_nodes(spark, d).unionByName(labels))


@query("assign_lineage", f"""with {C_SQL}, asked as (select o_orderkey, 'Customer#' || lpad((o_custkey * 2)::varchar, 9, '0') as name from orders)
select o_orderkey, asked.name, 'c__' || n_name as l2, c.sp as l6 from asked left join c on c.name = asked.name""")
def assign_lineage(spark, d):
    """Orders look up the lineage of a customer that may not exist."""
    named = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("Customer#"), F.lpad((F.col("o_custkey") * 2).cast("string"), 9, "0")).alias("name"))
    found = T.assign_lineage(named, customer_lineages(spark, d).select("name", "lineage"))
    return found.select("o_orderkey", "name", F.get("lineage", F.lit(2)).alias("l2"), F.get("lineage", F.lit(6)).alias("l6"))


@query("alias_rename", """select s_suppkey, coalesce(c_name, s_name) as name from supplier left join customer on c_custkey * 2 = s_suppkey""")
def alias_rename(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_name").alias("name"))
    c = table(spark, d, "customer")
    aliases = c.select(F.concat(F.lit("Supplier#"), F.lpad((F.col("c_custkey") * 2).cast("string"), 9, "0")).alias("old"), F.col("c_name").alias("new"))
    return T.apply_name_aliases(s, aliases)


# ---------------------------------------------------------------- filters, weights, names


@query("include_exclude", f"""with {C_SQL} select name from c
where (r_name = 'ASIA' or starts_with(name, 'Customer#00000001')) and not (seg = 'MACHINERY' or name = 'Customer#000000012')""")
def include_exclude(spark, d):
    kept = T.include_exclude(customer_lineages(spark, d), ["p__ASIA", "Customer#00000001"], ["o__MACHINERY", "Customer#000000012"])
    return kept.select("name")


_WEIGHTS = {"identity": "1.0 / n", "sqrt": "1.0 / sqrt(n)", "log": "case when n > 1 then 1.0 / ln(n) end",
            "no_single": "case when n > 1 then 1.0 / ln(n) else 0 end", "13": "case when n >= 13 then 1.0 / ln(n) else 0 end"}
for _approach, _formula in _WEIGHTS.items():
    @query(f"genome_weights_{_approach if _approach.isalpha() or '_' in _approach else 'at_least'}",
           f"with {C_SQL}, w as (select name, count(*) over (partition by n_name, seg) as n from c) select name, round({_formula}, 6)::double as weight from w")
    def _weights(spark, d, approach=_approach):
        weighted = T.genome_weights(customer_lineages(spark, d), "order", approach)
        return weighted.select("name", F.round("weight", 6).alias("weight"))


@query("path_names", r"""select page_id, regexp_extract(url, '([^/]*)$', 1) as base, regexp_extract(url, '^(.*)/[^/]*$', 1) as dir from pages""")
def path_names(spark, d):
    return table(spark, d, "pages").select("page_id", X.basename("url").alias("base"), X.dirname("url").alias("dir"))


@query("accession_names", """select p_partkey, case p_partkey % 3 when 0 then 'GCF_' || lpad(p_partkey::varchar, 9, '0') || '.1'
  when 1 then 'GCA_' || p_partkey || '.2' else 'genome_' || p_partkey || '.fna' end as name from part""")
def accession_names(spark, d):
    k = F.col("p_partkey")
    path = F.concat(F.lit("/data/in/"), F.when(k % 3 == 0, F.concat(F.lit("GCF_"), F.lpad(k.cast("string"), 9, "0"), F.lit(".1_ASM_genomic.fna"))).when(
        k % 3 == 1, F.concat(F.lit("GCA_"), k, F.lit(".2_x.fna"))).otherwise(F.concat(F.lit("genome_"), k, F.lit(".fna"))))
    return table(spark, d, "part").select("p_partkey", genome_name(path).alias("name"))


@query("text_positions", """select page_id, (strpos(url, '/') - 1)::int as slash,
  (length(regexp_extract(url, '^([^0-9]*)', 1)))::int as digit, (length(regexp_extract(url, '^([^A-Z]*)', 1)))::int as capital,
  (length(regexp_extract(url, '^([^ _.:-]*)', 1)))::int as separator, starts_with(url, 'https') as secure, ends_with(url, 'html') as html,
  array_to_string(string_split(url, '/'), '|') as joined from pages""")
def text_positions(spark, d):
    return table(spark, d, "pages").select(
        "page_id", X.find_char("url", "/").alias("slash"), X.next_digit("url").alias("digit"), X.next_upper("url").alias("capital"),
        X.next_word_separator("url").alias("separator"), F.startswith("url", F.lit("https")).alias("secure"), F.endswith("url", F.lit("html")).alias("html"),
        X.join_text(X.split_text("url", "/"), "|").alias("joined"))


@query("number_text", """select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, case when l_discount = 0 then '0' else printf('%.6f', l_discount) end as discount,
  printf('%.' || (6 - floor(log10(l_extendedprice / 7))::int) || 'f', l_extendedprice / 7) as price from lineitem""")
def number_text(spark, d):
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", X.number_text("l_discount").alias("discount"), X.number_text(F.col("l_extendedprice") / 7).alias("price"))
