"""Queries on ready-made vectors: embeddings, and per-supplier profiles counted from line items."""

from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from sigloom.functions import vectors as V
from sigloom.functions.text import away_from_half
from sigloom.operators import metric_join, profiles, reports
from sigloom.operators.pairs import PairJob
from sigloom.operators.signatures import presence_absence
from sigloom.operators.taxonomy import genome_weights, gtdb_lineage
from sigloom.plans.catalog import query, table

# ---------------------------------------------------------------- inputs


def embeddings(spark, d):
    return table(spark, d, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("label").alias("grp"), F.col("embedding").cast("array<double>").alias("sig"))


V_SQL = "v as (select vec_id as id, label as grp, embedding::double[] as sig from embeddings)"


def supplier_profiles(spark, d):
    """Line items of every supplier by quantity 1..50."""
    counts = table(spark, d, "lineitem").groupBy("l_suppkey", F.col("l_quantity").cast("int").alias("q")).agg(
        F.count("*").cast("double").alias("n"))
    held = counts.groupBy(F.col("l_suppkey").alias("id")).agg(F.map_from_entries(F.collect_list(F.struct("q", "n"))).alias("m"))
    return held.select("id", F.transform(F.sequence(F.lit(1), F.lit(50)), lambda q: F.coalesce(
        F.try_element_at("m", q), F.lit(0.0))).alias("sig"))


def supplier_lineages(spark, d):
    text = F.concat(F.lit("d__World;p__"), "r_name", F.lit(";c__"), "n_name", F.lit(";o__"), "s_name")
    return (table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
            .join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), gtdb_lineage(text).alias("lineage")))


def classified_profiles(spark, d):
    return supplier_profiles(spark, d).join(supplier_lineages(spark, d), "id")


P_SQL = """
cells as (select l_suppkey as id, cast(l_quantity as int) as q, count(*)::double as n from lineitem group by all),
ids as (select distinct id from cells), qs as (select unnest(range(1, 51)) as q),
p as (select ids.id, list(coalesce(n, 0.0) order by qs.q) as sig
      from ids cross join qs left join cells on cells.id = ids.id and cells.q = qs.q group by ids.id)"""
S_SQL = """
s as (select s_suppkey as id, s_name as name, r_name, n_name from supplier
      join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey)"""


def pair_sql(term, finish="{s}", source="v", base=V_SQL, extra="", where=""):
    """Pairs of ``source`` with the summed ``term`` of x[1], x[2]."""
    total = f"list_sum(list_transform(list_zip(a.sig, b.sig), lambda x: {term}))"
    value = finish.replace("{s}", total)
    return f"""with {base} {extra}
select id_a, id_b, round(dist, 6) as dist from (
  select a.id as id_a, b.id as id_b, {value} as dist from {source} a join {source} b on a.id < b.id) {where}"""


def rounded(df, *columns):
    """Columns to six decimals.  Away from a half the nearest millionth is what ``round`` finds through the decimal text of a value, at a fraction of its time."""
    for c in columns or ("dist",):
        exact = F.round(c, 6)
        if df.schema[c].dataType == DoubleType():
            exact = F.when(away_from_half(c), F.rint(F.col(c) * 1e6) / 1e6 + 0.0).otherwise(exact)
        df = df.withColumn(c, exact)
    return df


# ---------------------------------------------------------------- all pairs


@query("satman_pairs_ordered", pair_sql("least(abs(x[1]-x[2]), 0.1)", "{s} / (len(a.sig) * 0.1)", where="where dist between 0.6 and 0.8"))
def satman_pairs_ordered(spark, d):
    return rounded(reports.in_input_order(PairJob(embeddings(spark, d), "PaSiT", theta=0.1, low=0.6, high=0.8).pairs(laid_out=False)))


@query("satman_within", pair_sql("least(abs(x[1]-x[2]), 0.1)", "{s} / (len(a.sig) * 0.1)", where="where dist <= 0.65"))
def satman_within(spark, d):
    """Pairs of embeddings at most 0.65 apart, found through pivots."""
    return rounded(metric_join.within(embeddings(spark, d), "satman", 0.65, theta=0.1))


@query("manhattan_within", pair_sql("abs(x[1]-x[2])", source="p", base=P_SQL, where="where dist <= 160"))
def manhattan_within(spark, d):
    """Pairs of supplier profiles at most 160 line items apart."""
    return rounded(metric_join.within(supplier_profiles(spark, d), "manhattan", 160))


@query("euclid_within", pair_sql("(x[1]-x[2]) * (x[1]-x[2])", "sqrt({s})", where="where dist <= 1.1"))
def euclid_within(spark, d):
    """Pairs of embeddings within a true Euclidean distance."""
    return rounded(metric_join.within(embeddings(spark, d), "euclid", 1.1))


@query("satman_pairs_by_distance", pair_sql("least(abs(x[1]-x[2]), 0.02)", "{s} / (len(a.sig) * 0.02)"))
def satman_pairs_by_distance(spark, d):
    return rounded(reports.by_distance(PairJob(embeddings(spark, d), "satman", theta=0.02).pairs(laid_out=False)))


@query("manhattan_pairs", pair_sql("abs(x[1]-x[2])"))
def manhattan_pairs(spark, d):
    return rounded(PairJob(embeddings(spark, d), "AMD").pairs())


@query("manhattan_pairs_per_dim", pair_sql("abs(x[1]-x[2])", "{s} / len(a.sig)", "p", P_SQL))
def manhattan_pairs_per_dim(spark, d):
    return rounded(PairJob(supplier_profiles(spark, d), "manhattan", scale="dims").pairs())


@query("euclid_sq_pairs_by_dim", pair_sql("(x[1]-x[2])*(x[1]-x[2])", "{s} * len(a.sig) * len(a.sig)", "p", P_SQL))
def euclid_sq_pairs_by_dim(spark, d):
    return rounded(PairJob(supplier_profiles(spark, d), "euclid", scale="inverse_dims").pairs())


@query("manhattan_pairs_scaled", pair_sql("abs(x[1]-x[2])", "{s} * 2.0 / (list_avg(a.sig) + list_avg(b.sig))", "p", P_SQL))
def manhattan_pairs_scaled(spark, d):
    return rounded(PairJob(supplier_profiles(spark, d), "manhattan", scale="mean").pairs())


@query("euclid_sq_pairs", pair_sql("(x[1]-x[2])*(x[1]-x[2])"))
def euclid_sq_pairs(spark, d):
    return rounded(PairJob(embeddings(spark, d), "ED").pairs())


@query("hamming_pairs", pair_sql("(x[1]<>x[2])::int", "{s} / 50.0", "p", P_SQL))
def hamming_pairs(spark, d):
    return rounded(PairJob(supplier_profiles(spark, d), "hamming").pairs())


@query("element_hamming_pairs", pair_sql(
    "(x[1]<>x[2])::int",
    "2.0 * {s} / (len(list_filter(a.sig, lambda y: y <> 0)) + len(list_filter(b.sig, lambda y: y <> 0)))", "p", P_SQL))
def element_hamming_pairs(spark, d):
    return rounded(PairJob(supplier_profiles(spark, d), "element_hamming", scale="mean").pairs())


@query("sateucl_pairs", pair_sql("least((x[1]-x[2])*(x[1]-x[2]), 0.01)", "sqrt({s} / (len(a.sig) * 0.01))"))
def sateucl_pairs(spark, d):
    return rounded(PairJob(embeddings(spark, d), "sateucl", theta=0.1).pairs())


@query("svc_pairs", pair_sql("(abs(x[1]-x[2]) > 0.1)::int", "{s} / len(a.sig)"))
def svc_pairs(spark, d):
    return rounded(PairJob(embeddings(spark, d), "exceed", theta=0.1).pairs())


CORR_SQL = """
u as (select id, unnest(sig) as x, generate_subscripts(sig, 1) as pos from v),
c as (select id, pos, x - avg(x) over (partition by id) as x from u),
z as (select id, list(x order by pos) as sig from c group by id)"""
_R = "list_dot_product(a.sig, b.sig) / (sqrt(list_dot_product(a.sig, a.sig)) * sqrt(list_dot_product(b.sig, b.sig)))"


@query("pearson_distance_pairs", f"""with {V_SQL}, {CORR_SQL}
select a.id as id_a, b.id as id_b, round(1 - ({_R} + 1) / 2, 6) as dist from z a join z b on a.id < b.id""")
def pearson_distance_pairs(spark, d):
    return rounded(PairJob(embeddings(spark, d), "corr").pairs())


@query("pearson_pairs", f"""with {V_SQL}, {CORR_SQL}
select a.id as id_a, b.id as id_b, round({_R}, 6) as dist from z a join z b on a.id < b.id""")
def pearson_pairs(spark, d):
    return rounded(PairJob(embeddings(spark, d), "pearson", common_format=True).pairs())


@query("spearman_pairs", f"""with v0 as (select vec_id as id, embedding::double[] as sig from embeddings),
u0 as (select id, unnest(sig) as x, generate_subscripts(sig, 1) as pos from v0),
u as (select id, pos, (row_number() over (partition by id order by x, pos))::double as x from u0),
c as (select id, pos, x - avg(x) over (partition by id) as x from u),
z as (select id, list(x order by pos) as sig from c group by id)
select a.id as id_a, b.id as id_b, round(1 - ({_R} + 1) / 2, 6) as dist from z a join z b on a.id < b.id""")
def spearman_pairs(spark, d):
    return rounded(PairJob(embeddings(spark, d), "rankcorr").pairs())


@query("pairs_with_self", pair_sql("abs(x[1]-x[2])", source="p", base=P_SQL).replace("a.id < b.id", "a.id <= b.id"))
def pairs_with_self(spark, d):
    return rounded(PairJob(supplier_profiles(spark, d), "manhattan", include_self=True).pairs())


# ---------------------------------------------------------------- per-row and aggregate read-outs


@query("nearest_neighbour", f"""with {V_SQL},
pr as (select a.id, b.id as nearest_id, list_sum(list_transform(list_zip(a.sig, b.sig), lambda x: abs(x[1]-x[2]))) as dist
       from v a join v b on a.id <> b.id)
select id, nearest_id, round(dist, 6) as dist from pr qualify row_number() over (partition by id order by dist, nearest_id) = 1""")
def nearest_neighbour(spark, d):
    return rounded(PairJob(embeddings(spark, d), "manhattan").nearest())


@query("medoid_per_label", f"""with {V_SQL},
pr as (select a.grp, a.id, list_sum(list_transform(list_zip(a.sig, b.sig), lambda x: abs(x[1]-x[2]))) as dist
       from v a join v b on a.grp = b.grp),
t as (select grp, id, sum(dist) as dist_sum from pr group by all)
select grp, id, round(dist_sum, 6) as dist_sum from t qualify row_number() over (partition by grp order by dist_sum, id desc) = 1""")
def medoid_per_label(spark, d):
    return rounded(profiles.medoids(embeddings(spark, d), "grp"), "dist_sum")


PROFILE_PAIRS = f"""with {P_SQL}, {S_SQL}, w as (select id, 1.0::double / count(*) over (partition by n_name) as weight from s),
pr as (select a.id as id_a, b.id as id_b,
  list_sum(list_transform(list_zip(a.sig, b.sig), lambda x: least(abs(x[1]-x[2]), 8.0))) / (50 * 8.0) as dist,
  case when sa.r_name <> sb.r_name then 0 when sa.n_name <> sb.n_name then 1 else 2 end as relation,
  wa.weight * wb.weight as weight
  from p a join p b on a.id < b.id join s sa on sa.id = a.id join s sb on sb.id = b.id
  join w wa on wa.id = a.id join w wb on wb.id = b.id)"""


@query("distance_histogram", PROFILE_PAIRS + """
select cast(floor(dist / 0.01) as bigint) as bin, cast(relation as int) as relation, count(*)::double as weight from pr group by all""")
def distance_histogram(spark, d):
    return PairJob(classified_profiles(spark, d), "PaSiT", theta=8.0).histogram(0.01)


@query("weighted_histogram", PROFILE_PAIRS + """
select cast(floor(dist / 0.01) as bigint) as bin, cast(relation as int) as relation, round(sum(weight), 6)::double as weight from pr group by all""")
def weighted_histogram(spark, d):
    weighted = genome_weights(classified_profiles(spark, d), "class", "identity")
    return rounded(PairJob(weighted, "PaSiT", theta=8.0).histogram(0.01, weighted=True), "weight")


@query("histogram_table", PROFILE_PAIRS + """,
h as (select cast(floor(dist / 0.01) as bigint) as bin, relation from pr),
b as (select unnest(range((select max(bin) from h) + 1)) as bin)
select b.bin, round(0.01::double * (b.bin + 0.5), 6) as centre,
  (count(*) filter (where relation = 0))::double as different_phyla, (count(*) filter (where relation = 1))::double as same_phylum,
  (count(*) filter (where relation = 2))::double as same_class
from b left join h on h.bin = b.bin group by b.bin""")
def histogram_table(spark, d):
    wide = reports.histogram_table(PairJob(classified_profiles(spark, d), "PaSiT", theta=8.0).histogram(0.01), 0.01)
    return rounded(wide.select("bin", "centre", *[F.col(c).alias(c.lower()) for c in ("Different_Phyla", "Same_Phylum", "Same_Class")]), "centre")


@query("relation_filter", PROFILE_PAIRS + " select id_a, id_b, cast(relation as int) as relation, round(dist, 6) as dist from pr where relation = 2")
def relation_filter(spark, d):
    return rounded(PairJob(classified_profiles(spark, d), "PaSiT", theta=8.0, only=2).pairs())


@query("pair_list_printed", PROFILE_PAIRS + """ select id_a::varchar as File1, id_b::varchar as File2,
  ['Different_Phyla', 'Same_Phylum', 'Same_Class'][relation + 1] as Expected_Relation, printf('%.6f', dist) as Distance from pr""")
def pair_list_printed(spark, d):
    return reports.pair_list(PairJob(classified_profiles(spark, d), "PaSiT", theta=8.0).pairs())


@query("distance_matrix_cells", pair_sql("abs(x[1]-x[2])", source="p", base=P_SQL).replace("a.id < b.id", "true").replace(
    "id_a", "row").replace("id_b", "col").replace("as dist from (", "as value from ("))
def distance_matrix_cells(spark, d):
    return rounded(reports.matrix_cells(PairJob(supplier_profiles(spark, d), "manhattan", include_self=True).pairs()), "value")


@query("distance_matrix_lines", f"""with {P_SQL}, {S_SQL}, o as (select id, name, row_number() over (order by id) - 1 as ord from s),
c as (select a.id as row, b.id as col, list_sum(list_transform(list_zip(a.sig, b.sig), lambda x: abs(x[1]-x[2]))) as value
  from p a cross join p b)
select oa.ord, oa.name || ',' || string_agg(printf('%.6f', value), ',' order by ob.ord) as line
from c join o oa on oa.id = c.row join o ob on ob.id = c.col group by oa.ord, oa.name""")
def distance_matrix_lines(spark, d):
    pairs = PairJob(supplier_profiles(spark, d), "manhattan", include_self=True).pairs()
    labels = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_suppkey").alias("ord"), F.col("s_name").alias("name"))
    return reports.matrix_lines(pairs, labels)


# ---------------------------------------------------------------- group statistics


_U = "u as (select id, grp, unnest(sig) as x, generate_subscripts(sig, 1) - 1 as pos from v)"
_STATS = f"""with {V_SQL}, {_U},
st as (select grp, pos, avg(x) as mean, avg(x*x) - avg(x)*avg(x) as var from u group by all)"""


def _long(df, *columns):
    """One row per element, which compares as plain numbers."""
    zipped = F.arrays_zip(*columns)
    others = [c for c in df.columns if c not in columns]
    return df.select(*others, F.posexplode_outer(zipped).alias("pos", "_z")).where("pos is not null").select(
        *others, F.col("pos").cast("long").alias("pos"), *[F.round(F.col(f"_z.{c}"), 6).alias(c) for c in columns])


@query("average_signature", _STATS + " select grp, pos::bigint as pos, round(mean, 6) as sig from st")
def average_signature(spark, d):
    return _long(profiles.average_signature(embeddings(spark, d), ["grp"]), "sig")


@query("variance_signature", _STATS + " select grp, pos::bigint as pos, round(var, 6) as sig from st")
def variance_signature(spark, d):
    return _long(profiles.variance_signature(embeddings(spark, d), ["grp"]), "sig")


@query("normal_parameters", _STATS + " select grp, pos::bigint as pos, round(mean, 6) as mean, round(sqrt(var), 6) as sd from st")
def normal_parameters(spark, d):
    return _long(profiles.normal_parameters(embeddings(spark, d), ["grp"]), "mean", "sd")


@query("weighted_average_signature", f"""with {V_SQL}, {_U}
select grp, pos::bigint as pos, round(sum(x * (1 + id % 3)) / sum(1 + id % 3), 6) as sig from u group by all""")
def weighted_average_signature(spark, d):
    weighted = embeddings(spark, d).withColumn("w", (1 + F.col("id") % 3).cast("double"))
    return _long(profiles.average_signature(weighted, ["grp"], "w"), "sig")


@query("average_z_score", _STATS + """
select id, round(avg(abs(x - mean) / sqrt(var)), 6) as z from u join st using (grp, pos) group by id""")
def average_z_score(spark, d):
    vectors = embeddings(spark, d)
    joined = vectors.join(profiles.normal_parameters(vectors, ["grp"]), "grp")
    return joined.select("id", F.round(V.average_z("sig", "mean", "sd"), 6).alias("z"))


@query("centroid_distances", _STATS + """
select id, round(sum(abs(x - mean)), 6) as manhattan, round(sqrt(sum((x - mean)*(x - mean))), 6) as euclid,
  round(sum(least(abs(x - mean), 0.1)) / (count(*) * 0.1), 6) as satman,
  round(sqrt(sum(least((x - mean)*(x - mean), 0.01)) / (count(*) * 0.01)), 6) as sateucl,
  round(avg((abs(x - mean) > 0.1)::int), 6) as exceed, round(corr(x, mean), 6) as pearson, round(covar_pop(x, mean), 6) as covariance
from u join st using (grp, pos) group by id""")
def centroid_distances(spark, d):
    vectors = embeddings(spark, d)
    joined = vectors.join(profiles.average_signature(vectors, ["grp"]).withColumnRenamed("sig", "centre"), "grp")
    a, b = "sig", "centre"
    found = {"manhattan": V.manhattan(a, b), "euclid": V.euclid(a, b), "satman": V.saturated_manhattan(a, b, 0.1),
             "sateucl": V.saturated_euclid(a, b, 0.1), "exceed": V.exceed_share(a, b, 0.1), "pearson": V.pearson(a, b),
             "covariance": V.covariance(a, b)}
    return joined.select("id", *[F.round(e, 6).alias(n) for n, e in found.items()])


@query("presence_absence", f"""with {P_SQL}, u as (select id, unnest(sig) as x, generate_subscripts(sig, 1) - 1 as pos from p)
select id, pos::bigint as pos, (x <> 0)::int::double as sig from u""")
def presence(spark, d):
    return _long(presence_absence(supplier_profiles(spark, d)), "sig")


@query("vector_reductions", f"""with {V_SQL}
select id, round(list_sum(sig), 6) as total, round(list_avg(sig), 6) as average, round(sqrt(list_dot_product(sig, sig)), 6) as norm,
  round(list_min(sig), 6) as smallest, round(list_max(sig), 6) as largest, (list_position(sig, list_min(sig)) - 1)::int as at_smallest,
  (list_position(sig, list_max(sig)) - 1)::int as at_largest, round(list_sort(sig)[len(sig) // 2 + 1], 6) as median,
  round(list_sort(sig)[least(floor(len(sig) * 0.9), len(sig) - 1)::int + 1], 6) as q90,
  round(list_avg(list_transform(sig, lambda x: x*x)) - list_avg(sig)*list_avg(sig), 6) as variance
from v""")
def vector_reductions(spark, d):
    s = "sig"
    found = {"total": V.array_sum(s), "average": V.average(s), "norm": V.norm(s), "smallest": V.minimum(s), "largest": V.maximum(s),
             "median": V.median(s), "q90": V.quantile(s, 0.9), "variance": V.variance(s)}
    return embeddings(spark, d).select("id", *[F.round(e, 6).alias(n) for n, e in found.items()],
                                       V.argmin(s).alias("at_smallest"), V.argmax(s).alias("at_largest"))


@query("vector_arithmetic", f"""with {V_SQL}, u as (select id, unnest(sig) as x, unnest(list_reverse(sig)) as y, generate_subscripts(sig, 1) as pos from v)
select id, round(sum(pos * (x + y)), 6) as added, round(sum(pos * (x - y)), 6) as subtracted, round(sum(pos * x * y), 6) as multiplied,
  round(sum(pos * 2.5 * x), 6) as scaled, round(sum(pos * -x), 6) as negated, round(sum(abs(x) * pos), 6) as absolute,
  round(sum(pos * 1.0 / (abs(x) + 1)), 6) as inverted from u group by id""")
def vector_arithmetic(spark, d):
    reverse = F.reverse("sig")
    at = F.sequence(F.lit(1.0).cast("int"), F.size("sig")).cast("array<double>")
    found = {"added": V.add("sig", reverse), "subtracted": V.subtract("sig", reverse), "multiplied": V.multiply("sig", reverse),
             "scaled": V.scale("sig", 2.5), "negated": V.negate("sig"), "absolute": V.absolute("sig"),
             "inverted": V.inverse(F.transform(V.absolute("sig"), lambda x: x + 1))}
    return embeddings(spark, d).select("id", *[F.round(V.array_sum(V.multiply(at, e)), 6).alias(n) for n, e in found.items()])


@query("vector_ranks", f"""with {V_SQL}, {_U}
select id, pos::bigint as pos, (row_number() over (partition by id order by x, pos) - 1)::double as sig from u""")
def vector_ranks(spark, d):
    return _long(embeddings(spark, d).select("id", V.ordinal_ranks("sig").alias("sig")), "sig")


@query("element_conversion", f"""with {P_SQL}, u as (select id, unnest(sig) as x, generate_subscripts(sig, 1) - 1 as pos from p)
select id, pos::bigint as pos, cast(x as bigint) as sig from u""")
def element_conversion(spark, d):
    return _long(supplier_profiles(spark, d).select("id", V.convert("sig", "bigint").alias("sig")), "sig")


@query("sorted_permutation", f"""with {V_SQL}, {_U}
select id, (row_number() over (partition by id order by x desc, pos) - 1)::bigint as pos, round(x, 6) as sig from u""")
def sorted_permutation(spark, d):
    """Elements reordered from largest to smallest through an index permutation."""
    keyed = F.transform("sig", lambda x, i: F.struct((-x).alias("k"), i.alias("i")))
    order = F.transform(F.sort_array(keyed), lambda s: s["i"])
    return _long(embeddings(spark, d).select("id", V.permute("sig", order).alias("sig")), "sig")
