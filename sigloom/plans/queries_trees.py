"""Queries on clustering, marks, alignment and gene search."""

from pyspark.sql import functions as F

from sigloom.functions import alignment, sequences as Q
from sigloom.functions.stats import f_distribution_cdf
from sigloom.operators import cluster, consensus, genes, marks, matches, signatures as S
from sigloom.operators.pairs import PairJob
from sigloom.plans.catalog import query, table
from sigloom.plans.queries_sequences import CONV, NUDGE, conversation_contigs, counts_sql, full_sql
from sigloom.plans.queries_vectors import P_SQL, supplier_profiles
from sigloom.session import cut_lineage

# ---------------------------------------------------------------- clustering


def _supplier_pairs(spark, d):
    return PairJob(supplier_profiles(spark, d), "manhattan").forest()


def _suppliers(spark, d):
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))


_PRIM = f"""with recursive {P_SQL},
pr as materialized (select a.id as a, b.id as b, list_sum(list_transform(list_zip(a.sig, b.sig), lambda x: abs(x[1]-x[2]))) as dist from p a join p b on a.id < b.id),
grow as (select [(select min(id) from p)] as seen, null::bigint as a, null::bigint as b, null::double as dist
  union all
  select list_append(seen, case when list_contains(seen, a) then b else a end), a, b, dist from (
    select g.seen, e.a, e.b, e.dist from grow g join pr e on list_contains(g.seen, e.a) <> list_contains(g.seen, e.b) order by e.dist, e.a, e.b limit 1)),
tree as materialized (select a, b, dist, row_number() over (order by dist, a, b) - 1 as rank from grow where a is not null),
size as materialized (select max(id) + 1 as n from p)"""
_MERGE = f"""{_PRIM},
st as (select 0 as step, list(i order by i) as lab, null::bigint as l, null::bigint as r, null::double as h, null::bigint as c from (select unnest(range(n)) as i from size)
  union all
  select step + 1, list_transform(lab, lambda x: case when x = la or x = lb then n + step else x end),
    case when list_position(lab, la) < list_position(lab, lb) then la else lb end, case when list_position(lab, la) < list_position(lab, lb) then lb else la end,
    dist, len(list_filter(lab, lambda x: x = la or x = lb))
  from (select st.step, st.lab, n, t.dist, st.lab[t.a + 1] as la, st.lab[t.b + 1] as lb from st join tree t on t.rank = st.step cross join size))"""


@query("spanning_tree", _PRIM + " select a as id_a, b as id_b, dist from tree")
def spanning_tree(spark, d):
    return cluster.minimum_spanning_tree(_supplier_pairs(spark, d))


@query("single_linkage", _MERGE + ' select (step - 1)::bigint as step, l as "left", r as "right", h as height, c as size from st where step > 0')
def single_linkage(spark, d):
    return cluster.single_linkage(_supplier_pairs(spark, d), _suppliers(spark, d))


@query("single_linkage_cut", _MERGE + """, cutoff as (select median(h) as m from st where step > 0),
fin as (select lab from st where step = (select count(*) from st s2, cutoff where s2.step > 0 and s2.h <= m))
select (generate_subscripts(lab, 1) - 1)::bigint as id, unnest(lab) as cluster from fin""")
def single_linkage_cut(spark, d):
    """Clusters below the median merge height."""
    leaves = _suppliers(spark, d)
    merges = cluster.single_linkage(_supplier_pairs(spark, d), leaves)
    middle = merges.agg(F.median("height")).first()[0]
    return cluster.cut_tree(merges, leaves, leaves.count(), middle)


@query("single_linkage_text", _MERGE + """, m as (select n + step - 1 as node, l, r, h, c from st, size where step > 0),
down(node, up, first, depth) as (select max(node), null::bigint, 0::bigint, 0::bigint from m
  union all
  select case when side = 0 then m.l else m.r end, m.node, first + case when side = 0 then 0 else coalesce(lc.c, 1) end, depth + 1
  from down join m using (node) left join m lc on lc.node = m.l cross join (values (0), (1)) s(side)),
t as (select down.*, coalesce(m.c, 1) as span, m.h, m.r, coalesce(printf(':%.6f', pm.h / 2), ';') as len from down left join m using (node) left join m pm on pm.node = down.up)
select first as pos, 0 as phase, depth::double as key, '(' as token from t where h is not null
union all select first + span - 1, 2, -depth::double, ')C' || node || '-' || printf('%.6f', h) || len from t where h is not null
union all select first, 1, 0.0::double, s_name || len from t join supplier on s_suppkey = node where h is null
union all select x.first, 0, t.depth + 0.5::double, ',' from t join t x on x.node = t.r where t.h is not null""")
def single_linkage_text(spark, d):
    leaves = _suppliers(spark, d)
    return cluster.newick_tokens(cluster.single_linkage(_supplier_pairs(spark, d), leaves), leaves, leaves.count())


@query("clustered_order", _PRIM + """,
st as (select 0 as step, list(i order by i) as slot, list([i] order by i) as ords from (select unnest(range(n)) as i from size)
  union all
  select step + 1, list_transform(slot, lambda x: case when x = greatest(sa, sb) then least(sa, sb) else x end),
    [case when k = least(sa, sb) then list_concat(ords[least(sa, sb) + 1], ords[greatest(sa, sb) + 1]) else ords[k + 1] end for k in range(n)]
  from (select st.*, n, st.slot[t.a + 1] as sa, st.slot[t.b + 1] as sb from st join tree t on t.rank = st.step cross join size)),
fin as (select ords[1] as o from st, size where step = n - 1)
select unnest(o) as id, (generate_subscripts(o, 1) - 1)::bigint as pos from fin""")
def clustered_order(spark, d):
    leaves = _suppliers(spark, d)
    return cluster.leaf_order(cluster.single_linkage(_supplier_pairs(spark, d), leaves), leaves, leaves.count())


@query("cluster_count", _MERGE + """, hs as (select h as v from st where step > 0 union all select max(h) + 1 from st),
v as (select v, row_number() over (order by v) - 1 as i, count(*) over () as n, max(v) over () as top from hs),
e as (select b.i, b.v, b.n, sum(case when a.i < b.i then pow(a.v - b.v / b.i * a.i, 2) else pow(a.v - (b.v + (b.top - b.v) / (b.n - b.i) * (a.i - b.i)), 2) end) as mse
  from v b join v a on true where b.i > 0 group by b.i, b.v, b.n)
select (n - i)::bigint as clusters, v from e order by round(mse, 9), i limit 1""")
def cluster_count(spark, d):
    return cluster.single_linkage_clusters(cluster.single_linkage(_supplier_pairs(spark, d), _suppliers(spark, d)))


def _conversation_job(spark, d):
    return PairJob(S.frequency_signature(conversation_contigs(spark, d), 3), "manhattan")


def _conversations(spark, d):
    return table(spark, d, "conversations").select(F.col("conv_id").alias("id")).distinct()


_WARD = f"""with recursive {counts_sql(3)}, {full_sql(3)},
f as materialized (select genome_id as id, list(f order by kmer) as sig from (select genome_id, kmer, n / sum(n) over (partition by genome_id) as f from c_f) group by 1),
size as materialized (select count(*)::int as n from f),
base as materialized (select list(d order by i, j) as m from (select a.id as i, b.id as j, case when a.id = b.id then 'inf'::double else
    pow(list_sum(list_transform(list_zip(a.sig, b.sig), lambda x: abs(x[1]-x[2]))), 2) end as d from f a cross join f b)),
st as (select 0 as step, m, list_transform(range(n), lambda x: 1.0::double) as w, range(n)::bigint[] as lab,
    null::bigint as l, null::bigint as r, null::double as h, null::bigint as c from base, size
  union all
  select step + 1,
    [case when k // n = j or k % n = j or k // n = k % n then 'inf'::double
          when k % n = i then case when isinf(m[i*n + k//n + 1]) then 'inf'::double else
            ((w[i+1] + w[k//n+1]) * m[i*n + k//n + 1] + (w[j+1] + w[k//n+1]) * m[j*n + k//n + 1] - w[k//n+1] * hh) / (w[i+1] + w[j+1] + w[k//n+1]) end
          when k // n = i then case when isinf(m[i*n + k%n + 1]) then 'inf'::double else
            ((w[i+1] + w[k%n+1]) * m[i*n + k%n + 1] + (w[j+1] + w[k%n+1]) * m[j*n + k%n + 1] - w[k%n+1] * hh) / (w[i+1] + w[j+1] + w[k%n+1]) end
          else m[k + 1] end for k in range(n * n)],
    [case when k = i then w[i+1] + w[j+1] else w[k+1] end for k in range(n)], [case when k = i then n + step else lab[k+1] end for k in range(n)],
    lab[i+1], lab[j+1], hh, (w[i+1] + w[j+1])::bigint
  from (select *, p // n as i, p % n as j from (select st.*, n, list_min(m) as hh, list_position(m, list_min(m)) - 1 as p from st, size where step < n - 1)))
"""


@query("ward_linkage", _WARD + ' select (step - 1)::bigint as step, l as "left", r as "right", round(h, 6) as height, c as size from st where step > 0')
def ward_linkage(spark, d):
    merges = cluster.ward_linkage(_conversation_job(spark, d), _conversations(spark, d))
    return merges.withColumn("height", F.round("height", 6))


@query("ward_branches", _WARD + """, mm as (select step - 1 as step, unnest([l, r]) as child, h, c from st where step > 0),
cs as (select n + step - 1 as child, c as cc from st, size where step > 0)
select mm.step::bigint as step, child, round(sqrt(h) * coalesce(cc, 1) / c, 6) as branch from mm left join cs using (child)""")
def ward_branches(spark, d):
    leaves = _conversations(spark, d)
    branches = cluster.ward_branches(cluster.ward_linkage(_conversation_job(spark, d), leaves), leaves.count())
    return branches.withColumn("branch", F.round("branch", 6))


_WARD_F = _WARD + """, fs as (select step - 1 as step, n - step as clusters, sum(h * c) over (order by step) as within, coalesce(list_sum(list_filter(m, lambda x: not isinf(x))) / 2, 0) as between
  from st, size where step > 0),
f_at as (select *, case when between > 0 then within / between end as f from fs)"""


def _ward_f(spark, d):
    job, leaves = _conversation_job(spark, d), _conversations(spark, d)
    merges = cluster.ward_linkage(job, leaves)
    return cluster.ward_f_statistic(job.pairs(), leaves, merges), leaves


@query("ward_f_statistic", _WARD_F + """ select step::bigint as step, clusters::bigint as clusters, round(within, 6) as within, round(between, 6) as between, round(f, 6) as f from f_at""")
def ward_f_statistic(spark, d):
    """Distances within merged clusters against those between living ones, after every merge."""
    return _ward_f(spark, d)[0].select("step", "clusters", *[F.round(c, 6).alias(c) for c in ("within", "between", "f")])


@query("ward_cluster_count", _WARD_F + " select coalesce(min(case when f < 0.5 then clusters end), (select n from size))::bigint as clusters from f_at")
def ward_cluster_count(spark, d):
    """Clusters after the last merge with a ratio below one half."""
    return cluster.ward_cluster_count(*_ward_f(spark, d), 0.5)


@query("value_breakpoint", """with v as (select c_acctbal as v, row_number() over (order by c_acctbal) - 1 as i, count(*) over () as n, max(c_acctbal) over () as top from customer),
e as (select b.i, b.v, sum(case when a.i < b.i then pow(a.v - b.v / b.i * a.i, 2) else pow(a.v - (b.v + (b.top - b.v) / (b.n - b.i) * (a.i - b.i)), 2) end) as mse
  from v b join v a on true where b.i > 0 group by b.i, b.v)
select i as rank, v, round(mse / 1e6, 3) as mse from e order by e.mse, i limit 1""")
def value_breakpoint(spark, d):
    found = cluster.best_breakpoint(table(spark, d, "customer"), "c_acctbal")
    return found.withColumn("mse", F.round(F.col("mse") / 1e6, 3))


# ---------------------------------------------------------------- marks

_MARK = "event_type in ('click', 'view')"


def event_marks(spark, d):
    """The events of all users as one long marked sequence."""
    return table(spark, d, "events").select(
        F.lit(0).alias("seq_id"), F.col("event_id").alias("pos"), F.col("event_type").isin("click", "view").alias("mark"), "value")


_M = f"m as (select 0 as seq_id, event_id as pos, {_MARK} as mark, value from events)"
_CHUNK = 256  # short chunks, so that small tables cross chunk borders too


@query("mark_runs", f"""with {_M}, g as (select *, pos - row_number() over (partition by seq_id, mark order by pos) as g from m)
select seq_id, mark, min(pos) as begin, count(*) as length from g group by seq_id, mark, g""")
def mark_runs(spark, d):
    return marks.runs(event_marks(spark, d), ["seq_id"], "pos", "mark", _CHUNK)


@query("marked_intervals", f"""with {_M}, g as (select *, pos - row_number() over (partition by seq_id, mark order by pos) as g from m),
r as (select seq_id, mark, min(pos) as begin, count(*) as length, max(pos) as stop from g group by seq_id, mark, g),
e as (select seq_id, min(pos) filter (where mark) as lo, max(pos) filter (where mark) as hi from m group by 1)
select r.seq_id, begin, length from r join e using (seq_id) where not mark and begin > lo and stop < hi""")
def marked_intervals(spark, d):
    return marks.split_marked(event_marks(spark, d), ["seq_id"], "pos", "mark", "intervals", _CHUNK)


def _near(fold, flag):
    return f"""with {_M} select seq_id, pos, {fold}(mark::int) over (partition by seq_id order by pos range between 2 preceding and 2 following) = 1 as mark from m"""


@query("dilate_marks", _near("max", 1))
def dilate_marks(spark, d):
    return marks.dilate(event_marks(spark, d), ["seq_id"], "pos", "mark", 2, _CHUNK).drop("value")


@query("erode_marks", _near("min", 0))
def erode_marks(spark, d):
    return marks.erode(event_marks(spark, d), ["seq_id"], "pos", "mark", 2, _CHUNK).drop("value")


@query("bridge_gaps", f"""with {_M}, b as (select *, max(case when mark then pos end) over (partition by seq_id order by pos rows between unbounded preceding and current row) as before,
  min(case when mark then pos end) over (partition by seq_id order by pos rows between current row and unbounded following) as after from m)
select seq_id, pos, mark or coalesce(after - before - 1 <= 2, false) as mark from b""")
def bridge_gaps(spark, d):
    return marks.bridge_gaps(event_marks(spark, d), ["seq_id"], "pos", "mark", 2, _CHUNK).drop("value")


@query("high_deltas", f"""with {_M}, b as (select *, lag(value) over (partition by seq_id order by pos) as before from m)
select seq_id, pos, value from b where case when value > before then value - before > 20 + 5 else before - value > 20 - 5 end""")
def high_deltas(spark, d):
    return marks.high_deltas(event_marks(spark, d), ["seq_id"], "pos", "value", 20.0, 5.0, _CHUNK).drop("mark")


# ---------------------------------------------------------------- alignment and genes


# Costs, identities and lengths are one number, as in any order of importance: cost * 2^40 - identities * 2^20 + length.
_EDIT = f"""with recursive {CONV}, p as (select a.genome_id, a.ord, a.seq as q, b.seq as t from t a join t b on a.genome_id = b.genome_id and b.ord = a.ord + 1),
unit as (select 1099511627776::bigint as c, 1048576::bigint as b, 2305843009213693952::bigint as far),
dp(genome_id, ord, q, t, i, line, above) as (
  select genome_id, ord, q, t, 0, list_transform(range(length(t) + 1), lambda j: j * (c + 1)), list_transform(range(length(t) + 1), lambda j: far) from p, unit
  union all
  select genome_id, ord, q, t, i + 1, list_transform(list_zip(fresh, list_slice(reach, 1, len(fresh)), range(length(t) + 1)), lambda x: case when x[3] = 0 then x[1] else least(x[1], x[2] + x[3] * (c + 1) + 2 * c) end), v
  from (select *, list_reduce(list_prepend([far], list_transform(list_zip(fresh, range(length(t) + 1)), lambda x: [x[1] - x[2] * (c + 1)])),
      lambda acc, x: list_append(acc, least(acc[len(acc)], x[1]))) as reach
    from (select *, list_transform(range(length(t) + 1), lambda j: case when j = 0 then (i + 1) * (c + 1) else
        least(line[j] + case when substr(t, j, 1) = substr(q, i + 1, 1) then 1 - b else 2 * c + 1 end, v[j + 1]) end) as fresh
      from (select dp.*, c, b, far, list_transform(list_zip(line, above), lambda x: least(x[1] + 3 * c + 1, x[2] + c + 1)) as v from dp, unit where i < length(q)))))
select genome_id, ord, cost, identities, value - cost * c + identities * b as length from (
  select *, ((cost * c - value + b - 1) // b)::bigint as identities from (
    select genome_id, ord, c, b, line[len(line)] as value, ((line[len(line)] + c // 2) // c)::bigint as cost from dp, unit where i = length(q)))"""


@query("edit_identity", _EDIT)
def edit_identity(spark, d):
    """Alignment of every turn with the next one of its conversation."""
    turns = conversation_contigs(spark, d)
    following = turns.select("genome_id", (F.col("ord") - 1).alias("ord"), F.col("seq").alias("next"))
    found = turns.join(following, ["genome_id", "ord"]).withColumn("a", alignment.edit_identity(F.col("seq"), F.col("next")))
    return found.select("genome_id", "ord", "a.cost", "a.identities", "a.length")


@query("gapless_alignment", f"""with {CONV}, p as (select a.genome_id, a.ord, a.seq as x, b.seq as y from t a join t b on a.genome_id = b.genome_id and b.ord = a.ord + 1),
o as (select *, unnest(range(1 - length(y), length(x))) as off from p where length(x) > 0 and length(y) > 0),
m as (select genome_id, ord, off, list_sum([(substr(x, i, 1) = substr(y, i - off, 1))::int for i in range(greatest(1, off + 1), least(length(x), length(y) + off) + 1)]) as n from o)
select p.genome_id, p.ord, coalesce(off, 0)::bigint as "offset", coalesce(n, 0)::bigint as matches from p left join
  (select * from m qualify row_number() over (partition by genome_id, ord order by n desc, off) = 1) b using (genome_id, ord)""")
def gapless_alignment(spark, d):
    turns = conversation_contigs(spark, d)
    following = turns.select("genome_id", (F.col("ord") - 1).alias("ord"), F.col("seq").alias("next"))
    found = turns.join(following, ["genome_id", "ord"]).withColumn("a", alignment.gapless_alignment(F.col("seq"), F.col("next")))
    return found.select("genome_id", "ord", "a.offset", "a.matches")


@query("shared_regions", f"""with {CONV}, g as (select upper(regexp_replace(text, '[^ACGTacgt]', '', 'g')) as gene from benchmark),
w as (select distinct unnest([substr(gene, i, 10) for i in range(1, length(gene) - 8)]) as s from g),
cs as (select genome_id, ord, unnest(range(0, length(seq) - 9)) as pos, seq from t),
st as (select genome_id, ord, pos from cs where substr(seq, pos + 1, 10) in (select s from w)),
f as (select *, case when pos - lag(pos) over (partition by genome_id, ord order by pos) <= 10 then 0 else 1 end as fresh from st),
r as (select *, sum(fresh) over (partition by genome_id, ord order by pos) as run from f)
select genome_id, ord, min(pos)::bigint as begin, (max(pos) + 10 - min(pos))::bigint as length from r group by genome_id, ord, run""")
def shared_regions(spark, d):
    """Stretches of every turn that occur in a benchmark text."""
    return genes.shared_regions(conversation_contigs(spark, d), _benchmark_genes(spark, d).withColumnRenamed("gene", "seq"), 10, chunk=64)


def _benchmark_genes(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("gene_id"), Q.compact("text").alias("gene"))


_COMPACT_TEXT = "upper(regexp_replace(text, '[^ACGTacgt]', '', 'g'))"
_MATCHED = f"""with d as (select conv_id || '.' || turn as id, {_COMPACT_TEXT} as seq from conversations), g as (select item_id as id, {_COMPACT_TEXT} as seq from benchmark),
ds as (select id, i - 1 as pos, substr(seq, i, 11) as s from d, unnest(range(1, length(seq) - 9)) as u(i)),
gs as (select id, i - 1 as pos, substr(seq, i, 11) as s from g, unnest(range(1, length(seq) - 9)) as u(i)),
h as (select ds.id as query, gs.id as ref, ds.pos as p, gs.pos as r from ds join gs using (s)),
runs as (select *, p - row_number() over (partition by query, ref, p - r order by p) as run from h),
m as (select query, ref, min(p) as query_pos, min(r) as ref_pos, count(*) + 10 as length from runs group by query, ref, p - r, run)"""


def _turns_and_items(spark, d):
    turns = table(spark, d, "conversations").select(F.concat_ws(".", "conv_id", "turn").alias("id"), Q.compact("text").alias("seq"))
    return turns, table(spark, d, "benchmark").select(F.col("item_id").alias("id"), Q.compact("text").alias("seq"))


@query("maximal_matches", f"{_MATCHED} select query, ref, query_pos, ref_pos, length from m")
def maximal_matches(spark, d):
    """Maximal exact matches of at least 11 bases between turns of conversations and benchmark items."""
    return matches.maximal_matches(*_turns_and_items(spark, d), 11)


@query("consensus_extension", f"""{_MATCHED},
best as (select query, ref, ref_pos - query_pos as off from m qualify row_number() over (partition by query, ref order by length desc, ref_pos, query_pos) = 1),
laid as (select id, 0 as off, seq, 0 as ext from g union all select ref, off, seq, 1 from best join d on d.id = query),
votes as (select id, off + i as pos, substr(seq, i + 1, 1) as base, 30 * count(*) as weight, 30 * sum(ext) as added from laid, unnest(range(length(seq))) as u(i) group by all),
won as (select *, sum(weight) over (partition by id, pos) as total from votes qualify row_number() over (partition by id, pos order by weight desc, added desc, base) = 1)
select id, min(pos)::bigint as begin, string_agg(base, '' order by pos) as seq, sum(greatest(0, least(96, 2 * weight - total)))::bigint as quality from won group by id""")
def consensus_extension(spark, d):
    """Benchmark items extended by all turns of conversations that share 11 bases or more in a row with them."""
    turns, items = _turns_and_items(spark, d)
    found = consensus.joined(consensus.extended(items, turns, consensus.overlaps(turns, items, 11)))
    return found.select("id", "begin", "seq", F.aggregate("quality", F.lit(0).cast("long"), lambda a, q: a + q).alias("quality"))


@query("rough_align_pairs")
def rough_align_pairs(spark, d):
    """Rough distances of turns and benchmark items by the heaviest chain of maximal matches of at least 12 bases."""
    return matches.rough_alignment(*_turns_and_items(spark, d), 12)


@query("gene_seeds", f"""with {CONV}, g as (select item_id as gene_id, upper(regexp_replace(text, '[^ACGTacgt]', '', 'g')) as gene from benchmark),
gs as (select distinct gene_id, length(gene) as span, unnest([substr(gene, i, 9) for i in range(1, length(gene) - 7)]) as s from g),
st as (select genome_id, ord, '+' as strand, seq from t union all select genome_id, ord, '-', reverse(translate(seq, 'ACGT', 'TGCA')) from t),
cs as (select genome_id, ord, strand, i - 1 as pos, substr(seq, i, 9) as s from (select *, unnest(range(1, length(seq) - 7)) as i from st)),
h as (select genome_id, ord, strand, gene_id, s, unnest([pos // span, pos // span - 1]) as bin from cs join gs using (s))
select genome_id, ord, strand, gene_id, bin::bigint as bin, count(distinct s) as seeds from h where bin >= 0 group by all having count(distinct s) >= 4""")
def gene_seeds(spark, d):
    return genes.candidate_stretches(conversation_contigs(spark, d), _benchmark_genes(spark, d))


@query("short_gene_hits", f"""with {CONV}, g as (select item_id as gene_id, substr(upper(regexp_replace(text, '[^ACGTacgt]', '', 'g')), 1, (8 + item_id % 5)::int) as gene from benchmark),
st as (select genome_id, ord, '+' as strand, seq from t union all select genome_id, ord, '-', reverse(translate(seq, 'ACGT', 'TGCA')) from t)
select genome_id, gene_id, ord, strand, (strpos(seq, gene) - 1 + length(gene))::bigint as "end", length(gene)::bigint as length from st join g on contains(seq, gene)
qualify row_number() over (partition by genome_id, gene_id order by ord, strand, strpos(seq, gene)) = 1""")
def short_gene_hits(spark, d):
    """Genes of 8 to 12 bases, where they occur to the letter: their first place in every genome."""
    panel = _benchmark_genes(spark, d).select("gene_id", F.expr("substring(gene, 1, cast(8 + gene_id % 5 as int))").alias("gene"))
    found = genes.find_genes(conversation_contigs(spark, d), panel).where((F.col("score") == 1.0) & (F.col("seq") != ""))
    whole = found.join(panel, "gene_id").where(F.col("seq") == F.col("gene"))
    return whole.select("genome_id", "gene_id", "ord", "strand", "end", "length")


@query("gene_hits")
def gene_hits(spark, d):
    return genes.find_genes(conversation_contigs(spark, d), _benchmark_genes(spark, d))


@query("gene_identity_pairs")
def gene_identity_pairs(spark, d):
    """Genomes compared by the benchmark genes found in them."""
    panel = _benchmark_genes(spark, d)
    hits = genes.find_genes(conversation_contigs(spark, d), panel).select("genome_id", "gene_id", "seq")
    return genes.gene_pair_distances(hits, panel)


@query("tabular_identity", """with h as (select l_suppkey % 50 as q, l_partkey % 50 as t, 100 - 100 * l_discount as pident, l_quantity as length from lineitem),
o as (select q, t, sum((1 - pident / 100) * length) / sum(length) as d from h where q <> t group by all)
select least(q, t) as id_a, greatest(q, t) as id_b, round(case when count(*) = 2 then avg(d) end + 1e-9::double, 6) as dist from o group by 1, 2""")
def tabular_identity(spark, d):
    hits = table(spark, d, "lineitem").select(
        (F.col("l_suppkey") % 50).alias("query"), (F.col("l_partkey") % 50).alias("target"), (100 - 100 * F.col("l_discount")).alias("pident"), F.col("l_quantity").alias("length"))
    return genes.tabular_identity(hits).withColumn("dist", F.round(F.col("dist") + NUDGE, 6))


@query("f_distribution_few", "select p_partkey, round(sqrt((p_size / 50.0) / (1 + p_size / 50.0)), 6) as p, round(1 - 1 / (1 + p_size / 50.0), 6) as q from part")
def f_distribution_few(spark, d):
    """Closed forms again: 1 and 2 degrees of freedom, and 2 and 2."""
    at = F.col("p_size") / F.lit(50.0)
    return table(spark, d, "part").select("p_partkey", F.round(f_distribution_cdf(at * 2, 1.0, 2.0), 6).alias("p"), F.round(f_distribution_cdf(at, 2.0, 2.0), 6).alias("q"))


@query("f_distribution", "select p_partkey, round(1 - pow(1 + p_size / 4.0, -2.0), 6) as p from part")
def f_distribution(spark, d):
    """For 2 and 4 degrees of freedom the distribution has a closed form."""
    return table(spark, d, "part").select("p_partkey", F.round(f_distribution_cdf(F.col("p_size") / F.lit(2.0), 2.0, 4.0), 6).alias("p"))
