"""Queries on sequences.  Conversations are genomes whose turns are contigs; documents are single-contig genomes."""

from pyspark.sql import functions as F

from sigloom.functions import hashing, sequences as Q
from sigloom.operators import kmers, signatures as S, sketch, sketch_join, sparse_profiles
from sigloom.operators.pairs import PairJob
from sigloom.plans.catalog import query, table
from sigloom.plans.queries_vectors import rounded
from sigloom.sources import fasta

# ---------------------------------------------------------------- inputs


def conversation_contigs(spark, d, form=Q.compact):
    return table(spark, d, "conversations").select(
        F.col("conv_id").alias("genome_id"), F.col("turn").cast("long").alias("ord"),
        F.concat_ws(".", "conv_id", "role").alias("name"), form("text").alias("seq"))


def document_contigs(spark, d, form=Q.compact):
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("genome_id"), F.lit(0).cast("long").alias("ord"), F.col("doc_id").cast("string").alias("name"),
        form("text").alias("seq"))


_COMPACT = "upper(regexp_replace(text, '[^ACGTacgt]', '', 'g'))"
_DECODE = "upper(regexp_replace(translate(text, 'Uu', 'Tt'), '[^ACGTacgt]', 'N', 'g'))"
_CONV = "conv_id as genome_id, turn::bigint as ord, conv_id::varchar || '.' || role as name"
CONV = f"t as (select {_CONV}, {_COMPACT} as seq from conversations)"
CONV_N = f"t as (select {_CONV}, {_DECODE} as seq from conversations)"
DOCS = f"t as (select doc_id as genome_id, 0::bigint as ord, doc_id::varchar as name, {_COMPACT} as seq from documents)"
_SOME = f"t as (select item_id as genome_id, {_COMPACT} as seq from benchmark)"
_ASKED = f"t as (select item_id as genome_id, 0::bigint as ord, item_id::varchar as name, {_COMPACT} as seq from benchmark)"
NUDGE = 1e-9  # many ratios are exact binary fractions; moves them off the rounding boundary on both sides
_RC = "reverse(translate({x}, 'ACGT', 'TGCA'))"


def counts_sql(k, source=CONV, both=True, name="c"):
    rc = f" union all select genome_id, {_RC.format(x='kmer')} from {name}_o" if both else ""
    return f"""{source}, {name}_o as (select genome_id, kmer from (
    select genome_id, unnest([substr(seq, i, {k}) for i in range(1, length(seq) - {k} + 2)]) as kmer from t) where not contains(kmer, 'N')),
{name}_b as (select genome_id, kmer from {name}_o{rc}),
{name} as (select genome_id, kmer, count(*) as n from {name}_b group by all)"""


def full_sql(k, name="c"):
    """Counts of every possible k-mer of every genome, zeros included."""
    letters = " || ".join(f"substr('ACGT', 1 + (i // {4 ** (k - 1 - p)}) % 4, 1)" for p in range(k))
    return f"""{name}_k as (select {letters} as kmer from (select unnest(range({4 ** k})) as i)),
{name}_f as (select g.genome_id, w.kmer, coalesce(n, 0)::double as n from (select distinct genome_id from t) g cross join {name}_k w
  left join {name} using (genome_id, kmer))"""


def karlin_sql(k, source=CONV):
    pattern = " || ".join(f"case when (mask >> {p}) & 1 = 1 then substr(kmer, {p + 1}, 1) else '-' end" for p in range(k))
    return f"""{counts_sql(k, source)}, {full_sql(k)},
tot as (select genome_id, sum(n) as total from c_f group by 1),
masks as (select unnest(range(1, {2 ** k - 1})) as mask),
proj as (select genome_id, kmer, n, bit_count(mask) as bits, sum(n) over (partition by genome_id, mask, {pattern}) as marg from c_f, masks),
karl as (select genome_id, kmer, exp(ln((case when max(n) > 0 then max(n) else 1.0 / {4 ** k} end) / max(total)) + sum(
    (case when bits % 2 = {k % 2} then 1 else -1 end) * ln((case when marg > 0 then marg else 1.0 / bits end) / total))) as rho,
    max(total) as total
  from proj join tot using (genome_id) group by genome_id, kmer)"""


def _finite(column):
    return F.when(~F.isnan(column) & (F.abs(column) != float("inf")), column)




def by_kmer(sigs, k, value, extra_tail=False):
    """Dense profiles as one row per k-mer."""
    # the outer form: the plain one adds a filter on the array's size, which would run the kernel a second time
    rows = sigs.select(F.col("id").alias("genome_id"), F.posexplode_outer("sig").alias("pos", "v")).where("pos is not null")
    text = kmers.kmer_text(F.col("pos").cast("long"), k)
    if extra_tail:
        text = F.when(F.col("pos") == 4 ** k, "total").otherwise(text)
    return rows.select("genome_id", text.alias("kmer"), F.round(_finite(F.col("v")) + NUDGE, 6).alias(value))


# ---------------------------------------------------------------- contigs


@query("decode_contigs", f"with {CONV_N} select genome_id, ord, name, seq, length(seq)::bigint as len from t")
def decode_contigs(spark, d):
    return conversation_contigs(spark, d, Q.decode).withColumn("len", F.length("seq").cast("long"))


@query("contig_filter", f"with {CONV} select genome_id, ord, name, length(seq)::bigint as len from t where length(seq) >= 80")
def contig_filter(spark, d):
    kept = fasta.filter_short(conversation_contigs(spark, d), 80)
    return kept.select("genome_id", "ord", "name", F.length("seq").cast("long").alias("len"))


_MIXED = "regexp_replace(text, '[^ACGTUNacgtunw]', '', 'g')"


@query("valid_contigs", f"""with r as (select conv_id as genome_id, {_MIXED} as raw from conversations)
select genome_id, count(*) as contigs, count(*) filter (where not regexp_matches(raw, '^[ACGTUNacgtun]*$')) as invalid,
  sum(case when regexp_matches(raw, '^[ACGTUNacgtun]*$') then length(raw) else 0 end)::bigint as bases from r group by 1""")
def valid_contigs(spark, d):
    raw = conversation_contigs(spark, d, lambda t: F.regexp_replace(t, "[^ACGTUNacgtunw]", ""))
    checked = fasta.validate(raw)
    return checked.groupBy("genome_id").agg(
        F.count("*").alias("contigs"), F.count_if(~F.col("valid")).alias("invalid"), F.sum(F.length("seq")).alias("bases"))


@query("fasta_records", f"with {CONV} select genome_id, ord, '>' || name || chr(10) || seq as record from t")
def fasta_records(spark, d):
    return conversation_contigs(spark, d).select("genome_id", "ord", Q.fasta_record("name", "seq").alias("record"))


@query("fastq_records", f"""with {CONV} select genome_id, ord,
  '@' || name || chr(10) || seq || chr(10) || '+' || chr(10) || repeat('5', length(seq)) as record from t""")
def fastq_records(spark, d):
    return conversation_contigs(spark, d).select("genome_id", "ord", Q.fastq_record("name", "seq").alias("record"))


@query("fasta_parse", f"""with {CONV} select genome_id, ord as turn, 0::bigint as ord, name, seq from t
union all select genome_id, ord, 1::bigint, name || ' rc', {_RC.format(x='seq')} from t""")
def fasta_parse(spark, d):
    """A FASTA text of two wrapped records per turn, parsed back into contigs."""
    wrapped = F.concat(F.substring("seq", 1, 7), F.lit("\r\n"), F.expr("substring(seq, 8)"))
    value = F.concat(Q.fasta_record("name", wrapped), F.lit("\n"), Q.fasta_record(F.concat("name", F.lit(" rc")), Q.reverse_complement("seq")), F.lit("\n"))
    texts = conversation_contigs(spark, d).select("genome_id", F.col("ord").alias("turn"), value.alias("value"))
    return fasta.parse_texts(texts, keep=("genome_id", "turn")).select("genome_id", "turn", "ord", "name", "seq")


# ---------------------------------------------------------------- k-mer signatures


@query("kmer_counts_single", f"with {counts_sql(3, CONV_N, both=False)} select * from c")
def kmer_counts_single(spark, d):
    counts = kmers.kmer_counts(conversation_contigs(spark, d, Q.decode), 3, double_strand=False)
    return counts.select("genome_id", kmers.kmer_text("code", 3).alias("kmer"), "n")


@query("kmer_counts_double", f"with {counts_sql(3, DOCS)} select * from c")
def kmer_counts_double(spark, d):
    return kmers.kmer_counts(document_contigs(spark, d), 3).select("genome_id", kmers.kmer_text("code", 3).alias("kmer"), "n")


@query("kmer_counts_long", f"with {counts_sql(15)} select * from c")
def kmer_counts_long(spark, d):
    return kmers.kmer_counts(conversation_contigs(spark, d), 15).select("genome_id", kmers.kmer_text("code", 15).alias("kmer"), "n")


@query("kmer_freq", f"with {counts_sql(3, DOCS)} select genome_id, kmer, round(n / sum(n) over (partition by genome_id), 6) as freq from c")
def kmer_freq(spark, d):
    freq = kmers.kmer_frequencies(kmers.kmer_counts(document_contigs(spark, d), 3))
    return freq.select("genome_id", kmers.kmer_text("code", 3).alias("kmer"), F.round("freq", 6).alias("freq"))


@query("kmer_canonical", f"with {counts_sql(4)} select * from c where kmer <= {_RC.format(x='kmer')}")
def kmer_canonical(spark, d):
    counts = kmers.canonical_only(kmers.kmer_counts(conversation_contigs(spark, d), 4), 4)
    return counts.select("genome_id", kmers.kmer_text("code", 4).alias("kmer"), "n")


@query("canonical_profile", f"""with {counts_sql(2)}, {full_sql(2)}
select genome_id, (row_number() over (partition by genome_id order by kmer) - 1)::bigint as pos, n from c_f where kmer <= {_RC.format(x='kmer')}""")
def canonical_profile(spark, d):
    kept = S.canonical_signature(S.counts_signature(conversation_contigs(spark, d), 2), 2)
    return kept.select(F.col("id").alias("genome_id"), F.posexplode_outer("sig").alias("p", "n")).where("p is not null").select("genome_id", F.col("p").cast("long").alias("pos"), "n")


@query("frequency_profile", f"""with {counts_sql(2, CONV_N)}, {full_sql(2)}
select genome_id, kmer, round(coalesce(n / nullif(sum(n) over (partition by genome_id), 0), 0) + 1e-9::double, 6) as freq from c_f""")
def frequency_profile(spark, d):
    return by_kmer(S.frequency_signature(conversation_contigs(spark, d, Q.decode), 2), 2, "freq")


@query("kmer_presence", f"with {counts_sql(3)}, {full_sql(3)} select genome_id, kmer, round((n <> 0)::int::double + 1e-9::double, 6) as present from c_f")
def kmer_presence(spark, d):
    return by_kmer(S.presence_signature(conversation_contigs(spark, d), 3), 3, "present")


@query("karlin_k2", f"with {karlin_sql(2)} select genome_id, kmer, round(rho + 1e-9::double, 6) as rho from karl")
def karlin_k2(spark, d):
    return by_kmer(S.karlin_signature(conversation_contigs(spark, d), 2), 2, "rho")


@query("karlin_k3", f"with {karlin_sql(3)} select genome_id, kmer, round(rho + 1e-9::double, 6) as rho from karl")
def karlin_k3(spark, d):
    return by_kmer(S.karlin_signature(conversation_contigs(spark, d), 3), 3, "rho")


@query("karlin_k6", f"with {karlin_sql(6, _SOME)} select genome_id, kmer, round(rho + 1e-9::double, 6) as rho from karl")
def karlin_k6(spark, d):
    """The word length of the largest preset, over the benchmark texts."""
    texts = table(spark, d, "benchmark").select(F.col("item_id").alias("genome_id"), Q.compact("text").alias("seq"))
    return by_kmer(S.karlin_signature(texts, 6), 6, "rho")


@query("karlin_single_strand", f"with {karlin_sql(2).replace(counts_sql(2), counts_sql(2, both=False))} select genome_id, kmer, round(rho + 1e-9::double, 6) as rho from karl")
def karlin_single_strand(spark, d):
    return by_kmer(S.karlin_signature(conversation_contigs(spark, d), 2, double_strand=False), 2, "rho")


@query("karlin_len", f"""with {karlin_sql(2)} select genome_id, kmer, round(rho + 1e-9::double, 6) as rho from karl
union all select genome_id, 'total', round(total + 1e-9::double, 6) from tot""")
def karlin_len(spark, d):
    return by_kmer(S.karlin_length_signature(conversation_contigs(spark, d), 2), 2, "rho", extra_tail=True)


_KARL_VECTORS = "z as (select genome_id as id, list(rho order by kmer) as sig, max(total) as total from karl group by 1)"


@query("pasit4_pairs", f"""with {karlin_sql(4)}, {_KARL_VECTORS}
select a.id as id_a, b.id as id_b, round(list_sum(list_transform(list_zip(a.sig, b.sig), lambda x: least(abs(x[1] - x[2]), 0.02))) / (256 * 0.02), 6) as dist
from z a join z b on a.id < b.id""")
def pasit4_pairs(spark, d):
    return rounded(PairJob(S.karlin_signature(conversation_contigs(spark, d), 4), "PaSiT", theta=0.02).pairs())


@query("pasitl_pairs", f"""with {karlin_sql(2)}, {_KARL_VECTORS}
select a.id as id_a, b.id as id_b, round(list_sum(list_transform(list_zip(a.sig, b.sig),
    lambda x: least(abs(ln(x[1]) * ln(a.total) - ln(x[2]) * ln(b.total)), ln(1.02) * ln((a.total + b.total) / 2)))) / (16 * ln(1.02) * ln((a.total + b.total) / 2)), 6) as dist
from z a join z b on a.id < b.id""")
def pasitl_pairs(spark, d):
    return rounded(PairJob(S.karlin_length_signature(conversation_contigs(spark, d), 2), "PaSiTL", theta=0.02).pairs())


@query("length_profile_pairs", f"""with {karlin_sql(2)}, {_KARL_VECTORS}
select a.id as id_a, b.id as id_b, round(list_sum(list_transform(list_zip(a.sig, b.sig), lambda x: least(abs(x[1] - x[2]), 0.1))) / (16 * 0.1), 6) as dist
from z a join z b on a.id < b.id""")
def length_profile_pairs(spark, d):
    """The saturated distance leaves out the length element of a length-extended profile."""
    return rounded(PairJob(S.karlin_length_signature(conversation_contigs(spark, d), 2), "PaSiT", theta=0.1, length_tail=True).pairs())


def _markov(k, parts):
    return f"""select genome_id, kmer, round(case when m > 0 and v > 0 then (n - e) / sqrt(v) end + 1e-9::double, 6) as z from (
  select genome_id, kmer, n, m, l * r / nullif(m, 0) as e, l * r / nullif(m, 0) * (m - l) * (m - r) / nullif(m * m, 0) as v from ({parts}))"""


_MARKOV_SUMS = """select genome_id, kmer, n, sum(n) over (partition by genome_id, left(kmer, 2)) as l,
  sum(n) over (partition by genome_id, right(kmer, 2)) as r, sum(n) over (partition by genome_id, substr(kmer, 2, 1)) as m from c_f"""
_MARKOV_COUNTS = """select f.genome_id, f.kmer, f.n, coalesce(l.n, 0)::double as l, coalesce(r.n, 0)::double as r, coalesce(m.n, 0)::double as m
  from c_f f left join c2 l on l.genome_id = f.genome_id and l.kmer = left(f.kmer, 2)
  left join c2 r on r.genome_id = f.genome_id and r.kmer = right(f.kmer, 2)
  left join c1 m on m.genome_id = f.genome_id and m.kmer = substr(f.kmer, 2, 1)"""


@query("markov_z_k3", f"with {counts_sql(3)}, {full_sql(3)} {_markov(3, _MARKOV_SUMS)}")
def markov_z_k3(spark, d):
    return by_kmer(S.markov_signature(conversation_contigs(spark, d), 3), 3, "z")


def _without_source(sql, source=CONV):
    return sql[len(source) + 2:]


@query("markov_z_inf_k3", f"""with {counts_sql(3)}, {full_sql(3)}, {_without_source(counts_sql(2, name='c2'))},
{_without_source(counts_sql(1, name='c1'))} {_markov(3, _MARKOV_COUNTS)}""")
def markov_z_inf_k3(spark, d):
    return by_kmer(S.markov_independent_signature(conversation_contigs(spark, d), 3), 3, "z")


@query("tetra_pairs", f"""with {counts_sql(4)}, {full_sql(4)}, q as ({_markov(4, _MARKOV_SUMS.replace(', 2))', ', 3))').replace('2, 1)', '2, 2)')).replace('round(case', '(case').replace('end + 1e-9::double, 6)', 'end)')}),
whole as (select genome_id from q group by 1 having count(z) = 256),
ctr as (select genome_id, kmer, z - avg(z) over (partition by genome_id) as x from q join whole using (genome_id)),
v as (select genome_id as id, list(x order by kmer) as sig from ctr group by 1)
select a.id as id_a, b.id as id_b, round(1 - (list_dot_product(a.sig, b.sig) / (sqrt(list_dot_product(a.sig, a.sig)) * sqrt(list_dot_product(b.sig, b.sig))) + 1) / 2, 6) as dist
from v a join v b on a.id < b.id""")
def tetra_pairs(spark, d):
    """Pairs with an undefined score anywhere have no correlation and drop out."""
    return rounded(PairJob(S.markov_signature(conversation_contigs(spark, d), 4), "corr").pairs())


@query("gc_content", f"with {CONV_N} select genome_id, round(sum(length(regexp_replace(seq, '[^CG]', '', 'g'))) / sum(length(seq)), 6) as gc from t group by 1")
def gc_content(spark, d):
    return kmers.gc_content(conversation_contigs(spark, d, Q.decode)).withColumn("gc", F.round("gc", 6))


@query("gc_content_known", f"""with {CONV_N} select genome_id, round(sum(length(regexp_replace(seq, '[^CG]', '', 'g')))
  / nullif(sum(length(regexp_replace(seq, '[^ACGT]', '', 'g'))), 0), 6) as gc from t group by 1""")
def gc_content_known(spark, d):
    return kmers.gc_content_known(conversation_contigs(spark, d, Q.decode)).withColumn("gc", F.round("gc", 6))


@query("genome_length", f"with {CONV} select genome_id, sum(length(seq))::bigint as length from t group by 1")
def genome_length(spark, d):
    return kmers.genome_length(conversation_contigs(spark, d))


@query("gc_pairs", f"""with {CONV}, g as (select genome_id as id, sum(length(regexp_replace(seq, '[^CG]', '', 'g'))) / sum(length(seq)) as gc from t group by 1)
select a.id as id_a, b.id as id_b, round(abs(a.gc - b.gc), 6) as dist from g a join g b on a.id < b.id""")
def gc_pairs(spark, d):
    return rounded(PairJob(S.gc_signature(conversation_contigs(spark, d)), "manhattan").pairs())


_LONG = f"""with {counts_sql(11)}, g as (select genome_id as id, coalesce(sum(n), 0) as total from (select distinct genome_id from t) left join c using (genome_id) group by 1),
f as (select genome_id as id, kmer, n / total as f, n from c join g on g.id = genome_id)"""


@query("freq_k11_pairs", _LONG + f""", met as (select a.id as id_a, b.id as id_b, sum(least(a.f, b.f)) as common from f a join f b on a.kmer = b.kmer and a.id < b.id group by all)
select a.id as id_a, b.id as id_b, round((a.total > 0)::int + (b.total > 0)::int - 2 * coalesce(common, 0) + {NUDGE}, 6) as dist
from g a join g b on a.id < b.id left join met on id_a = a.id and id_b = b.id""")
def freq_k11_pairs(spark, d):
    """Manhattan distances of frequencies of words of 11 bases."""
    counts = kmers.kmer_counts(conversation_contigs(spark, d), 11, keep_empty=True)
    pairs = sparse_profiles.sparse_pairs(sparse_profiles.sparse_profile(counts, share=True), "manhattan", 11)
    return rounded(pairs.withColumn("dist", F.col("dist") + NUDGE))


@query("pearson_k11_pairs", _LONG + f""", met as (select a.id as id_a, b.id as id_b, sum(a.n * b.n)::double as ab from f a join f b on a.kmer = b.kmer and a.id < b.id group by all),
m as (select id, total::double as s, coalesce(sum(n * n), 0)::double as ss from g left join f using (id) group by id, total)
select a.id as id_a, b.id as id_b, round(0.5 - 0.5 * (coalesce(ab, 0) - a.s * b.s / {4 ** 11}) / sqrt(nullif(a.ss - a.s * a.s / {4 ** 11}, 0)) / sqrt(nullif(b.ss - b.s * b.s / {4 ** 11}, 0)), 6) as dist
from m a join m b on a.id < b.id left join met on id_a = a.id and id_b = b.id where dist is not null""")
def pearson_k11_pairs(spark, d):
    """Correlation distances of counts of words of 11 bases; a conversation without such a word has none."""
    counts = kmers.kmer_counts(conversation_contigs(spark, d), 11, keep_empty=True)
    return rounded(sparse_profiles.sparse_pairs(sparse_profiles.sparse_profile(counts), "pearson", 11))


_K8 = "select genome_id, kmer, n / sum(n) over (partition by genome_id) as f from c"


@query("satman_k8_documents", f"""with rf as (with {counts_sql(8, DOCS)} {_K8}), qf as (with {counts_sql(8, _ASKED)} {_K8}),
ra as (select id, coalesce(sum(least(f, 0.001)) filter (f is not null), 0) as s from (select doc_id as id from documents) left join rf on genome_id = id group by 1),
qa as (select id, coalesce(sum(least(f, 0.001)) filter (f is not null), 0) as s from (select item_id as id from benchmark) left join qf on genome_id = id group by 1),
met as (select a.genome_id as id_a, b.genome_id as id_b, sum(least(a.f, 0.001) + least(b.f, 0.001) - least(abs(a.f - b.f), 0.001)) as s from rf a join qf b using (kmer) group by all)
select ra.id as id_a, qa.id as id_b, round((ra.s + qa.s - coalesce(met.s, 0)) / {4 ** 8 * 0.001}, 6) as dist
from ra cross join qa left join met on id_a = ra.id and id_b = qa.id""")
def satman_k8_documents(spark, d):
    """Saturated distances of word frequencies (8 bases) of every document and every benchmark item."""
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("genome_id"), Q.compact("text").alias("seq"))
    refs, queries = (sparse_profiles.sparse_profile(kmers.kmer_counts(c, 8, keep_empty=True), share=True) for c in (document_contigs(spark, d), asked))
    return rounded(sparse_profiles.sparse_pairs(refs, "PaSiT", 8, theta=0.001, queries=queries))


@query("search_documents", f"""with {counts_sql(2, DOCS, name='r')}, {full_sql(2, 'r')},
rt as (select genome_id, sum(n) as total from r_f group by 1),
rv as (select genome_id as id, list(coalesce(n / nullif(total, 0), 0) order by kmer) as sig from r_f join rt using (genome_id) group by 1),
qs as (select item_id as genome_id, {_COMPACT} as seq from benchmark),
qo as (select genome_id, unnest([substr(seq, i, 2) for i in range(1, length(seq))]) as kmer from qs),
qb as (select * from qo union all select genome_id, {_RC.format(x='kmer')} from qo),
qc as (select genome_id, kmer, count(*) as n from qb group by all), qt as (select genome_id, sum(n) as total from qc group by 1),
qf as (select genome_id, r_k.kmer, coalesce(n, 0) / total as f from qt cross join r_k left join qc using (genome_id, kmer)),
qv as (select genome_id as id, list(f order by kmer) as sig from qf group by 1)
select rv.id as id_a, qv.id as id_b, round(list_sum(list_transform(list_zip(rv.sig, qv.sig), lambda x: abs(x[1] - x[2]))), 6) as dist from rv cross join qv""")
def search_documents(spark, d):
    """Every reference document against every benchmark query; a document without a 2-mer has an all-zero profile."""
    refs = S.frequency_signature(document_contigs(spark, d), 2)
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("genome_id"), Q.compact("text").alias("seq"))
    return rounded(PairJob(refs, "manhattan", queries=S.frequency_signature(asked, 2)).pairs())


@query("search_topk_documents", f"""with {counts_sql(2, DOCS, name='r')}, {full_sql(2, 'r')},
rv as (select genome_id as id, list(n order by kmer) as sig from r_f group by 1),
qs as (select item_id as genome_id, {_COMPACT} as seq from benchmark),
qo as (select genome_id, unnest([substr(seq, i, 2) for i in range(1, length(seq))]) as kmer from qs),
qb as (select * from qo union all select genome_id, {_RC.format(x='kmer')} from qo),
qc as (select genome_id, kmer, count(*) as n from qb group by all),
qv as (select g.genome_id as id, list(coalesce(n, 0)::double order by r_k.kmer) as sig from qs g cross join r_k left join qc on qc.genome_id = g.genome_id and qc.kmer = r_k.kmer group by 1),
pr as (select qv.id as query_id, rv.id as id, list_sum(list_transform(list_zip(rv.sig, qv.sig), lambda x: abs(x[1] - x[2]))) as dist from rv cross join qv)
select query_id, (row_number() over (partition by query_id order by dist, id))::integer as rank, id, dist from pr qualify rank <= 5""")
def search_topk_documents(spark, d):
    """The five documents closest to each benchmark text by their counts of two bases."""
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("genome_id"), Q.compact("text").alias("seq"))
    refs = S.counts_signature(document_contigs(spark, d), 2)
    return PairJob(refs, "manhattan", queries=S.counts_signature(asked, 2)).search_topk(5)


@query("window_search_topk", f"""with {DOCS}, w as (select genome_id || ':0.' || i as id, substr(seq, 100 * i + 1, 200) as seq from t, unnest(range(0, greatest((length(seq) - 200) // 100 + 1, 0))) as u(i) where length(seq) >= 200),
qs as (select 'q' || item_id as id, {_COMPACT} as seq from benchmark), every as (select * from w union all select * from qs),
o as (select id, unnest([substr(seq, i, 2) for i in range(1, length(seq))]) as kmer from every), b as (select * from o union all select id, {_RC.format(x='kmer')} from o),
c as (select id, kmer, count(*) as n from b group by all), k as (select substr('ACGT', 1 + i // 4, 1) || substr('ACGT', 1 + i % 4, 1) as kmer from (select unnest(range(16)) as i)),
v as (select every.id, list(coalesce(n, 0)::double order by k.kmer) as sig from every cross join k left join c on c.id = every.id and c.kmer = k.kmer group by 1),
pr as (select q.id as query_id, w.id as id, list_sum(list_transform(list_zip(a.sig, z.sig), lambda x: abs(x[1] - x[2]))) as dist from qs q join v z on z.id = q.id cross join w join v a on a.id = w.id)
select query_id, (row_number() over (partition by query_id order by dist, id))::integer as rank, id, dist from pr qualify rank <= 3""")
def window_search_topk(spark, d):
    """The three stretches of 200 bases of any document that are closest to each benchmark text."""
    asked = table(spark, d, "benchmark").select(F.concat(F.lit("q"), F.col("item_id").cast("string")).alias("genome_id"), Q.compact("text").alias("seq"))
    refs = S.counts_signature(kmers.window_genomes(document_contigs(spark, d), 200, 100), 2)
    return PairJob(refs, "manhattan", queries=S.counts_signature(asked, 2)).search_topk(3)


# ---------------------------------------------------------------- sketches


def _hash_sql(k):
    n = (k + 3) // 4
    code = " + ".join(f"(strpos('ACGT', substr(m, {p + 1}, 1)) - 1)::hugeint * {4 ** (k - 1 - p)}" for p in range(k))
    out = f"select genome_id, (({code}) * {2 ** (8 * n - 2 * k)})::hugeint as v, {11 * n}::hugeint as h0 from canon"
    for i in range(n):
        byte = f"((v >> {8 * (n - 1 - i)}) & 255)"
        signed = f"(case when {byte} > 127 then {byte} - 256 else {byte} end)"
        out = f"select genome_id, v, (h0 * 25214903917 + {signed} + 11) % 281474976710656 as h0 from ({out})"
    return f"select genome_id, ((h0 * 25214903917 + 1) % 281474976710656 % 281474976710655)::bigint as hash from ({out})"


def _sketch_sql(k, size, modulus, source=CONV):
    return f"""{counts_sql(k, source, both=False)}, canon as (select genome_id, least(kmer, {_RC.format(x='kmer')}) as m from c),
hashed as (select distinct genome_id, hash from ({_hash_sql(k)}) where hash % {modulus} = 0),
kept as (select genome_id, hash from hashed qualify row_number() over (partition by genome_id order by hash) <= {size})"""


_SKETCH = _sketch_sql(7, 50, 2)


@query("minhash_sketch", f"with {_SKETCH} select * from kept")
def minhash_sketch(spark, d):
    return sketch.kept_hashes(conversation_contigs(spark, d), 7, 50, 2)


@query("minhash_sketch_default", f"with {_sketch_sql(21, 3000, 44, DOCS)} select * from kept")
def minhash_sketch_default(spark, d):
    """Sketches of all documents with the default word length, size and thinning."""
    return sketch.kept_hashes(document_contigs(spark, d))


@query("minhash_ani_pairs", f"""with {_SKETCH},
g as (select t0.id, coalesce(list(hash order by hash) filter (where hash is not null), []) as h from (select distinct genome_id as id from t) t0
      left join kept on kept.genome_id = t0.id group by 1),
l as (select id, h, case when len(h) = 50 then h[50] else 9223372036854775807 end as top from g),
pr as (select a.id as id_a, b.id as id_b, len(list_intersect(a.h, b.h)) as shared,
    len(list_filter(a.h, lambda x: x <= least(a.top, b.top))) as na, len(list_filter(b.h, lambda x: x <= least(a.top, b.top))) as nb
  from l a join l b on a.id < b.id)
select id_a, id_b, round(case when shared = 0 then 1.0 else -ln(2.0 * shared / (na + nb)) / 7 end, 6) as dist from pr where na + nb > 0""")
def minhash_ani_pairs(spark, d):
    sketches = sketch.minhash_signature(conversation_contigs(spark, d), 7, 50, 2)
    return rounded(PairJob(sketches, "approxANI", theta=7.0, sketch_size=50).pairs())


@query("minhash_identity_pairs", f"""with {_SKETCH},
g as (select t0.id, coalesce(list(hash order by hash) filter (where hash is not null), []) as h from (select distinct genome_id as id from t) t0
      left join kept on kept.genome_id = t0.id group by 1),
l as (select id, h, case when len(h) = 50 then h[50] else 9223372036854775807 end as top from g),
pr as (select a.id as id_a, b.id as id_b, len(list_intersect(a.h, b.h)) as shared,
    len(list_filter(a.h, lambda x: x <= least(a.top, b.top))) + len(list_filter(b.h, lambda x: x <= least(a.top, b.top))) as n
  from l a join l b on a.id < b.id)
select id_a, id_b, round(case when shared = 0 then 0.0 else 100 + 100 * ln(2.0 * shared / n) / 7 end, 6) as dist from pr where n > 0""")
def minhash_identity_pairs(spark, d):
    """Percent identity of all genomes by their sketches."""
    sketches = sketch.minhash_signature(conversation_contigs(spark, d), 7, 50, 2)
    return rounded(PairJob(sketches, "approxANI", theta=7.0, sketch_size=50, common_format=True).pairs())


_CLOSE = """select id_a, id_b, round(-ln(2 * j / (1 + j)) / 9, 6) as dist from (
  select id_a, id_b, shared / (len(list_filter(a.h, lambda x: x <= least(a.top, b.top))) + len(list_filter(b.h, lambda x: x <= least(a.top, b.top))) - shared) as j
  from sh join {left} a on a.id = id_a join {right} b on b.id = id_b) where -ln(2 * j / (1 + j)) / 9 <= """


def _tops(name, source):
    return f"{name} as (select genome_id as id, list(hash order by hash) as h, case when count(*) = 200 then max(hash) else 9223372036854775807 end as top from {source} group by 1)"


@query("minhash_neighbours", f"""with {_sketch_sql(9, 200, 2, DOCS)}, {_tops('l', 'kept')},
sh as (select a.genome_id as id_a, b.genome_id as id_b, count(*) as shared from kept a join kept b on a.hash = b.hash and a.genome_id < b.genome_id group by all)
{_CLOSE.format(left='l', right='l')} 0.1""")
def minhash_neighbours(spark, d):
    """All pairs of documents whose sketches are at most 0.1 apart, through an index of hashes."""
    return rounded(sketch_join.neighbours(sketch.minhash_signature(document_contigs(spark, d), 9, 200, 2), 0.1, 9, 200))


@query("minhash_search_neighbours", f"""with refs as (with {_sketch_sql(9, 200, 2, DOCS)} select * from kept), asked as (with {_sketch_sql(9, 200, 2, _ASKED)} select * from kept),
{_tops('l', 'refs')}, {_tops('r', 'asked')},
sh as (select a.genome_id as id_a, b.genome_id as id_b, count(*) as shared from refs a join asked b on a.hash = b.hash group by all)
{_CLOSE.format(left='l', right='r')} 0.25""")
def minhash_search_neighbours(spark, d):
    """Every document near a benchmark item: at most 0.25 apart by their sketches."""
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("genome_id"), F.lit(0).cast("long").alias("ord"), F.col("item_id").cast("string").alias("name"), Q.compact("text").alias("seq"))
    refs, queries = (sketch.minhash_signature(c, 9, 200, 2) for c in (document_contigs(spark, d), asked))
    return rounded(sketch_join.neighbours(refs, 0.25, 9, 200, queries))


_BYTES = "[ascii(x)::hugeint for x in string_split(c_name, '')]"


@query("byte_hash", f"""with h as (select c_custkey,
  list_reduce(list_prepend((length(c_name) * 11)::hugeint, {_BYTES}), lambda h, b: (h * 25214903917 + b + 11) % 281474976710656) as w,
  list_reduce(list_prepend(0::hugeint, {_BYTES}), lambda h, b: (h * 48271 + b) % 2147483647) as n from customer)
select c_custkey, ((w * 25214903917 + 1) % 281474976710656 % 281474976710655)::bigint as wide,
  ((n * 48271 + 1) % 2147483647 % 1000)::bigint as narrow from h""")
def byte_hash(spark, d):
    return table(spark, d, "customer").select(
        "c_custkey", hashing.byte_hash("c_name").alias("wide"), hashing.byte_hash("c_name", 1000).alias("narrow"))


# ---------------------------------------------------------------- windows and sequence functions


@query("seq_windows", f"""with {DOCS}, w as (select genome_id, name, seq, unnest(range(0, (length(seq) - 50) // 25 + 1)) as w from t where length(seq) >= 50)
select genome_id, name || '.' || w as name, w::int as window, (w * 25)::bigint as start, substr(seq, w * 25 + 1, 50) as seq from w""")
def seq_windows(spark, d):
    return kmers.windows(document_contigs(spark, d), 50, 25).select("genome_id", "name", "window", "start", "seq")


@query("seq_windows_even", f"""with {DOCS}, w as (select genome_id, name, seq, unnest(range(0, least(4, (length(seq) - 60) // 3 + 1))) as w,
   (length(seq) - 61)::double / 3 as stride from t where length(seq) >= 60)
select genome_id, name || '.' || w as name, w::int as window, floor(w * stride + 0.01)::bigint as start,
  substr(seq, floor(w * stride + 0.01)::int + 1, 60) as seq from w""")
def seq_windows_even(spark, d):
    return kmers.windows(document_contigs(spark, d), 60, 3, count=4).select("genome_id", "name", "window", "start", "seq")


@query("minimizers", f"""with {CONV}, m as (select genome_id, ord, length(seq) as len, i, substr(seq, i + 1, 5) as mer
   from (select *, unnest(range(0, length(seq) - 4)) as i from t where length(seq) >= 12)),
w as (select genome_id, ord, i, min({{'mer': mer, 'i': i}}) over (partition by genome_id, ord order by i rows between current row and 7 following) as best, len from m),
p as (select genome_id, ord, i, best.i as pos from w where i <= len - 12),
e as (select *, max(pos) over (partition by genome_id, ord order by i rows between unbounded preceding and 1 preceding) as seen from p)
select genome_id, ord, (row_number() over (partition by genome_id, ord order by i) - 1)::bigint as idx, pos::bigint as pos from e where seen is null or pos > seen""")
def minimizers(spark, d):
    return kmers.minimizers(conversation_contigs(spark, d), 12, 5)


@query("reverse_complement", f"with {CONV_N} select genome_id, ord, reverse(translate(seq, 'ACGT', 'TGCA')) as rc, translate(seq, 'ACGT', 'TGCA') as comp, substr(seq, 6, 20) as sub from t")
def reverse_complement(spark, d):
    return conversation_contigs(spark, d, Q.decode).select(
        "genome_id", "ord", Q.reverse_complement("seq").alias("rc"), Q.complement("seq").alias("comp"), Q.subsequence("seq", 5, 20).alias("sub"))


# fixed values: the standard genetic code with its codons in the order T, C, A, G
_CODE = "FFLLSSSSYYXXCCXWLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"


def _protein(s):
    at = " + ".join(f"{w} * (strpos('TCAG', substr({s}, i + {p}, 1)) - 1)" for p, w in ((0, 16), (1, 4), (2, 1)))
    return f"""array_to_string([case when strpos(substr({s}, i, 3), 'N') > 0 then 'X' else substr('{_CODE}', ({at} + 1)::int, 1) end
  for i in range(1, length({s}) - 1, 3)], '')"""



@query("translate_codons", f"with {CONV_N} select genome_id, ord, coalesce({_protein('seq')}, '') as protein from t")
def translate_codons(spark, d):
    return conversation_contigs(spark, d, Q.decode).select("genome_id", "ord", Q.translate_codons("seq").alias("protein"))


def _identity(a, b):
    return f"""list_sum([(substr({a}, i, 1) = substr({b}, i, 1))::int for i in range(1, least(length({a}), length({b})) + 1)])::double
  / nullif(least(length({a}), length({b})), 0)"""


@query("sequence_identity", f"""with {CONV}, p as (select a.genome_id, a.ord, a.seq as x, b.seq as y, coalesce({_protein('a.seq')}, '') as px,
  coalesce({_protein('b.seq')}, '') as py from t a join t b on a.genome_id = b.genome_id and b.ord = a.ord + 1)
select genome_id, ord, round({_identity('x', 'y')}, 6) as nucleotide, round({_identity('px', 'py')}, 6) as amino from p""")
def sequence_identity(spark, d):
    turns = conversation_contigs(spark, d)
    following = turns.select("genome_id", (F.col("ord") - 1).alias("ord"), F.col("seq").alias("next"))
    return turns.join(following, ["genome_id", "ord"]).select(
        "genome_id", "ord", F.round(Q.nucleotide_identity("seq", "next"), 6).alias("nucleotide"),
        F.round(Q.amino_acid_identity("seq", "next"), 6).alias("amino"))


@query("subseq_search", f"""with {CONV_N} select genome_id, ord,
  case when regexp_matches(seq, '[AN][TN][TN]') then length(regexp_extract(seq, '^(.*?)[AN][TN][TN]', 1)) else length(seq) end::int as att,
  case when regexp_matches(substr(seq, 6), '[AN].[AN]') then length(regexp_extract(substr(seq, 6), '^(.*?)[AN].[AN]', 1)) + 5 else length(seq) end::int as ana
from t""")
def subseq_search(spark, d):
    return conversation_contigs(spark, d, Q.decode).select(
        "genome_id", "ord", Q.find_from("seq", "ATT").alias("att"), Q.find_from("seq", "ANA", 5).alias("ana"))


@query("subseq_search_plain", f"""with {CONV} select genome_id, ord,
  case when strpos(substr(seq, 11), 'ATTA') > 0 then strpos(substr(seq, 11), 'ATTA') + 9 else length(seq) end::int as at from t""")
def subseq_search_plain(spark, d):
    return conversation_contigs(spark, d).select("genome_id", "ord", Q.find_from("seq", "ATTA", 10).cast("int").alias("at"))


@query("cut_between", f"""with {CONV}, f as (select genome_id, ord, unnest(regexp_extract_all(seq, '[AN][CN].*?[GN][TN]')
  || regexp_extract_all({_RC.format(x='seq')}, '[AN][CN].*?[GN][TN]')) as piece from t)
select genome_id, ord, piece, count(*) as n from f where length(piece) <= 15 group by all""")
def cut_between(spark, d):
    """Pieces with both markers; longer ones than 15 bases are left out."""
    pieces = conversation_contigs(spark, d).select(
        "genome_id", "ord", F.explode(Q.cut_between_both_strands("seq", "AC", "GT", 15)).alias("piece"))
    return pieces.groupBy("genome_id", "ord", "piece").agg(F.count("*").alias("n"))


@query("cut_open_ended", f"""with {CONV}, f as (select genome_id, ord, 'end' as open, left(piece, 15) as piece from (select genome_id, ord, unnest(regexp_extract_all(seq, '[AN][CN].*?(?:[GN][TN]|$)')) as piece from t)
  union all select genome_id, ord, 'begin', right(piece, 15) from (select genome_id, ord, unnest(regexp_extract_all(seq, '.*?[GN][TN]')) as piece from t))
select genome_id, ord, open, piece, count(*) as n from f group by all""")
def cut_open_ended(spark, d):
    """Pieces that may lack one marker; longer ones keep 15 bases at the other."""
    contigs = conversation_contigs(spark, d)
    parts = [contigs.select("genome_id", "ord", F.lit(name).alias("open"), F.explode(Q.cut_between("seq", "AC", "GT", 15, **flags)).alias("piece"))
             for name, flags in (("end", {"require_end": False}), ("begin", {"require_begin": False}))]
    return parts[0].unionByName(parts[1]).groupBy("genome_id", "ord", "open", "piece").agg(F.count("*").alias("n"))


@query("pack_two_bit", f"""with {CONV}, g as (select genome_id, ord, unnest(range(0, (length(seq) + 3) // 4)) as b, rpad(seq, ((length(seq) + 3) // 4 * 4)::int, 'A') as seq from t),
h as (select genome_id, ord, b, printf('%02X', (list_sum([(strpos('ACGT', substr(seq, b * 4 + i + 1, 1)) - 1) * (64 // (4 ** i)::int) for i in range(0, 4)]))::int) as byte from g)
select t.genome_id, t.ord, coalesce(string_agg(byte, '' order by b), '') as packed from t left join h using (genome_id, ord) group by all""")
def pack_two_bit(spark, d):
    return conversation_contigs(spark, d).select("genome_id", "ord", Q.pack_two_bit("seq").alias("packed"))


@query("min_quality", "select event_id, list_min([ascii(c) - 33 for c in string_split(props, '')])::int as quality from events")
def min_quality(spark, d):
    return table(spark, d, "events").select("event_id", Q.min_quality("props").alias("quality"))


@query("concatenated_genomes", f"""with {CONV} select genome_id, ord, length(seq)::bigint as length,
  coalesce(sum(length(seq)) over (partition by genome_id order by ord rows between unbounded preceding and 1 preceding), 0)::bigint as offset from t""".replace("as offset", 'as "offset"'))
def concatenated_genomes(spark, d):
    """Contigs with their place in the joined sequence of the genome."""
    placed = fasta.contig_offsets(conversation_contigs(spark, d), chunk=3)
    return placed.select("genome_id", "ord", F.length("seq").cast("long").alias("length"), "offset")
