"""Sharding, exact duplicates, quality rules and token rollups against plain Python."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sigloom.llm import exact_dedup, quality, sharding, token_counts
from sigloom.llm.common import pick

SPACE = re.compile(r"[\x20\x09-\x0D]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("n", [1, 2, 3, 5, 24, 97, 1000, 1023, 1024, 1025])
def test_permutation_is_one_to_one_and_invertible(spark, n):
    got = spark.range(n).select("id", sharding.permuted(F.col("id"), n, 7).alias("p")).select("id", "p", sharding.permuted(F.col("p"), n, 7, inverse=True).alias("back")).collect()
    assert sorted(r["p"] for r in got) == list(range(n))
    assert all(r["back"] == r["id"] for r in got)


def test_permutation_depends_on_the_seed_and_mixes(spark):
    places = [r[0] for r in spark.range(1000).select(sharding.permuted(F.col("id"), 1000, 1)).collect()]
    other = [r[0] for r in spark.range(1000).select(sharding.permuted(F.col("id"), 1000, 2)).collect()]
    assert places != other
    assert sum(abs(a - b) == 1 for a, b in zip(places, places[1:])) < 20


def test_large_ranges_stay_in_range(spark):
    n = 10**12 + 39
    got = spark.range(n - 50, n).select("id", sharding.permuted(F.col("id"), n).alias("p")).select("id", "p", sharding.permuted(F.col("p"), n, inverse=True).alias("back")).collect()
    assert all(0 <= r["p"] < n and r["back"] == r["id"] for r in got) and len({r["p"] for r in got}) == 50


def test_shards(odd_docs):
    rows = sharding.shard_rows(odd_docs, 4).collect()
    assert len(rows) == odd_docs.count()
    by_shard = defaultdict(list)
    for r in rows:
        by_shard[r["shard"]].append(r["slot"])
    sizes = [len(by_shard[s]) for s in range(4)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(slots) == list(range(len(slots))) for slots in by_shard.values())
    texts = Counter((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in odd_docs.collect())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == texts
    assert {r["law"] for r in rows} == {"rows"} and {r["grown_shard"] for r in rows} == {None}


def test_shards_do_not_depend_on_the_layout(odd_docs):
    def key(rows):
        return sorted((str(r["doc_id"]), r["text_crc32"], r["shard"], r["slot"]) for r in rows)
    assert key(sharding.shard_rows(odd_docs, 3).collect()) == key(sharding.shard_rows(odd_docs.repartition(5), 3).collect())


def test_place_of_a_row_can_be_computed_back(spark, odd_docs):
    rows = sharding.shard_rows(odd_docs, 3)
    n = odd_docs.count()
    back = rows.select("row", sharding.row_at(F.col("shard").cast("long"), F.col("slot"), n, 3).alias("again")).collect()
    assert all(r["row"] == r["again"] for r in back)


def brute_copies(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[SPACE.sub("", text or "")].append((-len(text or ""), doc_id is None, doc_id))
    return groups


def test_exact_copies(odd_docs):
    rows = [(r[0], r[1]) for r in odd_docs.collect()]
    groups = brute_copies(rows)
    got = exact_dedup.group_copies(odd_docs).collect()
    assert len(got) == len(rows)
    assert sum(r["kept"] for r in got) == len(groups)
    expected = Counter()
    for bare, members in groups.items():
        best = min(members, key=lambda m: (m[0], m[1], m[2] or 0))
        for _, _, doc_id in members:
            expected[doc_id, best[2], len(members), hashlib.sha256(bare.encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == expected


def test_exact_copies_over_many_runs(spark):
    rows = [(i, f"text {i % 7}" + " " * (i % 3)) for i in range(700)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(40)
    got = {r["doc_id"]: r for r in exact_dedup.group_copies(df).collect()}
    groups = brute_copies(rows)
    for members in groups.values():
        best = min(members)[2]
        assert {got[m[2]]["keep_id"] for m in members} == {best}
        assert {got[m[2]]["group_size"] for m in members} == {len(members)}
        assert [m[2] for m in members if got[m[2]]["kept"]] == [best]


def test_runs_are_merged_across_batches():
    import pyarrow as pa

    def batch(rows):
        names = ["block", "digest", "width", "keep_chars", "keep_id", "keep_row", "group_size", "ties"]
        kinds = [pa.int64(), pa.binary()] + [pa.int64()] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
    a, b = b"a" * 32, b"b" * 32
    out = list(exact_dedup._collapse(iter([batch([(0, a, 1, 9, 4, 0, 2, 1)]), batch([(0, a, 1, 9, 4, 1, 1, 1), (0, a, 1, 8, 1, 2, 3, 1), (0, b, 1, 1, None, 3, 1, 1)]),
                                           batch([(0, b, 1, 1, None, 4, 1, 1), (1, b, 1, 1, 5, 5, 1, 1)])])))
    rows = [tuple(r.values()) for o in out for r in o.to_pylist()]
    assert rows == [(0, a, 1, 9, 4, 0, 6, 2), (0, b, 1, 1, None, 3, 2, 2), (1, b, 1, 1, 5, 5, 1, 1)]
    with pytest.raises(ValueError):
        list(exact_dedup._collapse(iter([batch([(0, a, 1, 9, 4, 0, 1, 1), (0, a, 2, 9, 4, 0, 1, 1)])])))


def test_dropping_copies_keeps_columns(odd_docs, no_docs):
    kept = exact_dedup.drop_copies(odd_docs)
    assert kept.columns == odd_docs.columns
    assert Counter(SPACE.sub("", r[1] or "") for r in kept.collect()) == Counter(dict.fromkeys(brute_copies([(r[0], r[1]) for r in odd_docs.collect()]), 1))
    assert exact_dedup.drop_copies(no_docs).count() == 0 and exact_dedup.group_copies(no_docs).count() == 0


def brute_counts(text):
    words = WORD.findall(text)
    windows = defaultdict(list)
    for i in range(len(words) - 4):
        windows[tuple(words[i:i + 5])].append(i)
    covered = {i + j for at in windows.values() if len(at) > 1 for i in at for j in range(5)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def brute_judge(rows, max_texts, share):
    def lines(text):
        return [line for line in text.split("\n") if WORD.search(line)]

    def key(line):
        return re.sub(r"[0-9]", "0", re.sub("[A-Z]", lambda m: m[0].lower(), SPACE.sub("", line)))
    texts, seen = defaultdict(set), defaultdict(set)
    for _, text, host in rows:
        texts[host or ""].add(text or "")
        for line in lines(text or ""):
            seen[host or "", key(line)].add(text or "")
    often = {k for k, t in seen.items() if len(t) > max_texts and len(t) * 100 > len(texts[k[0]]) * share}
    out = Counter()
    for doc_id, text, host in rows:
        n, chars, symbols, dup, repeat = brute_counts(text or "")
        gone = [line for line in lines(text or "") if (host or "", key(line)) in often]
        words, gone_chars = sum(len(WORD.findall(line)) for line in gone), sum(len(SPACE.sub("", line)) for line in gone)
        failed = n < 10 or 100 * repeat > 20 * n
        depleted = words > 0 and (n - words < 10 or (chars - gone_chars) * 100 < chars * 30)
        out[doc_id, n, chars, symbols, dup, repeat, failed, words, not failed and not depleted] += 1
    return out


def test_quality_rules(spark, odd_docs):
    rows = [(r[0], r[1], r[2]) for r in odd_docs.collect()]
    got = Counter(tuple(r) for r in quality.judge(odd_docs).collect())
    assert got == brute_judge(rows, quality.MAX_TEXTS, quality.MAX_SHARE_PERCENT)


def test_frequent_lines_are_removed_and_depleted_documents_go(spark):
    own = "these are ten words of its very own for document number"
    rows = [(i, f"Shared footer {i % 10} of all pages here\n{own} {i}\n{own}" if i % 2 else f"shared  FOOTER 7 of all pages here\nshort {i} line", "h") for i in range(60)]
    rows += [(100 + i, "copy of one text with many words in it, more than ten of them", "h") for i in range(50)]
    rows += [(200, "Shared footer 1 of all pages here\nalone on another host " + own, "other")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = Counter(tuple(r) for r in quality.judge(df).collect())
    assert got == brute_judge(rows, quality.MAX_TEXTS, quality.MAX_SHARE_PERCENT)
    kept = {r["doc_id"] for r in quality.keep_good(df).collect()}
    assert kept == {r[0] for r, in ((k,) for k in got if k[-1])} and 101 in kept and 200 in kept and 0 not in kept


def test_kept_texts_lose_their_frequent_lines_in_order(spark):
    own = [" ".join(f"{a}{b}" for b in "bcdfghjklmno") for a in "aei"]
    foot, bare = "Shared footer {} of all pages here", {}
    rows = []
    for i in range(40):
        mine = [f"{line} number n{'x' * i}" for line in own]
        rows.append((i, "\n".join([foot.format(4 + i % 6), mine[0], "", foot.format(1), foot.format(2).upper(), mine[1], " ", mine[2], foot.format(3), ""]), "h", 7))
        bare[i] = "\n".join([mine[0], "", mine[1], " ", mine[2], ""])
    rows += [(1, *rows[1][1:]), (100, own[0] + "\n" + own[1] + "\r\n", "h", 5), (101, rows[0][1], "other", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars int")
    got = Counter(tuple(r) for r in quality.keep_good(df, chars_col="n_chars").collect())
    assert got == Counter([(i, bare[i], "h", len(bare[i])) for i in [*range(40), 1]] + [rows[-2], rows[-1]])


def test_quality_keeps_columns(odd_docs, no_docs):
    kept = quality.keep_good(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == sum(r["kept"] for r in quality.judge(odd_docs).collect())
    assert quality.judge(no_docs).count() == 0 and quality.keep_good(no_docs).count() == 0


CHANGES = "op string, source string, lang string, tokenizer string, tokens long, old_tokens long"


def test_rollup_adds_up_and_is_idempotent(spark, tmp_path):
    rollup = token_counts.Rollup(spark, str(tmp_path / "rollup"))
    assert rollup.totals().count() == 0
    first = spark.createDataFrame([("insert", "a", "en", "v1", 5, None), ("insert", "a", "en", "v1", 7, None), ("insert", None, None, "v1", None, None),
                                   ("insert", "b", "fr", "v1", 1, None)], CHANGES)
    second = spark.createDataFrame([("delete", "a", "en", "v1", 5, None), ("revise", "a", "en", "v1", 9, 7), ("delete", "b", "fr", "v1", 1, None),
                                    ("insert", "b", "fr", "v2", 3, None)], CHANGES)
    assert rollup.commit("one", first) and not rollup.commit("one", first)
    assert rollup.commit("two", second)
    expected = {("a", "en", "v1", 1, 9), (None, None, "v1", 1, 0), ("b", "fr", "v2", 1, 3)}
    assert {tuple(r) for r in rollup.totals().collect()} == expected
    rollup.checkpoint("fold")
    assert not rollup.commit("two", second)
    assert rollup.commit("three", spark.createDataFrame([], CHANGES))
    assert {tuple(r) for r in token_counts.Rollup(spark, str(tmp_path / "rollup")).totals().collect()} == expected
    rollup.commit("four", second.filter("op = 'insert'"))
    assert ("b", "fr", "v2", 2, 6) in {tuple(r) for r in rollup.totals().collect()}


def test_a_batch_committed_while_a_fold_is_made_counts_once(spark, tmp_path, monkeypatch):
    rollup = token_counts.Rollup(spark, str(tmp_path / "rollup"))
    rollup.commit("one", spark.createDataFrame([("insert", "a", "en", "v1", 5, None)], CHANGES))
    late = spark.createDataFrame([("insert", "a", "en", "v1", 10, None)], CHANGES)
    create, records, calls = rollup._create, rollup._records, []

    def during(at):
        if at not in calls:
            calls.append(at)
            token_counts.Rollup(spark, str(tmp_path / "rollup")).commit(at, late)
    monkeypatch.setattr(rollup, "_create", lambda *a: (during("before-the-fold-is-named"), create(*a))[1])
    monkeypatch.setattr(rollup, "_records", lambda: (records(), during("after-the-records-are-listed"))[0])
    rollup.checkpoint("fold")
    assert len(calls) == 2
    assert [tuple(r) for r in token_counts.Rollup(spark, str(tmp_path / "rollup")).totals().collect()] == [("a", "en", "v1", 3, 25)]


def test_rollup_query_on_odd_and_empty_tables(spark, odd_docs, no_docs, tmp_path):
    pytest.importorskip("tiktoken")
    from sigloom.llm.queries import op1_token_rollup
    labels = spark.createDataFrame([(1, 0, 0), (1, 1, 0), (2, 1, 1), (8, 1, 0), (None, 0, 1), (99, 0, 0)], "doc_id long, quality int, toxic int")
    for name, docs in (("odd", pick(odd_docs, doc_id="doc_id", text="text", source="source", lang="lang")), ("none", no_docs)):
        docs.write.parquet(str(tmp_path / name / "documents.parquet"))
        labels.write.parquet(str(tmp_path / name / "labels.parquet"))
    got = {r["source"]: (r["docs"], r["tokens"]) for r in op1_token_rollup(spark, str(tmp_path / "odd")).groupBy("source").agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).collect()}
    assert {k: v[0] for k, v in got.items()} == {"a": 2, "b": 4, "c": 1, None: 2} and op1_token_rollup(spark, str(tmp_path / "none")).count() == 0


def test_two_writers_of_one_batch_count_once(spark, tmp_path):
    a, b = (token_counts.Rollup(spark, str(tmp_path / "r")) for _ in range(2))
    assert a._create("commits/x.json", {"data": "d"}) and not b._create("commits/x.json", {"data": "e"})
    assert a._records() == {"x": {"data": "d"}}


def test_unknown_changes_raise(spark, tmp_path):
    rollup = token_counts.Rollup(spark, str(tmp_path / "r"))
    with pytest.raises(Exception, match="unknown change"):
        rollup.commit("bad", spark.createDataFrame([("upsert", "a", "en", "v1", 1, None)], CHANGES))
    assert rollup.totals().count() == 0


def test_token_counts_are_those_of_the_vocabulary(odd_docs):
    tiktoken = pytest.importorskip("tiktoken")
    import base64

    from sigloom.llm.queries import PATTERN, TOKENIZERS
    file = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(file, "rb"))}
    encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = token_counts.counted_documents(odd_docs, file, PATTERN, "v1").collect()
    assert Counter((r["doc_id"], r["source"], r["tokens"]) for r in got) == Counter(
        (r[0], r[2], len(encoding.encode_ordinary(r[1] or ""))) for r in odd_docs.collect())
