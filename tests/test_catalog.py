"""A sample of the catalogue against its SQL on the smallest tables."""

from pathlib import Path

import pytest

import __spark_entry__ as entry

FOLDER = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = ["satman_pairs_ordered", "distance_histogram", "pair_list_printed", "kmer_counts_single", "karlin_k2", "minhash_ani_pairs", "gtdb_parse",
          "pcof_parse", "genome_weights_log", "mark_runs", "shared_regions", "gapless_alignment", "distance_matrix_lines"]

pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="test tables are not here")


@pytest.fixture(scope="module")
def db():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{FOLDER}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, db, name):
    df = entry.queries()[name](spark, str(FOLDER))
    columns = sorted(df.columns)
    result = db.execute(entry.oracle_sql()[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    expected = sorted(repr(tuple(row[names.index(c)] for c in columns)) for row in result.fetchall())
    assert sorted(repr(tuple(r[c] for c in columns)) for r in df.collect()) == expected and expected


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).columns == ["id_a", "id_b", "dist"]
