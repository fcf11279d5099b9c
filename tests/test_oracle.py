"""Every registered query of the library against its SQL in DuckDB."""

import collections
import os

import duckdb
import pytest

from peptrail.operators import search
from peptrail.operators.index import SEED
from peptrail.plans import registry

FOLDER = "/root/testdata/sf0.001"


def plain(value):
    return float(f"{value:.9g}") if isinstance(value, float) else value


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_same_rows(spark, name):
    df = registry.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{FOLDER}/{f}'")
    result = con.execute(registry.ORACLE[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert got == sorted(repr([plain(dict(zip(names, r, strict=True))[c]) for c in columns]) for r in result.fetchall())


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")
def test_registered_suffixes_are_every_position(spark):
    starts = registry.QUERIES["protein_starts"](spark, FOLDER).collect()
    size = max(r.begin + r.size for r in starts) + 1
    for name in ("suffix_array_whole", "suffix_to_protein_whole"):
        assert sorted(r.pos for r in registry.QUERIES[name](spark, FOLDER).collect()) == list(range(size))
    hits = collections.Counter(r.pep for r in search.occurrences(registry.engine(spark, FOLDER).proteins, spark.createDataFrame([(x,) for x in registry.BOUNDS], "pep string"), True).collect())
    assert {r.pep: r.hi - r.lo for r in registry.QUERIES["search_bounds_whole"](spark, FOLDER).collect()} == dict(hits)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")
def test_registered_prefixes_reach_the_seed_length(spark):
    want = collections.Counter()
    for r in registry.engine(spark, FOLDER).proteins.select("sequence").collect():
        want.update(r.sequence[i : i + k] for i in range(len(r.sequence)) for k in range(1, SEED + 1) if i + k <= len(r.sequence))
    assert {r.prefix: r.n for r in registry.QUERIES["prefix_lca_whole"](spark, FOLDER).collect()} == dict(want)


@pytest.mark.parametrize("name", ["code_annotations", "extend_codes"])
def test_proteins_that_share_a_cut_name(spark, tmp_path, name):
    # Keys from a million on are cut to six digits: key 100000 shares its name with 1000003, in the other batch, and 1000005, in the same one.
    keys = [(100000, 3), (1000003, 40), (1000005, 3), (7, 30)]
    columns = "p_partkey long, p_size int, p_name string, p_brand string"
    spark.createDataFrame([(k, z, "hot bolt", "b") for k, z in keys], columns).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    result = con.execute(registry.ORACLE[name])
    columns = [d[0] for d in result.description]
    want = [dict(zip(columns, r, strict=True)) for r in result.fetchall()]
    got = [r.asDict() for r in registry.QUERIES[name](spark, str(tmp_path)).collect()]
    # The SQL leaves open which protein's text is any_value, and the order of codes that share a place.
    three = lambda r: sorted(r["codes"][i : i + 6] for i in range(0, len(r["codes"]), 6))
    by = lambda r: (r["uniprot_id"], r.get("batch", 0))
    assert sorted((by(r), three(r)) for r in got) == sorted((by(r), three(r)) for r in want)
    texts = {f"EC:1.{z % 7}.1.-;GO:{k % 50:07d};IPR:IPR{z:06d}" for k, z in keys}
    assert all(r["text"] in texts for r in got)


@pytest.mark.parametrize("name", ["code_annotations", "extend_codes"])
def test_shared_names_are_coded_in_the_order_of_proteins(spark, tmp_path, name):
    """Findings F4 and F5 of round 4: of the orders that the SQL leaves open, the one of proteins, as in the SQL with its ties broken by them."""
    columns = "p_partkey long, p_size int, p_name string, p_brand string"
    rows = [(k, 1 + k * 7 % 50, "hot bolt", "b") for k in (5, 100000, 100001, *range(1000000, 1000020))]
    spark.createDataFrame(rows, columns).repartition(3).write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    broken = registry.ORACLE[name].replace("two AS (SELECT", "two AS (SELECT idx,").replace("e AS (SELECT", "e AS (SELECT idx,").replace("'' ORDER BY i)", "'' ORDER BY i, idx)").replace("any_value(fa)", "arg_min(fa, idx)")
    result = con.execute(broken)
    names = [d[0] for d in result.description]
    want = sorted(repr([dict(zip(names, r, strict=True))[c] for c in sorted(names)]) for r in result.fetchall())
    assert sorted(repr([r[c] for c in sorted(names)]) for r in registry.QUERIES[name](spark, str(tmp_path)).collect()) == want
    assert len(want) == (3 if name == "code_annotations" else 5)
