import duckdb
import pytest

from lexiloom.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOME = ["idf_top_terms", "corpus_quantiles", "pageview_rollup_rank", "neighbors_top25", "page_rank_table", "state_keys"]


@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = registry.queries()[name](spark, SF)
    found = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    tidy = lambda v: round(v, 6) + 0.0 if isinstance(v, float) else v
    a = sorted(tuple(map(repr, map(tidy, r))) for r in df.select(*names).collect())
    assert a == sorted(tuple(map(repr, map(tidy, r))) for r in found.fetchall())


def test_every_oracle_has_its_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())
