"""Some of the registered queries against their SQL, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from loomery.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOME = [
    "a2_csv_header", "a9_native_extraction_parity", "a17_pinned_reads", "c3_tokenize", "c14_plain_math_title", "c15_clean_abstract", "c25_client_embedding_text", "c29_record_labels", "c35_citation_titles",
    "d3_filtered_records", "e7_email_union", "e9_paper_posters", "f10_topic_trends", "g2_unique_works", "g13_selection_fallback", "j2_nearest_neighbours", "j15_lexical_search", "j16_dense_search",
    "j19_keyword_search", "k2_communities", "k6_identity_resolution", "l2_study_trail", "m2_manifest_shards", "m12_json_validity",
]


def rows(df):
    out = []
    for r in df[sorted(df.columns)].itertuples(index=False):
        out.append(tuple(f"{v:.6f}" if isinstance(v, float) else str(v) for v in r))
    return sorted(out)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", SOME)
def test_a_query_agrees_with_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert rows(entry.queries()[name](spark, SF).toPandas()) == rows(con.sql(entry.oracle_sql()[name]).df())


def test_names_are_those_of_the_inventory():
    names = list(catalog.runs())
    assert len(names) > 150
    assert all(n[0] in "abcdefghjklm" and "_" in n for n in names)


def test_queries_can_be_listed_before_there_is_a_session():
    import subprocess
    import sys

    root = os.path.dirname(os.path.abspath(entry.__file__))
    code = "import __spark_entry__ as e; assert len(e.queries()) > 150 and len(e.oracle_sql()) > 150"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
