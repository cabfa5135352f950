"""Queries against their SQL, on the smallest tables."""

import os

import duckdb
import pytest

from quern.plans import catalog

SF = "/root/testdata/sf0.001"
@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.execute(f"create view {file.removesuffix('.parquet')} as select * from '{SF}/{file}'")
    found = con.execute(catalog.SQL[name])
    columns = [d[0] for d in found.description]
    expected = sorted(repr(r) for r in found.fetchall())
    df = catalog.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(repr(tuple(r[c] for c in columns)) for r in df.collect()) == expected


def test_terms_after_any_length(spark, tmp_path):
    filler = "plain words of text " * 100
    texts = [filler, filler, filler + "web scraping is prohibited", filler + "no robots, must not copy", filler, filler + "robots", filler, filler + "not permitted: crawling"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.signal for r in catalog.QUERIES["flt_13_terms_signal"](spark, str(tmp_path)).collect()}
    hit, vague = "potential_automated_access_prohibition", "ambiguous_automation_language"
    # 5: robots stands beside the words that the query adds after the text
    assert got == {0: hit, 1: vague, 2: hit, 3: hit, 4: hit, 5: hit, 6: "approved", 7: hit}


def test_grounding_reads_whole_texts_and_all_items(spark, tmp_path):
    words = [f"{a}{b}word" for a in "abcdefghk" for b in "lmnoprstu"]
    items = [(k, " ".join(words[(k + i) % 81] for i in range(40))) for k in range(50)]
    own = dict(items)
    docs = [(3, own[3] + " in 1987"), (45, own[45]), (95, own[45][:300] + " " + own[45]), (49, " ".join(own[49].split()[:30]) + " " + " ".join(f"zz{w}" for w in words))]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.item_id, r.reason) for r in catalog.QUERIES["flt_15_summary_grounding"](spark, str(tmp_path)).collect()}
    assert got == {3: (3, "numbers"), 45: (45, "long_copy"), 95: (45, None), 49: (49, "unsupported")}


def test_sparql_literal_of_whole_html(spark, tmp_path):
    html = "<p>" + "x" * 300 + '"\\\n\r\t</p>'
    spark.createDataFrame([(1, html)], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = catalog.QUERIES["str_20_sparql_literal"](spark, str(tmp_path)).first().literal
    escaped = html
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        escaped = escaped.replace(a, b)
    assert got == f'"{escaped}"'


def test_first_supported_of_large_keys(spark, tmp_path):
    # parts over 10**6 and suppliers over 10**4, as in tables of 1 GB: an earlier line holds, then the smaller part
    rows = [(1, 1_199_999, 3, 2, "N", "O"), (1, 1, 4, 3, "N", "O"), (2, 11, 59_998, 2, "N", "O"), (2, 12, 1, 2, "N", "O")]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_returnflag string, l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {tuple(r) for r in catalog.QUERIES["flt_21_first_supported"](spark, str(tmp_path)).collect()}
    assert got == {(1, "s0"), (2, "s1")} == set(duckdb.sql(catalog.SQL["flt_21_first_supported"].replace("from lineitem", f"from '{tmp_path}/lineitem.parquet/*.parquet'")).fetchall())


def test_entry_imports_without_llm():
    import __spark_entry__ as entry

    assert set(catalog.SQL) <= set(entry.oracle_sql()) <= set(entry.queries())
