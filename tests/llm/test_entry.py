import re


def test_ten_queries_and_the_pipeline():
    import __spark_entry__

    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert sorted({int(m[1]) for n in queries if (m := re.match(r"op(\d+)_", n))}) == list(range(1, 11))
    assert "pipeline" in queries and {"op3_repeats", "op8_url_filters", "op9_decontaminate"} <= set(sql) <= set(queries)


def test_sql_of_operators(spark, tmp_path):
    import duckdb

    from factflow.llm import entry
    from tests.llm.helpers import docs, folder

    passage = "One two three four five six seven eight nine ten eleven twelve thirteen fourteen. "
    rows = [(1, passage * 8), (2, "x" + passage * 7), (3, passage + "other words " * 200), (4, None), (5, ""), (6, "short")]
    pages = [(1, "http://a.com/en/7"), (2, "https://m.example.com/en/72?x"), (3, None), (4, "http://spam-farm.org/a"), (5, "http://q.net/DE/"), (6, "x://org/es/?")]
    sf = folder(
        tmp_path, documents=docs(spark, rows), benchmark=spark.createDataFrame([(7, passage), (8, "Short"), (9, None)], "item_id long, text string"),
        pages=spark.createDataFrame(pages, "page_id long, url string"))
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet/*.parquet'")
    for name, sql in entry.oracle_sql().items():
        df = entry.queries()[name](spark, sf)
        want = con.execute(f"SELECT {', '.join(sorted(df.columns))} FROM ({sql})").fetchall()
        assert sorted(map(repr, (tuple(r) for r in df.select(*sorted(df.columns)).collect()))) == sorted(map(repr, want)), name
