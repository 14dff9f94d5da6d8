"""Queries against their SQL on small tables that the driver's smallest ones do not cover."""

import duckdb

import __spark_entry__ as driver


def both(spark, folder, name, **tables):
    connection = duckdb.connect()
    for table, (rows, schema) in tables.items():
        path = f"{folder}/{table}.parquet"
        spark.createDataFrame(rows, schema).write.parquet(path)
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}/*.parquet'")
    mine = driver.queries()[name](spark, str(folder)).toPandas()
    theirs = connection.sql(driver.oracle_sql()[name]).df()
    tidy = lambda f: sorted(map(tuple, f[sorted(f.columns)].astype(str).values.tolist()))
    return tidy(mine), tidy(theirs)


def test_report_counts_every_page_and_long_segments_only(spark, tmp_path):
    rows = [
        (0, "a", "Ein Satz. " * 200), (1, "a", "1 note of a foot\nplain text."), (2, "a", " "),
        (3, "a", "Short."), (4, "b", ""), (5, "c", "* a mark\nand a line."),
    ]
    mine, theirs = both(
        spark, tmp_path, "ingestion_report", documents=(rows, "doc_id long, source string, text string")
    )
    assert mine == theirs and len(mine) == 2


def test_guard_ranks_without_chunks_that_share_no_token_slot(spark, tmp_path):
    # the first answer shares no slot with the question, the second one that of its prefix
    turns = [
        (0, 0, "assistant", "passage"), (0, 1, "user", "zebra walks"), (0, 2, "assistant", "query"),
        (0, 4, "assistant", "zebra zebra"),
    ]
    mine, theirs = both(
        spark, tmp_path, "front_page_guard", conversations=(turns, "conv_id long, turn long, role string, text string")
    )
    assert mine == theirs and len(mine) == 3
