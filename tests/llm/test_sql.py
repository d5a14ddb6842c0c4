"""The queries with SQL, side by side with it over odd rows."""

import duckdb
import pytest

from quarry.llm import queries

LINE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"
DOCUMENTS = [
    (1, f"Before. {LINE.upper()} after", "a"),
    (2, None, "a"),
    (3, "", None),
    (4, "\x00 -- \t\n", "b"),
    (5, "Ünder die Brücke; ünder", "b"),
    (6, LINE.replace(" ", " "), "c"),
    (7, "short ITEM " * 30, "c"),
    (7, "short ITEM " * 30, "c"),
    (8, LINE.replace("seven", "7") + " 日本語 text " + LINE[4:], "d"),
    (None, "a short item", None),
]
BENCHMARK = [(10, LINE), (9, LINE), (2, "Short item"), (3, None), (4, "..."), (5, "ünder"), (5, "ünder"), (None, "three four")]


@pytest.mark.parametrize("empty", [(), ("documents",), ("benchmark",)])
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql_gives_the_same_rows(spark, tmp_path, name, empty):
    con = duckdb.connect()
    tables = {"documents": (DOCUMENTS, "doc_id long, text string, source string"), "benchmark": (BENCHMARK, "item_id long, text string")}
    for table, (rows, schema) in tables.items():
        spark.createDataFrame([] if table in empty else rows, schema).coalesce(1).write.parquet(str(tmp_path / f"{table}.parquet"))
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    got = queries.queries()[name](spark, str(tmp_path))
    want = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    # a sum of doubles may end in another last digit
    plain = lambda rows: sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows), key=str)
    assert plain(got.select(*names).collect()) == plain(want.fetchall())
