"""Every query that has SQL gives the rows that DuckDB gives."""

import os

import duckdb
import pytest

from folioflow.plans import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    return tuple(map(plain, x)) if isinstance(x, (list, tuple)) else round(x, 6) if isinstance(x, float) else x


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*' if os.path.isdir(path) else path}')")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_like_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    found = duck.execute(SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() >= 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_json_repair_takes_whole_texts(spark, tmp_path):
    import json

    texts = {i: f'line "one" {i}\nline two\n\tend of {i}' for i in range(5)}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in QUERIES["json_repair"](spark, str(tmp_path)).collect():
        got = json.loads(r.json)["areas"][0]["text"]
        assert got == (texts[r.doc_id].replace(" ", "\n") if r.doc_id == 3 else texts[r.doc_id]), r


def test_entry_numbers_of_odd_lines(spark, tmp_path):
    texts = [(3, "12 own\n34. own\n<i\n56 in> 7 a tag\n\n  89 x"), (4, "1\n \n</b\n2> 3 \n4 "), (5, "a\nb"), (5, "c\n5 d\n\ne"), (6, ""), (7, None), (8, "9 "), (9, "</i\n8 b\nc\nd> e")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.doc_id, r.entries, r.total) for r in QUERIES["entry_numbers"](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert got == sorted(con.execute(SQL["entry_numbers"]).fetchall())
