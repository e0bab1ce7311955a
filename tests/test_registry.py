"""Every query has its SQL twin and agrees with it on the smallest tables, where they are there."""

import math
import os

import pytest

from quarrylight import registry

DATA = os.environ.get("QUARRYLIGHT_DATA", "/root/testdata/sf0.001")
duckdb = pytest.importorskip("duckdb")


def plain(rows):
    return sorted(repr([None if isinstance(v, float) and math.isnan(v) else v for v in r]) for r in rows)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_agrees_with_its_sql(spark, name):
    db = duckdb.connect()
    for f in os.listdir(DATA):
        db.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    got = registry.QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    want = db.sql(f"SELECT {', '.join(columns)} FROM ({registry.SQL[name]})").fetchall()
    assert plain(tuple(r) for r in got.select(*columns).collect()) == plain(want)


def test_selector_lines_of_odd_texts_agree_with_the_sql(spark, tmp_path):
    texts = [
        "ends 10", "0 begins\n1 and 11\n22", "  a  \n b\n", "0\n1\n2\n ", "\u00a0 a\u3000\n\u2003\n\u200b\u2028b ", "a\r\n\tb\t\n", "", " ", "\n\n", None,
        "\n".join(f" {k}{k}" for k in range(12)), *(chr(c) + "a" + chr(c) for c in (0x85, 0x1680, 0x180E, 0x2000, 0x200A, 0x202F, 0x205F, 0xFEFF)),
    ]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = plain(db.sql(registry.SQL["selector_lines"]).fetchall())
    assert plain(tuple(r) for r in registry.QUERIES["selector_lines"](spark, str(tmp_path)).collect()) == want
    ansi = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        assert plain(tuple(r) for r in registry.QUERIES["selector_lines"](spark, str(tmp_path)).collect()) == want
    finally:
        spark.conf.set("spark.sql.ansi.enabled", ansi)


def test_the_rest_stands_without_the_optional_part():
    for folder, _, files in os.walk(os.path.dirname(registry.__file__)):
        if os.path.basename(folder) not in ("llm", "__pycache__") and "/llm" not in folder:
            for f in files:
                if f.endswith(".py"):
                    text = open(os.path.join(folder, f), encoding="utf-8").read()
                    assert "import llm" not in text and ".llm" not in text, f
