import math
import os
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__
from rasterlake.functions import dictionaries, formats
from rasterlake.plans import catalogue

DATA = Path("/root/testdata/sf0.001")
REPO = Path(__file__).parents[1]


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not DATA.exists():
        pytest.skip("no test data")
    con = duckdb.connect()
    for f in DATA.iterdir():
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def shown(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6f}"
    return "[" + ",".join(map(shown, v)) + "]" if isinstance(v, (list, tuple)) else str(v)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, str(DATA))
    columns = sorted(df.columns)
    got = sorted(tuple(shown(r[c]) for c in columns) for r in df.collect())
    found = duck.execute(catalogue.ORACLE_SQL[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(shown(r[names.index(c)]) for c in columns) for r in found.fetchall())


def test_parity_repairs_every_document(spark):
    if not DATA.exists():
        pytest.skip("no test data")
    assert catalogue.reed_solomon_roundtrip(spark, str(DATA)).where("not repaired").count() == 0


def test_entry_and_names(spark):
    assert set(catalogue.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_library_does_without_the_training_data_operators(tmp_path):
    """The entry point imports where the subpackage and the pipeline are not there."""
    for name in ("__spark_entry__.py", "rasterlake"):
        os.symlink(REPO / name, tmp_path / name) if name.endswith(".py") else (tmp_path / name).mkdir()
    for part in (REPO / "rasterlake").iterdir():
        if part.name not in ("llm", "__pycache__"):
            os.symlink(part, tmp_path / "rasterlake" / part.name)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, check=True)


def test_known_answers(spark):
    from pyspark.sql import functions as F

    one = lambda e: spark.range(1).select(e.alias("x")).first()[0]
    lit = F.lit
    assert [one(formats.rational(lit(n), lit(d))) for n, d in ((1, 125), (447106, 1000000), (300, 1), (5, 0), (-6, 3))] == ["1/125", "0.447106", "300", "5/0", "-2"]
    assert one(formats.human_bytes(lit(4096))) == "4.0 KB" and one(formats.human_bytes(lit(2304))) == "2.2 KB" and one(formats.human_bytes(lit(7))) == "7 B"
    assert [one(formats.aspect(lit(w), lit(h))) for w, h in ((8384, 6304), (6000, 4000), (4000, 6000), (1000, 337), (0, 5))] == ["4:3", "3:2", "2:3", "2.97:1", ""]
    assert one(formats.human_date(lit("2018-04-09T19:23:29"))) == "Monday 9 April 2018, 19:23"
    assert one(formats.human_date(lit("2018-13-45T99:99"))) == "2018-13-45T99:99"
    assert one(formats.human_date(lit("2023-02-31T10:00:00"))) == "Friday 31 February 2023, 10:00"
    assert one(formats.tag_label(lit(64321), lit(None).cast("string"))) == "Tag(0xFB41)"
    plan = formats.parity_plan(lit(300), 4, 2, 128)
    assert [one(plan[k]) for k in ("shards", "stripes", "parity_bytes")] == [3, 1, 256]
    assert (formats.parity_for_percent(6), formats.parity_for_percent(0), formats.parity_for_percent(900)) == (2, None, None)
    assert one(F.crc32(lit(b"123456789"))) == 0xCBF43926
    assert len(dictionaries.tag_rows()) == 231
    assert one(formats.type_name(lit(5))) == "RATIONAL" and one(formats.type_name(lit(99))) == "unknown"
