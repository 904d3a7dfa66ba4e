"""The driver's contract, and every core query against its SQL on the smallest tables."""

import math
import os
import shutil

import duckdb
import pytest

import __spark_entry__ as entry
from tidepool.plans import catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="the test tables are not here")


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return str(v) if hasattr(v, "isoformat") else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_like_its_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    cursor = duck.execute(catalogue.oracle_sql()[name])
    said = [d[0] for d in cursor.description]
    assert sorted(said) == columns
    want = sorted((tuple(norm(r[said.index(c)]) for c in columns) for r in cursor.fetchall()), key=repr)
    assert sorted((tuple(norm(r[c]) for c in columns) for r in df.collect()), key=repr) == want


def test_contract():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert catalogue.queries().keys() <= entry.queries().keys()


def test_a_threshold_query_has_no_limit(spark):
    plan = entry.queries()["cosine_threshold"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Limit" not in plan


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01"), reason="the test tables are not here")
def test_recency_order_has_all_artifacts(spark):
    sf = "/root/testdata/sf0.01"
    sql = f"SELECT id FROM (SELECT DISTINCT id, last_opened_ms FROM '{sf}/artifacts.parquet') ORDER BY CASE WHEN last_opened_ms > 0 THEN last_opened_ms END DESC NULLS LAST, id"
    want = [r[0] for r in duckdb.sql(sql).fetchall()]
    assert len(want) > 100 and [r["id"] for r in entry.queries()["opened_order"](spark, sf).collect()] == want


def test_kept_tables_are_made_once_and_again_when_removed(spark, tmp_path):
    from tidepool.session import kept, shared_folder

    made = []
    build = lambda path: (made.append(path), spark.range(3).write.parquet(path))
    first = kept(spark, "numbers", ("a",), build)
    assert kept(spark, "numbers", ("a",), build) == first and len(made) == 1 and first.startswith(shared_folder(spark))
    assert kept(spark, "numbers", ("b",), build) != first
    shutil.rmtree(first)
    assert spark.read.parquet(kept(spark, "numbers", ("a",), build)).count() == 3 and len(made) == 3


def test_other_machines_need_a_shared_folder(spark, monkeypatch):
    from tidepool import session

    class Context:
        applicationId, master = "elsewhere", "spark://host:7077"

        class getConf:  # noqa: N801
            get = staticmethod(lambda *a: "")

    class Session:
        sparkContext = Context
        conf = type("C", (), {"get": staticmethod(lambda *a: "")})

    with pytest.raises(RuntimeError, match="checkpoint"):
        session.shared_folder(Session)
