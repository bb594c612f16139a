"""Every registered query against its SQL on the smallest tables."""

import pytest
from oracle import connect, differences

from reefline.catalogue import REGISTRY

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", [n for n, q in REGISTRY.items() if q.sql])
def test_same_rows_as_sql(spark, con, name):
    q = REGISTRY[name]
    assert differences(q.run(spark, FOLDER), con, q.sql) == []


@pytest.mark.parametrize("name", [n for n, q in REGISTRY.items() if not q.sql])
def test_runs_without_sql(spark, name):
    assert REGISTRY[name].run(spark, FOLDER).count() > 0


def test_folders_of_any_name_are_labelled(spark, tmp_path):
    names = ["src3", "src20", "Reef West", "été", None]
    rows = [(k, names[k % 5]) for k in range(50)]
    spark.createDataFrame(rows, "doc_id long, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = REGISTRY["images_labelled_by_folder"].run(spark, str(tmp_path)).collect()
    assert sorted(r["class"] for r in got) == sorted(n for _, n in rows if n)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
