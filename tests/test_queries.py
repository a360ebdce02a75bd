"""Every radar query against its SQL over the smallest tables, and the entry points."""

import pathlib
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry_module
from firnlight import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set TimeZone = 'UTC'")
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def rows(frame, columns):
    part = frame[columns].astype(object)
    return sorted(map(repr, part.where(part.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got = catalog.queries()[name](spark, SF).toPandas()
    want = duck.execute(catalog.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns) and len(want)
    assert rows(got, columns) == rows(want, columns)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_gives_rows(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0


def windows_of(plan):
    """Every window of a plan, as (has partition keys, carries arrays)."""
    out, waiting = [], [plan]
    while waiting:
        node = waiting.pop()
        if node.nodeName() == "Window":
            columns = node.output()
            kinds = [columns.apply(i).dataType().typeName() for i in range(columns.size())]
            out.append((not node.partitionSpec().isEmpty(), "array" in kinds))
        children = node.children()
        waiting += [children.apply(i) for i in range(children.size())]
    return out


def test_no_window_gathers_the_samples_of_all_traces(spark):
    """A window without keys in the optimised plan is one task; none may carry samples there."""
    bad = [name for name, q in sorted(catalog.queries().items())
           if any(arrays and not keys for keys, arrays in windows_of(q(spark, SF)._jdf.queryExecution().optimizedPlan()))]
    assert bad == []


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_without_training_data(tmp_path, pipeline):
    """With the llm folders gone, with or without corpus_pipeline.py, the other queries are there."""
    root = pathlib.Path(entry_module.__file__).parent
    shutil.copytree(root / "firnlight", tmp_path / "firnlight", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ["__spark_entry__.py"] + ["corpus_pipeline.py"] * (pipeline and (root / "corpus_pipeline.py").exists()):
        shutil.copy(root / name, tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), 'pipeline' in e.queries())"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True)
    assert out.stdout.split() == [str(len(catalog.queries())), str(len(catalog.oracle_sql())), "False"]
