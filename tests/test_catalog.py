"""The registry: names, contracts, plans."""

import os
import re
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check_oracle import TABLES, compare

SF = "/root/testdata/sf0.001"


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 100


def test_entry_returns_rows(spark):
    df = entry.entry(spark)
    assert df.columns == ["site_id", "event_id", "start", "end", "start_pos", "end_pos", "n_days"]
    assert df.count() > 0


@pytest.mark.parametrize("name", ["regrid_daily", "bloom_events", "column_profile", "nearest_event", "layer_rise"])
def test_twins_agree_on_the_smallest_tables(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = entry.queries()[name](spark, SF).toPandas()
    assert compare(got, con.execute(entry.oracle_sql()[name]).df()) == ""


def test_scan_reads_only_what_it_needs(spark, capsys):
    entry.queries()["layer_quantiles"](spark, SF).explain("formatted")
    plan = capsys.readouterr().out
    schemas = re.findall(r"ReadSchema: struct<(.*?)>", plan)
    columns = {c.split(":")[0] for s in schemas for c in s.split(",") if c}
    assert "l_extendedprice" not in columns and "l_orderkey" not in columns
    assert "Exchange SinglePartition" not in plan.split("Subqueries")[0]


@pytest.mark.parametrize("folder", ["gone", "empty"])
def test_entry_loads_without_the_corpus_operators(tmp_path, folder):
    root = os.path.dirname(os.path.abspath(entry.__file__))
    for name in ("catalog", "limnoscope"):
        shutil.copytree(f"{root}/{name}", tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if os.path.exists(f"{root}/{name}"):
            shutil.copy(f"{root}/{name}", tmp_path)
    if folder == "empty":
        (tmp_path / "limnoscope" / "llm").mkdir()
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), 'pipeline' in e.queries())"
    told = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert told.returncode == 0, told.stderr
    assert int(told.stdout.split()[0]) > 100 and told.stdout.split()[2] == "False"
