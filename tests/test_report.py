"""The batch report covers every section and writes plain files."""

import subprocess
import sys

from conftest import ROOT, SF

from tallyline.plans.report import SECTIONS, batch_report, write_report


def test_sections_name_their_tables(ol):
    tables = batch_report(ol, ["freight", "losses"])
    assert set(tables) == {f"{s}/{n}" for s in ("freight", "losses") for n in SECTIONS[s]}


def test_written_tables_can_be_read(spark, ol, tmp_path):
    write_report(ol.select("*"), str(tmp_path), ["description", "losses"])
    back = spark.read.option("header", True).csv(str(tmp_path / "losses" / "loss_orders"))
    assert back.count() > 0 and "item_number" in back.columns


def test_workers_need_no_installed_package(tmp_path):
    """Python workers started elsewhere still run the package's functions."""
    code = f"""
import sys; sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
from __spark_entry__ import queries
spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()
for name in ('forecast_daily', 'anova_test', 'recommend_freight_price'):
    assert queries()[name](spark, {SF!r}).count() > 0
    queries()[name](spark, {SF!r}).write.format('noop').mode('overwrite').save()
"""
    env = {"PATH": __import__("os").environ["PATH"], "HOME": str(tmp_path)}
    java = __import__("os").environ.get("JAVA_HOME")
    done = subprocess.run(
        [sys.executable, "-c", code], cwd=tmp_path, env={**env, **({"JAVA_HOME": java} if java else {})},
        capture_output=True, text=True, timeout=280,
    )
    assert done.returncode == 0, done.stderr[-2000:]
