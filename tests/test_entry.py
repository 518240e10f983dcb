"""The entry point with and without what the training-data operators need, folds to the end of the data, and queries whose rows prove something."""

import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidewatch.operators import cohorts

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _names(before):
    code = f"import sys; sys.path.insert(0, {ROOT!r})\n{before}\nimport __spark_entry__ as e\nprint(*sorted(e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True)
    return out.returncode, out.stdout.split(), out.stderr


@pytest.mark.parametrize("missing", ["xxhash", "public_tokenizers", "corpus_pipeline", "tidewatch.llm"])
def test_entry_without_a_library_or_a_folder(missing):
    code, names, _ = _names(f"sys.modules[{missing!r}] = None")
    if missing in ("corpus_pipeline", "tidewatch.llm") and entry.llm_queries is not None:
        # the files are there but can't be imported: an error of their own
        assert code != 0 or not any(n.startswith("op") for n in names)
    else:
        assert code == 0 and "w18_demand_zones" in names and not any(n.startswith("op1_") or n == "pipeline" for n in names)


def test_entry_has_what_it_should():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    if entry.llm_queries is not None:
        assert {f"op{n}" for n in range(1, 14)} == {k.split("_")[0] for k in entry.queries() if k.startswith("op")} - {"o1"} and "pipeline" in entry.queries()


@pytest.mark.parametrize("train, test, embargo", [(100, 30, 5), (50, 50, 0), (1000, 10, 3)])
def test_rolling_folds_reach_the_end(spark, train, test, embargo):
    times = [7 + (k * k) % 613 for k in range(300)]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(times)], "id long, t long")
    got = sorted((x.id, x.fold, x.role) for x in cohorts.rolling_folds(rows, "t", train, test, embargo).collect())
    start, folds = min(times), max(1, -(-(max(times) - min(times) - train - embargo + 1) // test))
    want = [(k, f, "train") for k, t in enumerate(times) for f in range(folds) if 0 <= t - start - f * test < train]
    want += [(k, f, "test") for k, t in enumerate(times) for f in range(folds) if train + embargo <= t - start - f * test < train + embargo + test]
    assert got == sorted(want)
    tested = [k for k, _, role in got if role == "test"]
    assert len(tested) == len(set(tested)) and set(tested) == {k for k, t in enumerate(times) if t - start >= train + embargo}
    assert cohorts.rolling_folds(rows.where("false"), "t", 5, 5, 0).count() == 0


@pytest.mark.parametrize("name", ["w13_breakdown_on_walk", "w14_supply_zone_on_walk", "e6_quality_families_on_walk", "m7_edge_states_to_the_end", "j11_cohort_problems"])
def test_no_compared_column_is_constant(spark, name):
    out = entry.queries()[name](spark, "/root/testdata/sf0.01")
    distinct = out.agg(*(F.count_distinct(F.coalesce(F.col(c).cast("string"), F.lit("null"))).alias(c) for c in out.columns)).first().asDict()
    assert all(n > 1 for n in distinct.values()), distinct
