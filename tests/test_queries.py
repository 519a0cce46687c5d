"""Every query of the library proper against its SQL on the smallest data."""

from __future__ import annotations

import pytest
from compare import SF, rows, sql_rows

from sagebeam.plans import registry


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_agrees_with_sql(spark, name):
    if name not in registry.oracle_sql():
        pytest.skip("SQL cannot express it")
    frame = registry.queries()[name](spark, SF)
    names, want = sql_rows(registry.oracle_sql()[name], SF)
    assert sorted(frame.columns) == names
    assert rows(frame) == want


def test_entry_is_the_flagship(spark):
    import __spark_entry__

    frame = __spark_entry__.entry(spark)
    assert frame.columns == ["case_id", "rank", "record_id", "score", "n_matched", "margin"]
    assert frame.count() > 0


def test_top_k_is_cut_before_the_window(spark):
    plan = registry.queries()["rarity_rank_top4"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan


def test_entry_is_imported_without_a_session():
    """In a process of its own, as the driver does it; every query has SQL but those of trained models."""
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    said = "import __spark_entry__ as e; print(len(e.queries()) >= len(e.oracle_sql()) > 90)"
    assert subprocess.run([sys.executable, "-c", said], cwd=root, capture_output=True, text=True, timeout=120).stdout.strip() == "True"
