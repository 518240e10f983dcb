"""Whole queries on a walk whose price falls to 0 and goes up and down there: no job stops, and rows equal those of the SQL."""

import datetime
import math

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry

NAMES = ("e1_fast_score", "e6_quality_families_on_walk", "p10_filter_actions", "p17_market_regime", "p21_preferred_zone", "p6_model_gate", "p9_setup_router", "w14_supply_zone_on_walk", "w15_support_room_two_frames", "w27_published_pressure", "w29_bottom_risk", "w30_bias_location_trigger", "p11_scanner_status", "p16_tiers", "p7_hard_gate", "w31_zone_confirmation", "e14_rule_quality", "e5_engine_candidates", "t6_settled_by_timers")


@pytest.fixture(scope="module")
def fallen(tmp_path_factory):
    """Two ticks a bar: view falls from 100 to 0 in 60 bars and then closes at 0 in two of three, purchase swings."""
    folder, rows, at = tmp_path_factory.mktemp("fallen"), [], {"view": 0.0, "purchase": 0.0}
    for k in range(130):
        low = -1000.0 * k if k < 60 else -60_000.0 - 100 * (k % 5)
        views = (low, low - 500) if k < 60 else (-52_000.0, low) if k % 3 else (low, -52_000.0)
        swings = (900 * math.sin(k / 3), 900 * math.sin(k / 3) + 40 * (k % 7 - 3))
        for symbol, totals in (("view", views), ("purchase", swings)):
            for n, total in enumerate(totals):
                total = round(total, 2)
                rows.append((len(rows), datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=4 * k + n, minutes=7 + len(symbol)), k % 11, symbol, 50 + total - at[symbol], "{}"))
                at[symbol] = total
    names = ("event_id", "ts", "user_id", "event_type", "value", "props")
    pq.write_table(pa.table(dict(zip(names, map(list, zip(*rows))))).cast(pa.schema([("event_id", pa.int64()), ("ts", pa.timestamp("us")), ("user_id", pa.int64()), ("event_type", pa.string()), ("value", pa.float64()), ("props", pa.string())])), folder / "events.parquet")
    return str(folder)


def _order(row):
    return [(v is not None, str(v) if not isinstance(v, float) else f"{v:.3e}") for v in row]


@pytest.mark.parametrize("name", NAMES)
def test_rows_of_a_walk_to_zero(spark, fallen, name):
    duckdb = pytest.importorskip("duckdb")
    spark.sparkContext.setCheckpointDir(f"{fallen}/checkpoints")
    db = duckdb.connect()
    db.execute("SET TimeZone='UTC'")
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{fallen}/events.parquet'")
    wanted = db.execute(entry.oracle_sql()[name])
    columns, wanted = [d[0] for d in wanted.description], wanted.fetchall()
    got = [tuple(r) for r in entry.queries()[name](spark, fallen).select(*columns).collect()]
    assert wanted and len(got) == len(wanted)
    for g, w in zip(sorted(got, key=_order), sorted(wanted, key=_order)):
        assert [v if not isinstance(v, float) else pytest.approx(v, rel=1e-9, abs=2e-6, nan_ok=True) for v in w] == list(g)
