"""Whole queries on a walk whose price reaches the end of doubles: rows equal those of the SQL where prices are infinite and where they are near to it."""

import datetime
import math
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry

NAMES = ("e1_fast_score", "p9_setup_router", "w30_bias_location_trigger", "e5_engine_candidates", "p7_hard_gate")


@pytest.fixture(scope="module")
def risen(tmp_path_factory):
    """Two ticks a bar: view rises to infinity and falls back now and then, error to 1e290 to 1e307, purchase swings."""
    folder, rows, at, dice = tmp_path_factory.mktemp("risen"), [], {"view": 0.0, "error": 0.0, "purchase": 0.0}, random.Random(5)
    for k in range(150):
        up = min(k / 50, 1.0)
        views = [2_750_000.0 * up + (dice.uniform(-20_000, 120_000) if k >= 50 else 0.0) for _ in range(2)]
        errors = [2_740_000.0 * up + dice.gauss(0, 24_000) for _ in range(2)]
        swings = (900 * math.sin(k / 3), 900 * math.sin(k / 3) + 40 * (k % 7 - 3))
        for symbol, totals in (("view", views), ("error", errors), ("purchase", swings)):
            for n, total in enumerate(totals):
                total = round(total, 2)
                rows.append((len(rows), datetime.datetime(2024, 1, 18) + datetime.timedelta(hours=4 * k + n, minutes=7 + len(symbol)), k % 11, symbol, 50 + total - at[symbol], "{}"))
                at[symbol] = total
    names = ("event_id", "ts", "user_id", "event_type", "value", "props")
    schema = pa.schema([("event_id", pa.int64()), ("ts", pa.timestamp("us")), ("user_id", pa.int64()), ("event_type", pa.string()), ("value", pa.float64()), ("props", pa.string())])
    pq.write_table(pa.table(dict(zip(names, map(list, zip(*rows))))).cast(schema), folder / "events.parquet")
    return str(folder)


def _order(row):
    return [(v is not None, str(v) if not isinstance(v, float) else f"{v:.3e}") for v in row]


@pytest.mark.parametrize("name", NAMES)
def test_rows_of_a_walk_to_infinity(spark, risen, name):
    duckdb = pytest.importorskip("duckdb")
    spark.sparkContext.setCheckpointDir(f"{risen}/checkpoints")
    db = duckdb.connect()
    db.execute("SET TimeZone='UTC'")
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{risen}/events.parquet'")
    wanted = db.execute(entry.oracle_sql()[name])
    columns, wanted = [d[0] for d in wanted.description], wanted.fetchall()
    got = [tuple(r) for r in entry.queries()[name](spark, risen).select(*columns).collect()]
    assert wanted and len(got) == len(wanted)
    for g, w in zip(sorted(got, key=_order), sorted(wanted, key=_order)):
        assert [v if not isinstance(v, float) else pytest.approx(v, rel=1e-9, abs=2e-6, nan_ok=True) for v in w] == list(g)
