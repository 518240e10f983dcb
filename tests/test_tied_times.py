"""Ticks that share their times: the first of these opens and closes a bar, so that the bars of the walk and whole queries over them equal the SQL."""

import datetime
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
from tidewatch.plans.scores import _TICKS, _bars_sql, walk

NAMES = ("w27_published_pressure", "e6_quality_families_on_walk")


@pytest.fixture(scope="module")
def tied(tmp_path_factory):
    """Five symbols over 160 bars; a bar has two times with four ticks each, the later written first in the file."""
    folder, rows, dice = tmp_path_factory.mktemp("tied"), [], random.Random(7)
    for k in range(160):
        for s, symbol in enumerate(("click", "error", "purchase", "signup", "view")):
            for minute in (20, 200):
                at = datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=4 * k, minutes=minute + s)
                rows += [(at, dice.randrange(1500), symbol, 50 + round(dice.gauss(-8, 160), 2)) for _ in range(4)]
    rows = [(n, at, user, symbol, value, "{}") for n, (at, user, symbol, value) in enumerate(rows)][::-1]
    names = ("event_id", "ts", "user_id", "event_type", "value", "props")
    schema = pa.schema([("event_id", pa.int64()), ("ts", pa.timestamp("us")), ("user_id", pa.int64()), ("event_type", pa.string()), ("value", pa.float64()), ("props", pa.string())])
    pq.write_table(pa.table(dict(zip(names, map(list, zip(*rows))))).cast(schema), folder / "events.parquet")
    return str(folder)


@pytest.mark.parametrize("step", [900, 14_400, 86_400])
def test_bars_of_ticks_of_one_time(spark, tied, step):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{tied}/events.parquet'")
    wanted = db.execute(f"WITH {_TICKS}, {_bars_sql('bars', step)} SELECT symbol, t, open, high, low, close, volume FROM bars ORDER BY 1, 2").fetchall()
    got = walk(spark, tied, step).selectExpr("symbol", "unix_seconds(ts) AS t", "open", "high", "low", "close", "volume").orderBy("symbol", "t").collect()
    assert wanted and [tuple(r) for r in got] == [(*w[:2], *(pytest.approx(v, abs=2e-4) for v in w[2:])) for w in wanted]


def _order(row):
    return [(v is not None, str(v) if not isinstance(v, float) else f"{v:.3e}") for v in row]


@pytest.mark.parametrize("name", NAMES)
def test_rows_of_ticks_of_one_time(spark, tied, name):
    duckdb = pytest.importorskip("duckdb")
    spark.sparkContext.setCheckpointDir(f"{tied}/checkpoints")
    db = duckdb.connect()
    db.execute("SET TimeZone='UTC'")
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{tied}/events.parquet'")
    wanted = db.execute(entry.oracle_sql()[name])
    columns, wanted = [d[0] for d in wanted.description], wanted.fetchall()
    got = [tuple(r) for r in entry.queries()[name](spark, tied).select(*columns).collect()]
    assert wanted and len(got) == len(wanted)
    for g, w in zip(sorted(got, key=_order), sorted(wanted, key=_order)):
        assert [v if not isinstance(v, float) else pytest.approx(v, rel=1e-9, abs=2e-6, nan_ok=True) for v in w] == list(g)
