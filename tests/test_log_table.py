"""A log of several appends: order, compaction, dropped days, and what is not committed."""

from datetime import date, datetime, timedelta, timezone

from fleetpulse.schema import SAMPLE_SCHEMA
from fleetpulse.sources import log_table, sample_log

UTC = timezone.utc


def samples(spark, feed, start, values):
    rows = []
    for k, v in enumerate(values):
        ts = start + timedelta(minutes=k)
        rows.append((feed, "f", 0, k, ts, ts.isoformat(), True, [("s", "r", "Fan", float(v), 0.0, 0.0, 0.0, "u")]))
    return spark.createDataFrame(rows, SAMPLE_SCHEMA)


def values(spark, root, **window):
    good = sample_log.good_samples(sample_log.parse_lines(log_table.read_log(spark, root, **window)))
    return [(r.feed_id, int(r.sensors[0].value)) for r in good.orderBy("feed_id", "blk", "ord").collect()]


def test_appends_of_a_day_read_in_order_through_compaction_and_pruning(spark, tmp_path):
    root, feed = str(tmp_path / "log"), "rack 1/a+b%"
    assert values(spark, root) == [] and log_table.version(spark, root) == 0
    for k in range(4):
        day = datetime(2026, 2, 18, 3 * k, tzinfo=UTC)
        log_table.append_log(samples(spark, feed, day, range(10 * k, 10 * k + 10)).union(samples(spark, "other", day + timedelta(days=k), [k])), root)
    want = [("other", k) for k in range(4)] + [(feed, v) for v in range(40)]
    assert values(spark, root) == want
    # what was written but not committed does not count
    log_table._write(log_table.record_json(samples(spark, feed, datetime(2026, 2, 18, tzinfo=UTC), [99])), root, 77)
    assert values(spark, root) == want
    assert log_table.compact_day(spark, root, date(2026, 2, 18)) == 5 and values(spark, root) == want
    assert log_table.manifest(spark, root).where("dt = '2026-02-18'").select("append").distinct().count() == 1
    window = {"since": datetime(2026, 2, 20, 12, tzinfo=UTC), "until": datetime(2026, 2, 20, 13, tzinfo=UTC)}
    assert values(spark, root, **window) == [("other", k) for k in (1, 2, 3)]
    assert log_table.drop_days(spark, root, 0, date(2026, 2, 21)) == 5
    log_table.drop_days(spark, root, 2, date(2026, 2, 21))
    assert values(spark, root) == [("other", k) for k in (1, 2, 3)]
    gone = log_table.vacuum(spark, root)
    assert "append=77/dt=2026-02-18" in gone and "append=5/dt=2026-02-18" in gone and "append=2/dt=2026-02-19" not in gone
    assert values(spark, root) == [("other", k) for k in (1, 2, 3)]
    log_table.append_log(samples(spark, "other", datetime(2026, 2, 21, 9, tzinfo=UTC), [7]), root)
    assert values(spark, root) == [("other", k) for k in (1, 2, 3, 7)]
