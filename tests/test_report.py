"""Windows, digests and hostile log lines with hand-computed results."""

import json
from datetime import datetime, timedelta, timezone

import pytest

from fleetpulse.operators import digest as D, readings as R, series as A
from fleetpulse.operators.rules import make_rule
from fleetpulse.plans import report as P
from fleetpulse.schema import EVENT_SCHEMA
from fleetpulse.sources import sample_log, tables

UTC = timezone.utc


def line(ts, readings):
    return json.dumps({"timestamp": ts, "sensors": [
        dict(sensor=s, reading=r, type=t, value=v, min=99.0, max=-99.0, avg=0.5, unit=u) for s, r, t, v, u in readings]})


def write(root, feed, day, lines):
    d = root / feed
    d.mkdir(parents=True, exist_ok=True)
    (d / f"sensors_{day}.jsonl").write_bytes("\n".join(lines).encode() + b"\n")


@pytest.fixture()
def two_days(tmp_path):
    """Two days, two series: one null, a pause of 150 s and a night."""
    rail = [5.0, 5.25, 4.25, 4.0, 5.5, 5.0, 5.125, 4.75]
    temp = [41.0, 43.0, 44.5, 44.0, None, 42.5, 39.5, 46.5]
    first, second = datetime(2026, 3, 3, 10, 0, tzinfo=UTC), datetime(2026, 3, 4, 7, 30, tzinfo=UTC)
    times = [first + timedelta(seconds=s) for s in (0, 15, 30, 180)] + [second + timedelta(seconds=s) for s in (0, 12, 24, 36)]
    recs = [line(t.isoformat(), [("PSU", "+5V", "Voltage", a, "V"), ("PSU", "Temp", "temperature", b, "C")])
            for t, a, b in zip(times, rail, temp)]
    write(tmp_path, "rig", "2026-03-03", recs[:4])
    write(tmp_path, "rig", "2026-03-04", recs[4:])
    return tmp_path


RULE = make_rule(name="dip", kind="threshold", sensor="psu", reading="+5v", op="<", threshold=4.6, clear=4.8, for_samples=2)


def test_two_day_digest(spark, two_days):
    since, until = datetime(2026, 3, 3, tzinfo=UTC), datetime(2026, 3, 5, tzinfo=UTC)
    out = P.report(spark, str(two_days), [RULE], since, until, P.ReportOptions(log_dir="logs")).collect()
    assert len(out) == 1 and out[0].fits
    d = json.loads(out[0].digest)
    assert list(d) == ["schema_version", "meta", "violations", "gaps", "readings"]
    assert d["meta"]["samples"] == 8 and d["meta"]["files_scanned"] == 2 and d["meta"]["series_total"] == 2
    assert [g["seconds"] for g in d["gaps"]] == [150, 77220]  # 10:03:00 to 07:30:00
    rail, temp = d["readings"]
    assert (rail["reading"], rail["first"], rail["last"], rail["min"], rail["max"], rail["avg"], rail["delta"]) == (
        "+5V", 5.0, 4.75, 4.0, 5.5, 38.875 / 8, -0.25)
    assert rail["in_violation"] and not temp["in_violation"]
    assert (temp["type"], temp["samples"], temp["non_finite"], temp["avg"], temp["delta"]) == ("Temperature", 8, 1, 301 / 7, 5.5)
    assert [(v["state"], v["seq"], v["value"], v["samples_in_violation"]) for v in d["violations"]] == [
        ("fired", 1, 4.0, 2), ("cleared", 2, 5.5, 2)]
    assert len(out[0].digest.encode()) == out[0].bytes


def test_sub_window_starts_fresh(spark, two_days):
    since, until = datetime(2026, 3, 3, 10, 2, tzinfo=UTC), datetime(2026, 3, 5, tzinfo=UTC)
    d = json.loads(P.report(spark, str(two_days), [RULE], since, until).collect()[0].digest)
    assert d["meta"]["samples"] == 5 and d["violations"] == []


def test_display_filters_change_nothing_else(spark, two_days):
    since, until = datetime(2026, 3, 3, tzinfo=UTC), datetime(2026, 3, 5, tzinfo=UTC)
    opt = P.ReportOptions(match=["temp"])
    d = json.loads(P.report(spark, str(two_days), [RULE], since, until, opt).collect()[0].digest)
    assert [r["reading"] for r in d["readings"]] == ["Temp"] and d["violations"] == []
    assert d["meta"]["series_total"] == 2 and d["meta"]["truncated"]["violations_total"] == 0
    opt = P.ReportOptions(type_label="Voltage")
    d = json.loads(P.report(spark, str(two_days), [RULE], since, until, opt).collect()[0].digest)
    assert len(d["violations"]) == 2 and d["meta"]["truncated"]["readings_total"] == 1


def naive_fit(d, cap):
    """Drop one item at a time until the text fits; None when it never does."""
    want = json.loads(json.dumps(d))
    t = want["meta"]["truncated"]
    while len(json.dumps(want, separators=(",", ":"))) > cap:
        if want["readings"]:
            want["readings"].pop()
            t["readings_shown"] -= 1
        elif want["gaps"]:
            want["gaps"].remove(min(want["gaps"], key=lambda g: g["seconds"]))
            t["gaps_shown"] -= 1
        elif want["violations"]:
            want["violations"].pop(0)
            t["violations_shown"] -= 1
        else:
            return None
    return want


def test_byte_budget_keeps_the_most_that_fits(spark):
    """Generated parts, many budgets: the running sum equals the one-by-one fit."""
    ev = "feed_id string, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in EVENT_SCHEMA)
    violations = [("f", 1, k, f"r-{k}", "r", "threshold", "warning", "fired", f"t{k}", "s" * k, "x", 1.5 * k, "V", 1.0, k) for k in range(1, 14)]
    gaps = [("f", 0, k, f"a{k}", f"b{k}", s) for k, s in enumerate([31, 500, 31, 77, 1000, 77, 31, 45, 46, 47, 48])]
    row_ddl = "feed_id string, rank long, sensor string, reading string, type string, unit string, samples long, non_finite long, first double, last double, min double, max double, avg double, delta double, in_violation boolean"
    rows = [("f", k, "s", "r" * k, "Fan", "u", 5, 0, 1.0, None, 1.0, 2.0, 1.5, None, k < 3) for k in range(1, 12)]
    meta_ddl = ("feed_id string, first_sample string, last_sample string, series_total long, readings_total long, violations_total long, gaps_total long, "
                "files_scanned long, skipped_lines long, samples long, since string, until string, log_dir string, interval_seconds int, rules_evaluated int")
    meta = [("f", "a", "b", 11, 111, 13, 11, 2, 0, 99, "s", "u", "logs", 10, 1)]
    parts = (
        spark.createDataFrame(meta, meta_ddl), spark.createDataFrame(violations, ev),
        spark.createDataFrame(gaps, "feed_id string, blk long, ord long, from string, to string, seconds long"), spark.createDataFrame(rows, row_ddl))
    full = json.loads(D.assemble(*parts, 100_000).collect()[0].digest)
    assert full["meta"]["truncated"] == dict(readings_shown=11, readings_total=111, violations_shown=13, violations_total=13, gaps_shown=11, gaps_total=11)
    seen = set()
    for cap in [200, 512, 560, 700, 1111, 1500, 1999, 2500, 3000, 3333, 4096, 4500, 5000, 9000]:
        got = D.assemble(*parts, cap).collect()[0]
        want = naive_fit(full, cap)
        assert got.fits == (want is not None)
        if want:
            assert json.loads(got.digest) == want and got.bytes == len(got.digest) <= cap
            seen.add((got.readings_shown, got.gaps_shown, got.violations_shown))
    assert len(seen) > 8


def test_hostile_lines(spark, tmp_path):
    ok = line("2026-03-03T10:00:00+00:00", [("PSU", "NaN rail", "Voltage", 1.0, "V")])
    lines = [
        ok + "\r",
        "",
        '{"timestamp":"2026-03-03T10:00:10Z","sensors":[{"sensor":"PSU","reading":"NaN rail","type":"Voltage","value":NaN,"min":-Infinity,"max":Infinity,"unit":"V"}],"extra":{"a":1}}',
        '{"timestamp":"2026-03-03T10:00:20Z","sensors":[]}',
        "garbage {",
        '{"timestamp":"2026-03-03T10:00:30","sensors":[]}',
        '{"timestamp":"2026-03-03T10:00:30Z"}',
        '{"timestamp":"2026-03-03T10:00:30Z","sensors":[{"sensor":"PSU","reading":"x","type":"Voltage","value":"1.0","unit":"V"}]}',
        '{"timestamp":"2026-03-03T10:00:30Z","sensors":[{"sensor":5,"reading":"x","type":"Voltage","value":1.0,"unit":"V"}]}',
        '{"timestamp":"2026-03-03T10:00:30Z","sensors":[{"sensor":"PSU","reading":"x","value":1.0,"unit":"V"}]}',
        '{"timestamp":"2026-03-03T10:00:30Z","sensors":[]} tail',
        "x" * (4 * 1024 * 1024 + 1),
    ]
    write(tmp_path, "rig", "2026-03-03", lines)
    (tmp_path / "rig" / "sensors_2026-03-03.jsonl").open("ab").write(b'{"timestamp":"2026-03-03T10:00:40Z","sensors":[{"sensor":"\xff"}]}\n')
    (tmp_path / "rig" / "other_2026-03-03.jsonl").write_text(ok)
    samples, parsed = sample_log.scan(spark, str(tmp_path))
    rows = samples.orderBy("blk", "ord").collect()
    assert [r.raw_timestamp for r in rows] == ["2026-03-03T10:00:00+00:00", "2026-03-03T10:00:10Z", "2026-03-03T10:00:20Z"]
    assert sample_log.skipped_lines(parsed).collect()[0].skipped_lines == 9
    flat = R.flatten(samples).orderBy("ord").collect()
    assert [r.reading for r in flat] == ["NaN rail", "NaN rail"] and flat[1].value != flat[1].value and flat[1].min != flat[1].min
    assert R.to_stream(samples).count() == 5


def test_missing_folder_is_empty(spark, tmp_path):
    samples, parsed = sample_log.scan(spark, str(tmp_path / "none"))
    assert samples.count() == 0 and parsed.count() == 0


def test_files_outside_the_padded_window_are_not_read(spark, two_days):
    (two_days / "rig" / "sensors_2026-03-10.jsonl").write_text("garbage\n")
    since = until = datetime(2026, 3, 3, 10, 0, tzinfo=UTC)
    samples, parsed = sample_log.scan(spark, str(two_days), since, until)
    assert samples.count() == 1
    assert parsed.where("problem is not null").count() == 0
    # the later lines were dropped before their readings were parsed
    assert parsed.count() == 1


def test_duplicates_fold_to_the_first(spark, tmp_path):
    recs = [line("2026-03-03T10:00:00Z", [("B", "x", "Fan", 1.0, "a"), ("A", "y", "Fan", 5.0, "a"), ("B", "x", "Power", 2.0, "b")])]
    write(tmp_path, "rig", "2026-03-03", recs)
    samples, _ = sample_log.scan(spark, str(tmp_path))
    folded = R.flatten(R.fold_samples(samples)).orderBy("pos").collect()
    assert [(r.sensor, r.value) for r in folded] == [("B", 1.0), ("A", 5.0)]
    flat = R.fold_rows(R.flatten(samples)).collect()
    assert sorted((r.sensor, r.value) for r in flat) == [("A", 5.0), ("B", 1.0)]
    assert R.export_rows(R.flatten(samples)).count() == 3


def test_gaps_ignore_samples_that_do_not_advance(spark):
    secs = [0, 10, 100, 5, 105, 200]
    rows = [("f", k // 2, k, datetime(2026, 1, 1, tzinfo=UTC) + timedelta(seconds=s), f"t{s}", True) for k, s in enumerate(secs)]
    t = spark.createDataFrame(rows, "feed_id string, blk long, ord long, ts timestamp, raw_timestamp string, available boolean")
    got = [(r["from"], r.to, r.seconds) for r in A.gaps(t, 10).orderBy("ord").collect()]
    assert got == [("t10", "t100", 90), ("t105", "t200", 95)]


def largest_so_far(gaps, keep):
    kept = []
    for g in gaps:
        if len(kept) < keep:
            kept.append(g)
            continue
        low = min(range(keep), key=lambda i: (kept[i][1], i))
        if g[1] > kept[low][1]:
            kept.pop(low)
            kept.append(g)
    return sorted(kept)


def test_largest_gaps_with_ties(spark):
    import random
    rng = random.Random(3)
    rows, want = [], {}
    for f in range(20):
        gs = [(k, rng.choice([40, 50, 60, 70])) for k in range(rng.choice([3, 9, 25]))]
        rows += [(str(f), k // 4, k, s) for k, s in gs]
        want[str(f)] = largest_so_far(gs, 6)
    df = spark.createDataFrame(rows, "feed_id string, blk long, ord long, seconds long")
    got = {}
    for r in A.largest_gaps(df, 6).orderBy("feed_id", "ord").collect():
        got.setdefault(r.feed_id, []).append((r.ord, r.seconds))
    assert got == want


def test_export_round_trip(spark, two_days, tmp_path):
    samples, _ = sample_log.scan(spark, str(two_days))
    out = str(tmp_path / "out")
    assert tables.write_export(R.flatten(samples), out) == {"rows": 16}
    back = tables.read_export(spark, out, "export_rows")
    assert back.columns == ["timestamp", "sensor", "reading", "type", "value", "unit"]
    assert spark.sql("select count(*) n from export_rows where value is null").collect()[0].n == 1
    tables.write_export(R.flatten(samples.where("false")), out)
    assert spark.read.parquet(out).count() == 0 and len(spark.read.parquet(out).columns) == 6


def test_log_round_trip(spark, two_days, tmp_path):
    samples, _ = sample_log.scan(spark, str(two_days))
    root = str(tmp_path / "log")
    tables.write_log(samples, root)
    text = spark.read.text(root)
    assert text.count() == 8 and set(text.columns) == {"value", "feed_id", "dt"}
    from datetime import date
    assert tables.prune_days(spark, root + "/feed_id=rig", 1, date(2026, 3, 5)) == ["dt=2026-03-03"]
    assert spark.read.text(root).count() == 4
