"""Sessions of a stream over several runs, against one pass over all events."""

import datetime as dt
import json
import random

from loomline.streaming import sessions as s

EVENTS = "event_id long, user string, node string, clock long, at timestamp"


def test_sessions_over_restarts(spark, tmp_path):
    start, rng, rows = dt.datetime(2024, 1, 1), random.Random(3), []
    for user in "abc":
        at, clock = start, 0
        for _ in range(40):
            at += dt.timedelta(minutes=rng.choice([1, 5, 20, 40, 90]))
            clock += rng.randrange(1, 4)
            rows.append((len(rows), user, f"n{rng.randrange(5)}", clock, at))
    rows.sort(key=lambda r: r[4])
    parts = [rows[:50], rows[45:90], rows[90:]]  # five events arrive twice
    parts[1] += [(900, None, "x", 1, start), (901, "a", None, 1, start)]
    parts[2] += [(902, "a", "late", 1, start), (999, "end", "x", 1, rows[-1][4] + dt.timedelta(days=2))]
    (tmp_path / "in").mkdir()
    written = 0
    for k, part in enumerate(parts):
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(json.dumps(dict(zip(("event_id", "user", "node", "clock", "at"), (*r[:4], r[4].isoformat()), strict=True))) for r in part))
        stream = spark.readStream.schema(EVENTS).json(str(tmp_path / "in"))
        s.follow(stream, str(tmp_path / "out"), str(tmp_path / "check"), delay="10 minutes")
        now = spark.read.parquet(str(tmp_path / "out")).count()
        assert now >= written
        written = now
    s.follow(spark.readStream.schema(EVENTS).json(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check"), delay="10 minutes")
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    expected = []
    for user in "abc":
        run = []
        for r in [r for r in rows if r[1] == user]:
            if run and r[4] - run[-1][4] >= dt.timedelta(minutes=30):
                expected.append((user, run))
                run = []
            run.append(r)
        expected.append((user, run))
    want = sorted((u, run[0][4], run[-1][4], len(run), [r[2] for r in sorted(run, key=lambda r: (r[3], r[0]))]) for u, run in expected)
    assert sorted((r["user"], r["began"], r["ended"], r["n_events"], r["path"]) for r in got) == want and written == len(want)
