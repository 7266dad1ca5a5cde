"""Snapping against all links, and template starts on days when clocks change."""

import datetime as dt
import math
import random

import pytest
from haltwise.operators import patterns, schedule, snapping

STOP = "stop_id long, x double, y double, stop_mode string"
LINK = "link_id long, link_modes array<string>, geom array<struct<x:double,y:double>>"


def to_line(p, line):
    best = math.inf
    for a, b in zip(line, line[1:]):
        d = (b[0] - a[0], b[1] - a[1])
        size = d[0] ** 2 + d[1] ** 2
        t = 0 if size == 0 else min(1, max(0, ((p[0] - a[0]) * d[0] + (p[1] - a[1]) * d[1]) / size))
        best = min(best, math.dist(p, (a[0] + t * d[0], a[1] + t * d[1])))
    return best


@pytest.mark.parametrize(("seed", "same_mode"), [(1, False), (2, True)])
def test_nearest_links_near_and_far(spark, seed, same_mode):
    rnd = random.Random(seed)
    near = lambda c, r: (c[0] + rnd.uniform(-r, r), c[1] + rnd.uniform(-r, r))
    centres = [(0.0, 0.0), (90_000.0, -40_000.0)]
    links = [(k, rnd.choice([["bus"], ["tram"], ["bus", "tram"]]), [near(c, 3000) for _ in range(rnd.choice([2, 3]))]) for k, c in enumerate(centres * 40)]
    links += [(500, ["bus"], [(-50_000.0, 9.0), (70_000.0, 30_000.0)]), (501, ["bus"], [(7.0, 7.0)])]
    stops = [(k, *near(rnd.choice(centres), rnd.choice([100, 5000, 60_000])), rnd.choice(["bus", "tram", "ferry", None])) for k in range(80)] + [(900, None, 1.0, "bus")]
    got = {r.stop_id: (r.link_id, r.dist) for r in snapping.snap_to_links(spark.createDataFrame(stops, STOP), spark.createDataFrame(links, LINK), cell=200.0, same_mode=same_mode).collect()}
    want = {}
    for s, x, y, mode in stops:
        ds = [(round(to_line((x, y), line), 6), k) for k, modes, line in links if len(line) > 1 and (not same_mode or mode in modes)] if x is not None else []
        if ds:
            want[s] = (min(ds)[1], pytest.approx(min(ds)[0], abs=1e-5))
    assert got == want


def test_starts_when_clocks_change(spark):
    """Seconds from local midnight: on 2020-03-29 an hour is missing, on 2020-10-25 one is twice; a start after midnight meets the next day's."""
    day = lambda m, d: dt.date(2020, m, d)
    members = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 4)], "ttid string, trip_id long")
    trips = spark.createDataFrame([(1, 10, 5 * 3600), (2, 11, 5 * 3600), (3, 12, 29 * 3600), (4, 11, None)], "trip_id long, service_id long, start_s long")
    dates = spark.createDataFrame([(10, [day(3, 28), day(3, 29), day(10, 24), day(10, 25)]), (11, [day(3, 29), day(10, 26)]), (12, [day(3, 27), day(10, 24)])], "service_id long, dates array<date>")
    got = sorted(r.start_ts for r in schedule.template_timestamps(members, trips, dates).collect())
    at = lambda m, d, h: dt.datetime(2020, m, d, h)
    # Midnight is 22:00 UTC of the day before in winter, 21:00 in summer; the trip of 29 hours repeats two of these.
    assert got == sorted({at(3, 28, 3), at(3, 29, 3), at(10, 24, 2), at(10, 25, 2), at(10, 26, 3)})


def test_templates_and_their_pairs(spark):
    times = spark.createDataFrame([(1, 1, 0, 0, True), (1, 2, 50, 55, False), (1, 3, 90, 99, None), (2, 1, 0, 0, True), (2, 2, 60, 65, None), (2, 3, 90, 99, False), (3, 1, 0, 5, None)], "trip_id long, stop_sequence int, arr_diff_s long, dep_diff_s long, timepoint boolean")
    trips = spark.createDataFrame([(1, "p"), (2, "p"), (3, "q"), (4, "q")], "trip_id long, ptid string")
    templates, members = schedule.timepoint_templates(times, trips)
    assert {(r.ttid, tuple(r.stop_seqs), tuple(r.arr_times), tuple(r.dep_times), r.n_trips) for r in templates.collect()} == {("p_1", (1, 3), (0, 90), (0, 99), 2), ("q_1", (1,), (0,), (5,), 1)}
    assert {tuple(r) for r in members.collect()} == {("p_1", 1), ("p_1", 2), ("q_1", 3)}
    assert [tuple(r) for r in schedule.template_stops(templates).collect()] == [("p_1", 1, 3, 0, 90, 90.0)]


def test_stops_near_ends(spark):
    rows = [(1, 7, 0.0, 100.0), (2, 7, 4.0, 96.0), (3, 7, 96.0, 4.0), (4, 7, 50.0, 50.0), (5, 8, 3.0, 3.0), (6, 8, 3.5, 2.5), (7, 99, 1.0, 9.0), (8, 7, None, None)]
    stops = spark.createDataFrame([(k, e, a, b, -1.0, -1.0, "snapped") for k, e, a, b in rows], "stop_id long, edge long, start_dist double, end_dist double, x double, y double, status string")
    edges = spark.createDataFrame([(7, [(0.0, 0.0), (100.0, 0.0)]), (8, [(0.0, 0.0), (0.0, 6.0)])], "edge long, geom array<struct<x:double,y:double>>")
    got = {r.stop_id: (r.start_dist, r.end_dist, r.x, r.y, r.status[-5:]) for r in patterns.snap_near_nodes(stops, edges).collect()}
    same = (-1.0, -1.0, "apped")
    assert got == {1: (0.0, 100.0, *same), 2: (0.0, 100.0, 0.0, 0.0, "start"), 3: (100.0, 0.0, 100.0, 0.0, "e end"), 4: (50.0, 50.0, *same), 5: (0.0, 6.0, 0.0, 0.0, "start"), 6: (6.0, 0.0, 0.0, 6.0, "e end"), 7: (1.0, 9.0, *same), 8: (None, None, *same)}


def test_service_days(spark):
    cal = "service_id long, start_date date, end_date date, sunday boolean, monday boolean, tuesday boolean, wednesday boolean, thursday boolean, friday boolean, saturday boolean"
    d = dt.date
    calendar = spark.createDataFrame([(1, d(2020, 3, 1), d(2020, 3, 10), True, False, False, False, False, False, False), (1, d(2020, 3, 8), d(2020, 3, 9), True, True, None, False, False, False, False), (2, d(2020, 3, 9), d(2020, 3, 1), *[True] * 7), (4, d(2020, 3, 2), d(2020, 3, 2), False, True, *[False] * 5)], cal)
    exceptions = spark.createDataFrame([(1, d(2020, 3, 1), 2), (1, d(2020, 3, 3), 1), (1, d(2020, 3, 3), 1), (3, d(2020, 5, 1), 1), (3, d(2020, 5, 2), 1), (3, d(2020, 5, 2), 2), (4, d(2020, 3, 2), 2), (1, None, 1)], "service_id long, date date, exception_type int")
    got = {r.service_id: r.dates for r in schedule.service_dates(calendar, exceptions).collect()}
    assert got == {1: [d(2020, 3, 3), d(2020, 3, 8), d(2020, 3, 9)], 3: [d(2020, 5, 1)]}
