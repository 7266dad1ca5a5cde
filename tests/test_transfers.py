"""Networks and patterns in their last form, dumps, staging, and walks of raw points."""

import datetime as dt
import itertools
import math
import random
import struct
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from haltwise.functions import geometry as g
from haltwise.operators import matching, network, patterns, rawpoints, schedule, validation
from haltwise.sources import readers
from haltwise.sources.store import Store


@pytest.mark.parametrize("seed", range(6))
def test_medians_are_least(seed):
    rnd = random.Random(seed)
    n = rnd.randint(1, 30)
    xs, ys = ([round(rnd.gauss(0, 50), rnd.choice((0, 6))) for _ in range(n)] for _ in "xy")
    if seed % 3 == 0:
        ys = [2 * x for x in xs]  # on one line
    if seed % 3 == 1:
        xs, ys = xs + xs[:1] * n, ys + ys[:1] * n  # half of them at one place
    total = lambda x, y: sum(math.hypot(a - x, b - y) for a, b in zip(xs, ys))
    x, y = rawpoints.geometric_median(xs, ys)
    best = total(x, y)
    for step in (10.0, 1.0, 0.1, 0.01, 0.001):
        assert all(best <= total(x + step * i, y + step * k) + 1e-5 for i, k in itertools.product((-1, 0, 1), repeat=2))
    assert all(best <= total(a, b) + 1e-5 for a, b in zip(xs, ys))


def test_medians_of_many_groups_step_together(spark):
    rnd = random.Random(11)
    groups = [[(round(rnd.gauss(0, 40), rnd.choice((0, 3))), round(rnd.gauss(0, 40), rnd.choice((0, 3)))) for _ in range(rnd.randint(1, 9))] for _ in range(3000)]
    groups += [[(5.0, 5.0)] * 4, [(0.0, 0.0), (2.0, 2.0), (4.0, 4.0)], [(1.0, 1.0)] * 3 + [(9.0, 0.0)] * 3, [(1e9 + i, -1e9) for i in range(5)]]
    at = rawpoints.geometric_medians(*np.concatenate(groups).T, np.array([len(v) for v in groups]))
    for v, x, y in zip(groups, *at):
        total = lambda a, b: sum(math.hypot(p - a, q - b) for p, q in v)  # noqa: E731, B023
        assert total(x, y) <= min(*(total(*p) for p in v), *(total(x + i, y + k) for i in (-0.01, 0, 0.01) for k in (-0.01, 0, 0.01))) + 1e-5
    start = time.process_time()
    rawpoints.geometric_medians(*np.concatenate(groups * 4).T, np.array([len(v) for v in groups * 4]))
    assert time.process_time() - start < 2.5  # a group at a time takes some ten seconds
    rows = [(1, 1, k, *p) for k, p in enumerate([(0.0, 0.0), (3.0, 0.0), (0.0, 4.0)])] + [(1, 2, 9, None, 1.0), (1, 2, 10, 2.0, 1.0), (2, 1, 1, 7.0, 8.0)]
    got = {(r.jrnid, r.odo): r for r in rawpoints.halt_clusters(spark.createDataFrame(rows, "jrnid int, odo int, obs_num int, x double, y double"), 1).collect()}
    assert tuple(got[2, 1].centre) == (7.0, 8.0) and got[1, 2].centre.x is None and (got[1, 1].n_points, got[1, 1].first_obs) == (3, 0)
    assert tuple(got[1, 1].centre) == pytest.approx(rawpoints.geometric_median([0.0, 3.0, 0.0], [0.0, 0.0, 4.0]))
    assert rawpoints.halt_clusters(spark.createDataFrame(rows, "jrnid int, odo int, obs_num int, x double, y double"), 9).count() == 0


def test_walks_of_points_with_nulls_and_many_journeys(spark):
    t0 = dt.datetime(2024, 1, 1)
    rnd = random.Random(3)
    rows = []
    for j in range(40):
        for k in range(rnd.randint(1, 60)):
            x = None if rnd.random() < 0.05 else float(rnd.randint(0, 60) if rnd.random() < 0.9 else 5000)
            rows.append((j, k + 1, t0 + dt.timedelta(seconds=k), rnd.choice([None, k, k + 1]), x, 0.0, None, rnd.choice([None, 3.0]), None, None))
    points = spark.createDataFrame(rows, "jrnid int, obs_num int, tst timestamp_ntz, odo long, x double, y double, dx double, spd double, acc double, dodo double")
    got = {(r.jrnid, r.obs_num): (r.dx, r.spd, r.acc, r.dodo) for r in rawpoints.drop_invalid_movement(points, 28.0, -20.0, 20.0).collect()}
    want = {}
    for _, of in itertools.groupby(rows, key=lambda r: r[0]):
        last = None
        for r in of:
            j, k, t, odo, x, _, dx, spd, acc, dodo = r
            if last is not None:
                lt, lodo, lx, lspd = last
                s = (t - lt).total_seconds()
                dx = abs(x - lx) if x is not None and lx is not None else None
                spd = dx / s if dx is not None else None
                acc = (spd - (lspd or 0.0)) / s if spd is not None else None
                dodo = float(odo - lodo) if odo is not None and lodo is not None else None
                if spd is not None and (spd > 28 or not -20 <= acc <= 20):
                    continue
            want[j, k] = (dx, spd, acc, dodo)
            last = (t, odo, x, spd)
    assert got == want and 100 < len(want) < len(rows)


def test_binary_lines_and_what_is_none(spark):
    rnd = random.Random(1)
    values = [0.0, -0.0, 1.0, -1.5, 5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, 24.9384001, -60.1699] + [rnd.uniform(-180, 180) for _ in range(200)]
    lines = [[(a, rnd.choice(values)) for a in values[i : i + n]] for i in range(0, 180, 7) for n in (1, 2, 5)]
    pack = lambda line, srid: struct.pack("<BI", 1, 0x20000002 if srid else 2) + (struct.pack("<I", srid) if srid else b"") + struct.pack("<I", len(line)) + b"".join(struct.pack("<dd", *p) for p in line)
    rows = [(i, pack(line, rnd.choice((0, 4326))).hex()) for i, line in enumerate(lines)]
    df = spark.createDataFrame([*rows, (-1, None), (-2, ""), (-3, "zz"), (-4, pack([], 0).hex()), (-5, "0101000000" + "00" * 16)], "i int, h string")
    got = {r.i: r.geom and [tuple(p) for p in r.geom] for r in df.select("i", g.parse_line_wkb(F.col("h")).alias("geom")).collect()}
    assert all(got[i] is None for i in range(-5, 0))
    assert all(got[i] == line for i, line in enumerate(lines))


def test_binary_lines_that_are_no_numbers_and_have_ends_of_their_own(spark):
    line = struct.pack("<BIIdddd", 1, 2, 2, math.inf, -math.inf, math.nan, 4.5).hex()
    rows = [(0, line), (1, line + "0a"), (2, line + "00" * 8), (3, line[:-2]), (4, line[:-1] + " "), (5, "00" + line[2:])]
    df = spark.createDataFrame(rows, "i int, h string").repartition(2)
    got = {r.i: r.geom and [tuple(p) for p in r.geom] for r in df.select("i", g.parse_line_wkb(F.col("h")).alias("geom")).collect()}
    assert [got[i] is None for i in range(6)] == [False, False, True, True, True, True]
    assert all(got[i][0] == (math.inf, -math.inf) and math.isnan(got[i][1][0]) and got[i][1][1] == 4.5 for i in (0, 1))
    # Digits are read once a row in batches, not number by number in functions of arrays.
    plan = df.select(g.parse_line_wkb(F.col("h")))._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "conv(" not in plan
    # On the grid they lie where single points and lines of the JVM lie.
    degrees = [(19.0 + i, 59.0 + i * 1.3, 31.5 - i, 70.1 - i) for i in range(9)]
    lines = spark.createDataFrame([(struct.pack("<BIIdddd", 1, 2, 2, *d).hex(), *d) for d in degrees] + [("zz", 0.0, 0.0, 0.0, 0.0)], "h string, a double, b double, c double, d double")
    one = F.array(g.project(F.col("a"), F.col("b")), g.project(F.col("c"), F.col("d")))
    for r in lines.select(g.project_line_wkb(F.col("h")).alias("got"), g.project_line(g.parse_line_wkb(F.col("h"))).alias("jvm"), one.alias("one")).collect():
        flat = lambda v: v and [c for p in v for c in p]
        near = lambda v: pytest.approx(flat(v), abs=1e-7, rel=0)
        assert (r.got is None and r.jvm is None) or (flat(r.got) == near(r.jvm) and flat(r.got) == near(r.one))


def test_dumps_of_streets_and_tracks(spark, tmp_path):
    line = struct.pack("<BIIIdddd", 1, 0x20000002, 4326, 2, 24.9, 60.2, 25.0, 60.3).hex().upper()
    (tmp_path / "bus.csv").write_text(f'fid,osm_id,oneway,highway,lanes,junction,geom\n1,77,yes,primary,1.8,,{line}\n2,78,no,"a, b",,roundabout,"LINESTRING (24.9 60.2, 25.0 60.3)"\n3,,,,x,,\n')
    (tmp_path / "tram.csv").write_text(f"fid,osm_id,tram_segregation_physical,geom\n1,77,yes,{line}\n")
    bus = {r.fid: r for r in readers.street_dump(spark, str(tmp_path / "bus.csv"), "bus").collect()}
    assert [(bus[i].osm_id, bus[i].oneway, bus[i].lanes, bus[i].highway) for i in (1, 2, 3)] == [(77, "FT", 2, "primary"), (78, "FT", None, "a, b"), (None, "B", None, None)]
    assert bus[1].geom == bus[2].geom and len(bus[1].geom) == 2 and bus[3].geom is None
    tram = readers.street_dump(spark, str(tmp_path / "tram.csv"), "tram").first()
    assert (tram.oneway, tram.mode, tram.tram_segregation_physical, tram.geom) == ("B", "tram", "yes", bus[1].geom)
    both = readers.street_dump(spark, str(tmp_path / "bus.csv"), "bus").unionByName(readers.street_dump(spark, str(tmp_path / "tram.csv"), "tram")).where("geom IS NOT NULL")
    edges = network.raw_network(both).orderBy("id").collect()
    assert [(e.id, e.mode, e.oneway, e.reverse_cost == e.cost) for e in edges] == [(1000001, "bus", "FT", False), (1000002, "tram", "B", True), (1000003, "bus", "FT", False)]
    assert len({(e.source, e.target) for e in edges}) == 1


def test_open_versions(spark, tmp_path):
    (tmp_path / "rv.csv").write_text('route_ver_id,route,dir,valid_during,route_mode\na,1,1,"[2020-09-21,)",bus\nb,1,1,"(,2020-09-21]",bus\n')
    got = {r.route_ver_id: (r.valid_from, r.valid_until) for r in readers.route_versions(spark, str(tmp_path / "rv.csv")).collect()}
    assert got == {"a": (dt.date(2020, 9, 21), None), "b": (None, dt.date(2020, 9, 22))}


def test_edges_cut_at_stops(spark):
    edge = "edge long, mode string, oneway string, geom array<struct<x:double,y:double>>"
    edges = spark.createDataFrame([(5, "bus", "FT", [(0.1, 0.2), (3.1, 4.2), (3.1, 14.2)]), (2, "tram", "B", [(3.1, 14.2), (9.0, 14.2)]), (9, "bus", "B", [(9.0, 14.2), (0.1, 0.2)])], edge)
    stops = spark.createDataFrame([(5, 5.0), (5, 5.0), (5, 9.0), (5, 0.0), (5, 15.0), (5, 99.0), (2, None), (7, 1.0)], "edge long, start_dist double")
    links, nodes = schedule.network_links(edges, stops)
    rows = links.orderBy("link_id").collect()
    assert [(r.link_id, r.edge, r.part, r.mode, round(r.cost, 9), round(r.reverse_cost, 9)) for r in rows[:4]] == [(1, 2, 1, "tram", 5.9, 5.9), (2, 5, 1, "bus", 5.0, -1), (3, 5, 2, "bus", 4.0, -1), (4, 5, 3, "bus", 6.0, -1)]
    assert rows[4].edge == 9 and [tuple(p) for p in rows[4].geom] == [(9.0, 14.2), (0.1, 0.2)]
    # Parts meet one another and other edges at nodes: five places, each end at one of them.
    assert nodes.count() == 5 and rows[1].j_node == rows[2].i_node and rows[3].j_node == rows[0].i_node and rows[0].j_node == rows[4].i_node and rows[4].j_node == rows[1].i_node
    empty = schedule.network_links(edges.limit(0), stops)
    assert empty[0].count() == 0 and empty[1].count() == 0


def test_segments_of_good_patterns(spark):
    patterns = spark.createDataFrame([("p", "1", 1, 30.0, "s", []), ("q", "1", 2, 9.0, None, ["No network path"]), ("r", "1", 2, None, None, None)], "ptid string, route string, dir int, nw_len_total double, shape_id string, invalid_reasons array<string>")
    good = schedule.transferred_patterns(patterns)
    assert sorted((r.ptid, r.total_dist, r.gtfs_shape_id) for r in good.collect()) == [("p", 30.0, "s"), ("r", None, None)]
    stops = spark.createDataFrame([("p", 1, 11, 12), ("p", 2, 12, 13), ("p", 3, 13, None), ("q", 1, 1, 2)], "ptid string, stop_seq int, i_stop int, j_stop int")
    paths = spark.createDataFrame([("p", 1, 1, 100, False), ("p", 1, 2, 101, True), ("p", 2, 1, 102, False), ("q", 1, 1, 100, False)], "ptid string, stop_seq int, path_seq int, link_id int, reversed boolean")
    links = spark.createDataFrame([(100, 5.0), (101, 7.0), (102, 2.5)], "link_id int, cost double")
    rows = schedule.transferred_segments(good, stops, paths, links).orderBy("segno").collect()
    assert [(r.ptid, r.segno, r.link_id, r.i_stop, r.j_stop, r.dist_lo, r.dist_hi, r.stop_seq) for r in rows] == [("p", 1, 100, 11, None, 0.0, 5.0, 1), ("p", 2, 101, None, 12, 5.0, 12.0, 1), ("p", 3, 102, 12, 13, 12.0, 14.5, 2)]


def test_staging_holds_one_feed_or_the_one_before(spark, tmp_path):
    def feed(name: str, trip: str) -> str:
        folder = tmp_path / name
        folder.mkdir()
        texts = {"routes": "r,,1,,,0,\n", "calendar": "s,1,1,1,1,1,0,0,20240101,20240131\n", "calendar_dates": "s,20240106,2\n", "shapes": "h,60,25,1,0\n", "trips": f"r,s,{trip},,0,h,,,\n", "stop_times": f"{trip},25:00:00,25:00:10,4,1,,,,,\n", "stops": "4,,n,,60,25,,,,,,,\n"}
        for table, rows in texts.items():
            header = ",".join(c.split()[0] for c in readers.GTFS[table].split(", "))
            (folder / f"{table}.txt").write_text(f"{header}\n{rows}")
        return str(folder)

    store = Store(spark, str(tmp_path / "store"))
    readers.stage_schedule(store, feed("a", "one"))
    readers.stage_schedule(store, feed("b", "two"))
    broken = feed("c", "three")
    (tmp_path / "c" / "calendar.txt").unlink()
    with pytest.raises(Exception, match="calendar"):
        readers.stage_schedule(store, broken)
    assert [r.trip_id for r in store.read("trips").collect()] == ["two"]
    assert [(r.trip_id, r.arrival_s) for r in store.read("stop_times").collect()] == [("two", 90000)]
    assert all(store.read(name).count() == 1 for name in readers.GTFS)


def test_edges_are_cut_once_and_parts_not_shuffled(spark):
    """Parts with their ids, and the nodes by place with what starts and ends there, agree with links joined to numbered nodes."""
    edges = spark.createDataFrame([(k, "bus", "B", [(k * 10.0, 0.0), (k * 10.0 + 10, 0.0), (k * 10.0 + 10, 7.5)]) for k in range(1, 40)], "edge long, mode string, oneway string, geom array<struct<x:double,y:double>>")
    stops = spark.createDataFrame([(k, float(d)) for k in range(1, 60) for d in range(k % 5, 20, 4)], "edge long, start_dist double")
    parts = schedule.network_parts(edges, stops)
    rows = parts.orderBy("edge", "part").collect()
    assert [r.link_id for r in rows] == list(range(1, len(rows) + 1)) and all(r.cost > 0 for r in rows)
    assert len(rows) == 39 + sum(0 < d < 17.5 for k in range(1, 40) for d in range(k % 5, 20, 4))
    links, nodes = schedule.network_links(edges, stops)
    places = {r.node_id: (r.x, r.y) for r in nodes.collect()}
    want = {p: [0, 0] for p in places.values()}
    for r in links.collect():
        want[places[r.i_node]][0] += 1
        want[places[r.j_node]][1] += 1
    assert {(r.x, r.y): [r.n_out, r.n_in] for r in network.ends_at_places(schedule.cut_edges(edges, stops)).collect()} == want
    plan = parts._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("Window")


def test_lines_of_one_street_are_numbered_by_their_places(spark):
    lines = spark.createDataFrame([(1, "bus", "B", [(10.0, 0.0), (20.0, 0.0)]), (1, "bus", "B", [(9.0, 0.0), (10.0, 0.0)])], "osm_id long, mode string, oneway string, geom array<struct<x:double,y:double>>")
    edges = network.raw_network(lines).orderBy("id").collect()
    assert [(e.id, e.geom[0].x, e.source, e.target) for e in edges] == [(1000001, 9.0, 1, 2), (1000002, 10.0, 2, 3)]


def test_days_of_services_by_weekday(spark):
    """Every weekday from every first day, spans of no, one and many days, unknown weekdays, and no function called for each day."""
    days = ("sunday", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday")
    rows = [(f"{k}-{n}", dt.date(2024, 2, 20) + dt.timedelta(k), dt.date(2024, 2, 20) + dt.timedelta(k + n), *[(None if k == 3 else False) if (k * d + n) % 3 else True for d in range(7)]) for k in range(9) for n in (-1, 0, 1, 6, 7, 30)]
    calendar = spark.createDataFrame(rows, "service_id string, start_date date, end_date date, " + ", ".join(f"{d} boolean" for d in days))
    changes = [("0-30", dt.date(2024, 3, 3), 1), ("0-30", dt.date(2024, 2, 21), 2), ("new", dt.date(2025, 1, 1), 1), ("none", dt.date(2025, 1, 1), 2)]
    out = schedule.service_dates(calendar, spark.createDataFrame(changes, "service_id string, date date, exception_type int"))
    want: dict = {}
    for s, lo, hi, *on in rows:
        want[s] = {lo + dt.timedelta(i) for i in range((hi - lo).days + 1) if on[(lo + dt.timedelta(i)).isoweekday() % 7]}
    for kind in (1, 2):
        for s, day, of in changes:
            if of == kind:
                want[s] = want.get(s, set()) | {day} if kind == 1 else want.get(s, set()) - {day}
    assert {r.service_id: r.dates for r in out.collect()} == {s: sorted(d) for s, d in want.items() if d}
    assert "filter(sequence" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_paths_are_worked_out_once_for_a_pair_of_nodes(spark):
    links = spark.createDataFrame([(1, 10, 11, [(0.0, 0.0), (3.0, 4.0)], 5.0), (2, 12, 11, [(3.0, 9.0), (3.0, 4.0)], 5.0)], "link_id int, i_node int, j_node int, geom array<struct<x:double,y:double>>, length_m double")
    nodes = spark.createDataFrame([(10, 12, 1, 10, 1), (10, 12, 2, 11, 2), (10, 12, 3, 12, -1), (11, 10, 1, 11, 1), (11, 10, 2, 10, -1)], "i_node int, j_node int, path_seq int, node_id int, link_id int")
    stops = spark.createDataFrame([(p, 1, 10, 12, 0.0, 0.5) for p in (1, 2, 3)] + [(1, 2, 12, 10, 0.5, 1.0), (1, 3, 10, None, 1.0, None), (2, 2, 12, None, 0.5, None), (3, 2, 11, 10, 0.5, 1.0)], "ptid int, stop_seq int, i_node int, j_node int, i_dist double, j_dist double")
    shapes = spark.createDataFrame([("s", [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0)])], "shape_id string, geom array<struct<x:double,y:double>>")
    pts = spark.createDataFrame([(1, "s"), (2, None), (3, "s")], "ptid int, shape_id string")
    segments = patterns.path_segments(nodes, links)
    per_stop = patterns.pattern_paths(stops, segments)

    def both(f):
        one, other = ({(r.ptid, r.stop_seq): r.asDict(True) for r in f(p).collect()} for p in (segments, per_stop))
        assert one == other and len(one) == 7
        return one

    measured = lambda p: patterns.stop_lengths(patterns.stop_shapes(patterns.path_found(stops, p), pts, shapes), p, links)
    rows = both(lambda p: patterns.check_stops(measured(p)))
    assert {k: (r["path_found"], r["nw_len"], r["shape_len"]) for k, r in rows.items()} == {(1, 1): (True, 10.0, 10.0), (1, 2): (False, None, 10.0), (1, 3): (False, None, None), (2, 1): (True, 10.0, None), (2, 2): (False, None, None), (3, 1): (True, 10.0, 10.0), (3, 2): (True, 5.0, 10.0)}
    assert rows[3, 2]["invalid_reasons"] == ["Network path too short"] and rows[1, 3]["invalid_reasons"] == ["No network path"] and rows[3, 1]["invalid_reasons"] == []
    lines = both(lambda p: patterns.stops_with_geometry(stops, patterns.paths_with_geometry(p, links)))
    assert [tuple(p.values()) for p in lines[2, 1]["geom"]] == [(0.0, 0.0), (3.0, 4.0), (3.0, 9.0)] and lines[1, 2]["geom"] is None
    whole = {r.ptid: r for r in patterns.check_pattern_lengths(patterns.pattern_lengths(patterns.check_stops(measured(segments)))).collect()}
    bad = "Invalid records in stage_gtfs.pattern_stops"
    assert {k: (r.shape_len_total, r.nw_len_total, r.n_invalid, r.invalid_reasons) for k, r in whole.items()} == {1: (20.0, 10.0, 2, [bad, "Network path too short"]), 2: (None, 10.0, 1, [bad]), 3: (20.0, 15.0, 1, [bad, "Network path too short"])}


def test_candidates_by_cells_are_those_of_all_pairs(spark):
    rnd = random.Random(5)
    at = lambda: (rnd.uniform(-900, 900), rnd.choice((rnd.uniform(-900, 900), 0.0, 240.0)))
    lines = [[at() for _ in range(rnd.randint(2, 4))] for _ in range(12)] + [[(240.0, -500.0), (240.0, 500.0)], [(5.0, 5.0), (5.0, 5.0)], [(1.0, 1.0)], [], None]
    links = spark.createDataFrame(list(enumerate(lines)), "link_id int, geom array<struct<x:double,y:double>>")
    route_links = spark.createDataFrame([(k % 3, k, k, k % 2 == 0) for k in range(len(lines))] + [(0, 99, 0, False)], "route_ver_id int, link_seq int, link_id int, link_reversed boolean")
    points = spark.createDataFrame([(i % 6, i, *at()) for i in range(400)] + [(0, 900, None, 1.0), (0, 901, float("nan"), 1.0), (0, 902, 1e300, 1.0)], "jrnid int, tst int, x double, y double")
    journeys = spark.createDataFrame([(j, j % 3) for j in range(6)], "jrnid int, route_ver_id int")
    found = matching.point_candidates(points, journeys, route_links, links, 60.0)
    got = {(r.tst, r.link_seq): (r.link_id, r.location_on_link, r.distance_from_link) for r in found.collect()}
    n = g.nearest(F.col("geom"), g.point(F.col("x"), F.col("y")))
    every = points.join(journeys, "jrnid").join(route_links, "route_ver_id").join(links, "link_id").withColumn("n", n).where("n.distance < 60 AND NOT n.beyond")
    want = {(r.tst, r.link_seq): (r.link_id, abs(r.n.along / r.m - r.link_reversed) if r.m else None, -r.n.distance if r.n.side > 0 else r.n.distance) for r in every.withColumn("m", g.length(F.col("geom"))).collect()}
    assert got == want and len(want) == found.count() > 100
    # Cells are keys of the join: points far from all links of their route make no pairs.
    assert "_cx" in found._jdf.queryExecution().optimizedPlan().toString()


def test_via_nodes_meet_links_without_a_table_of_nodes(spark):
    via = spark.createDataFrame([("a", 1), ("a", 4), ("a", None), ("b", 2), ("c", 9)], "r string, node_id int")
    rows = spark.createDataFrame([("a", 1, 2), ("a", 2, 3), ("b", None, 2), ("b", 5, None), (None, 9, 9)], "r string, i_node int, j_node int")
    out = validation.missed_by_links(via, rows, "r")
    assert sorted(((r.r, r.node_id) for r in out.collect()), key=str) == [("a", 4), ("a", None), ("c", 9)] and out.columns == ["r", "node_id"]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "explode" not in plan


def test_a_feed_is_read_once_where_its_tables_are_kept(spark, tmp_path):
    texts = {
        "routes": "1,,1,,,0,\n2,,2,,,109,\n", "calendar": "s,1,1,1,1,1,0,0,20240101,20240131\nz,1,1,1,1,1,0,0,20240101,20240131\n", "calendar_dates": "s,20240106,2\ns,20240107,2\nz,20240106,2\n", "shapes": "h,60,25,1,0\nh,60,26,2,1\nx,60,25,1,0\n",
        "trips": "1,s,one,,0,h,,,\n1,s,two,,0,h,,,\n1,s,1 B_three,,0,,,,\n2,z,four,,0,x,,,\n", "stop_times": "".join(f"{trip},08:00:0{k},08:00:0{k},{k % 2},{k},,,,,\n" for trip in ("one", "two", "1 B_three", "four") for k in range(4)), "stops": "".join(f"{k},,,,60,25,,,,,,,\n" for k in range(4)),
    }
    for table, rows in texts.items():
        (tmp_path / f"{table}.txt").write_text(",".join(c.split()[0] for c in readers.GTFS[table].split(", ")) + "\n" + rows)
    files = {}

    def keep(name, rows):
        files[name] = {f.rsplit("/", 1)[-1] for f in rows.inputFiles() if f.endswith(".txt")}
        rows.write.parquet(str(tmp_path / "kept" / name))
        return spark.read.schema(rows.schema).parquet(str(tmp_path / "kept" / name))

    kept, plain = readers.gtfs(spark, str(tmp_path), keep), readers.gtfs(spark, str(tmp_path))
    counts = {name: kept[name].count() for name in readers.GTFS}
    assert counts == {"routes": 2, "calendar": 1, "calendar_dates": 2, "shapes": 2, "trips": 3, "stop_times": 12, "stops": 2}
    assert all(sorted(map(str, kept[n].collect())) == sorted(map(str, plain[n].collect())) for n in readers.GTFS)
    assert {n: files[n] for n in ("stop_times", "stops", "shapes", "calendar", "calendar_dates")} == {n: {f"{n}.txt"} for n in ("stop_times", "stops", "shapes", "calendar", "calendar_dates")}
    # Keys that many rows share meet once: a table of few stops isn't joined with all stop times.
    assert "Aggregate" in plain["stops"]._jdf.queryExecution().optimizedPlan().toString()
