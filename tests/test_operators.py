"""Operators on small hand-made cases: gaps, halts, folds, calendars, routing, sources."""

import datetime as dt
import gzip
import re

import pytest
from pyspark.sql import functions as F

from haltwise.functions import geometry as g
from haltwise.operators import halts, matching, network, patterns, rawpoints, routing, schedule, tables, traversal, validation
from haltwise.sources import readers

T0 = dt.datetime(2020, 9, 23, 7, 0, 0)


def at(s):
    return T0 + dt.timedelta(seconds=s)


def test_enter_times_across_a_gap(spark):
    points = spark.createDataFrame([("j", 1, at(0), 0.5), ("j", 3, at(30), 0.5)], "jrnid string, link_seq int, tst timestamp_ntz, location_on_link double")
    links = spark.createDataFrame([("j", 1, 100.0), ("j", 2, 50.0), ("j", 3, 200.0)], "jrnid string, link_seq int, length_m double")
    got = {r.link_seq: r.t for r in traversal.enter_timestamps(points, links).collect()}
    assert got == {1: None, 2: at(30 * 50 / 200), 3: at(30 * 100 / 200)}


def test_equal_places_give_no_time(spark):
    points = spark.createDataFrame([("j", 1, at(0), 1.0), ("j", 2, at(30), 0.0)], "jrnid string, link_seq int, tst timestamp_ntz, location_on_link double")
    links = spark.createDataFrame([("j", 1, 100.0), ("j", 2, 50.0)], "jrnid string, link_seq int, length_m double")
    assert all(r.t is None for r in traversal.enter_timestamps(points, links).collect())


def test_two_halts_on_one_link_merge_unless_strict(spark):
    rows = [(0, 0.2), (5, 0.2), (10, 0.6), (15, 0.6), (20, 0.9)]
    pts = spark.createDataFrame([("j", at(s), 1, loc, True, 5.0) for s, loc in rows], "jrnid string, tst timestamp_ntz, link_seq int, location_on_link double, drst boolean, represents_time_s double")
    assert halts.halts_on_journey(pts).count() == 1 and halts.halts_on_journey(pts, strict=True).count() == 2
    r = halts.halts_on_journey(pts).first()
    assert (r.total_s, r.door_open_s, r.door_closed_s) == (20.0, 20.0, 0.0)


def test_spike_is_dropped_and_next_compared_with_last_kept(spark):
    rows = [(1, 0.0, 0), (2, 5.0, 1), (3, 500.0, 2), (4, 15.0, 3)]
    raw = spark.createDataFrame([("j", n, n, at(s), x, 0.0, n) for n, x, s in rows], "jrnid string, obs_id long, obs_num int, tst timestamp_ntz, x double, y double, odo int")
    got = rawpoints.drop_invalid_movement(rawpoints.movement_values(raw)).orderBy("obs_num").collect()
    assert [r.obs_num for r in got] == [1, 2, 4] and got[-1].spd == pytest.approx(5.0) and got[-1].dodo == 2.0


@pytest.mark.parametrize("visits,left", [([1, 1, 2, 3, 2, 3, 3, 4], [1, 1, 2, 2, 3, 3, 4]), ([2, 2, 2, 1, 1, 2, 3], [1, 1, 3]), ([1, 2, 1, 2], [1, 2, 1, 2])])
def test_failed_visits(spark, visits, left):
    df = spark.createDataFrame([("j", i, s) for i, s in enumerate(visits, 1)], "jrnid string, obs_num int, segno int")
    assert [r.segno for r in rawpoints.discard_failed(df).orderBy("obs_num").collect()] == left


def test_geometric_median():
    assert rawpoints.geometric_median([0.0, 0.0, 10.0], [0.0, 0.0, 0.0]) == pytest.approx((0.0, 0.0), abs=1e-3)
    assert rawpoints.geometric_median([0.0, 2.0], [0.0, 0.0])[0] == pytest.approx(1.0)


def test_service_dates_with_exceptions(spark):
    d = dt.date
    cal = spark.createDataFrame([("s", d(2020, 9, 21), d(2020, 9, 27), False, True, True, True, True, True, False)], "service_id string, start_date date, end_date date, sunday boolean, monday boolean, tuesday boolean, wednesday boolean, thursday boolean, friday boolean, saturday boolean")
    exc = spark.createDataFrame([("s", d(2020, 9, 26), 1), ("s", d(2020, 9, 21), 2)], "service_id string, date date, exception_type int")
    assert schedule.service_dates(cal, exc).first().dates == [d(2020, 9, k) for k in (22, 23, 24, 25, 26)]


def test_greedy_clusters_keep_their_anchor(spark):
    df = spark.createDataFrame([(1, i, float(p)) for i, p in enumerate((0, 6, 12, 18))], "edge int, stop_id long, p double")
    assert [r.grp for r in schedule.greedy_clusters(df, "edge", "p", 10.0).orderBy("stop_id").collect()] == [1, 1, 2, 2]


def test_vianodes_with_missing_nodes(spark):
    rows = spark.createDataFrame([("a", 1, 10, None, None), ("a", 2, 11, 5, 6), ("a", 3, 12, None, None), ("a", 4, 13, 6, 7)], "route_ver_id string, stop_seq int, stop_id long, i_node long, j_node long")
    assert [(r.stop_seq, r.node_id) for r in network.vianodes(rows).orderBy("node_seq").collect()] == [(1, None), (2, 6), (4, 7)]


def test_routing_agrees_with_brute_force(spark):
    import itertools

    edges = [(1, 2, 1.0), (2, 3, 1.0), (1, 3, 2.5), (3, 4, 1.0), (2, 4, 9.0)]
    df = spark.createDataFrame([(i, a, b, c, i, False) for i, (a, b, c) in enumerate(edges)], "uniq_link_id long, i_node long, j_node long, cost double, link_id long, link_reversed boolean")
    pairs = spark.createDataFrame(list(itertools.permutations(range(1, 5), 2)), "i_node long, j_node long")
    got = {(r.i_node, r.j_node): r.cost for r in routing.paths_for_pairs(pairs, df).select("i_node", "j_node", "cost").distinct().collect()}
    assert got == {(1, 2): 1.0, (1, 3): 2.0, (1, 4): 3.0, (2, 3): 1.0, (2, 4): 2.0, (3, 4): 1.0}
    vias = spark.createDataFrame([("ok", 1, 1), ("ok", 2, 2), ("ok", 3, 4), ("same", 1, 1), ("same", 2, 1), ("none", 1, 4), ("none", 2, 1), ("null", 1, 1), ("null", 2, None)], "section_id string, node_seq int, node_id long")
    got = routing.paths_via_nodes(vias, df, "section_id").orderBy("section_id", "link_seq").collect()
    assert [(r.section_id, r.link_id) for r in got] == [("ok", 0), ("ok", 1), ("ok", 3)]


def test_chains_are_contracted(spark):
    links = spark.createDataFrame([(k, k, k + 1) for k in range(1, 9)] + [(20, 5, 50)], "link_id long, i_node long, j_node long")
    got = {r.link_id: r.chain_id for r in routing.contract_chains(links).collect()}
    assert {got[k] for k in (1, 2, 3, 4)} == {1} and {got[k] for k in (5, 6, 7, 8)} == {5} and got[20] == 20


def test_invalidations(spark):
    a = spark.createDataFrame([(1, 5), (2, None)], "k int, v int").withColumn("invalid_reasons", F.lit(None).cast("array<string>"))
    a = rawpoints.invalidate(rawpoints.invalidate(a, "big", F.col("v") > 3), "big", F.col("v") > 3)
    assert {r.k: r.invalid_reasons for r in a.collect()} == {1: ["big"], 2: []}
    b = rawpoints.propagate_invalidations(a, spark.createDataFrame([(1,), (2,)], "k int").withColumn("invalid_reasons", F.array().cast("array<string>")), ["k"], "a")
    assert {r.k: r.invalid_reasons for r in b.collect()} == {1: ["Invalid records in a"], 2: []}


def test_journeys_are_checked_on_import(spark):
    ok = ("681085306edf2862f2f2b69fc053c787", "2510", 1, dt.datetime(2020, 9, 23, 4, 2), 22, 1134)
    rows = [ok, ("f" * 32, *ok[1:]), ("681085306edf2862f2f2b69fc053c788", *ok[1:])]
    j = spark.createDataFrame(rows, "jrnid string, route string, dir int, start_tst timestamp_ntz, oper int, veh int")
    v = spark.createDataFrame([("v", "2510", 1, dt.date(2020, 9, 1), dt.date(2020, 9, 24))], "route_ver_id string, route string, dir int, valid_from date, valid_until date")
    good, bad = matching.check_journeys(j, v)
    assert [r.route_ver_id for r in good.collect()] == ["v"] and bad.count() == 2
    good, bad = matching.check_journeys(j, v.withColumn("valid_until", F.lit(dt.date(2020, 9, 23))))
    assert good.count() == 0 and {r.reason for r in bad.collect()} == {"no route version", "id does not match"}


def test_overlapping_versions(spark):
    d = dt.date
    v = spark.createDataFrame([("a", "1", 1, d(2020, 1, 1), d(2020, 2, 1)), ("b", "1", 1, d(2020, 1, 31), d(2020, 3, 1)), ("c", "1", 1, d(2020, 3, 1), None)], "route_ver_id string, route string, dir int, valid_from date, valid_until date")
    assert [r.route_ver_id for r in validation.overlapping_versions(v).collect()] == ["b"]


def test_readers(spark, tmp_path):
    (tmp_path / "link.csv").write_text('link_id,oneway,link_modes,link_label,data_source,source_date,geom_text\n7,false,"{bus,tram}",x,osm,2020-01-01,"LINESTRING (0 0, 3 4)"\n')
    (tmp_path / "rv.csv").write_text('route_ver_id,route,dir,valid_during,route_mode\nr,1059,1,"[2020-09-21,2020-10-15]",bus\n')
    (tmp_path / "sec.csv").write_text('section_id,description,via_nodes\ns,d,"{214,256}"\n')
    (tmp_path / "stop.csv").write_text("stop_id,stop_radius_m,stop_mode,stop_code,stop_name,stop_place,parent_stop_id,source_date,geom_text\n1,20,bus,c,n,,,2020-01-01,POINT (388045.1 6673900)\n")
    with gzip.open(tmp_path / "raw.csv.gz", "wt") as f:
        f.write("true,VP,1,22,1134,2020-09-23T04:02:00,60.2,25.0,0,,2020-09-23,07:02:00,GPS,,2510\n")
    link = readers.links(spark, str(tmp_path / "link.csv")).first()
    assert link.length_m == 5.0 and link.link_modes == ["bus", "tram"]
    rv = readers.route_versions(spark, str(tmp_path / "rv.csv")).first()
    assert (rv.valid_from, rv.valid_until) == (dt.date(2020, 9, 21), dt.date(2020, 10, 16))
    assert readers.sections(spark, str(tmp_path / "sec.csv")).first().via_nodes == [214, 256]
    assert readers.stops(spark, str(tmp_path / "stop.csv")).first().x == 388045.1
    raw = readers.with_geometry_and_id(readers.raw_positions(spark, str(tmp_path / "raw.csv.gz"))).first()
    assert raw.jrnid == "681085306edf2862f2f2b69fc053c787" and raw.start_tst == dt.datetime(2020, 9, 23, 4, 2)
    readers.write_by_day_and_route(readers.raw_positions(spark, str(tmp_path / "raw.csv.gz")), str(tmp_path / "out"))
    assert list((tmp_path / "out").glob("oday=2020-09-23/route=2510/*.gz"))


def test_stop_link_ref_takes_the_right_side(spark):
    rows = [(1, 0.0, 0.0, 100.0, 0.0)]
    links = spark.createDataFrame(rows, "link_id long, x0 double, y0 double, x1 double, y1 double").withColumn("geom", g.make_line(g.point(F.col("x0"), F.col("y0")), g.point(F.col("x1"), F.col("y1"))))
    links = links.withColumn("oneway", F.lit(False)).withColumn("i_node", F.lit(1)).withColumn("j_node", F.lit(2))
    d = network.directed(links).withColumn("link_modes", F.array(F.lit("bus")))
    stops = spark.createDataFrame([(1, 30.0, -5.0, "bus"), (2, 30.0, 5.0, "bus"), (3, 30.0, 5.0, "tram")], "stop_id long, x double, y double, stop_mode string")
    got = {r.stop_id: (r.link_reversed, round(r.location_on_link, 6)) for r in network.stop_link_refs(stops, d).collect()}
    assert got == {1: (False, 0.3), 2: (True, 0.7)}


def test_tables(spark):
    log = spark.createDataFrame([], "session_id long, ts timestamp, step string, route string, oday date")
    assert tables.log_step(log, 1, "begin").count() == 1


def test_truncate_order_and_tables(spark, tmp_path):
    refs = {"link": ["node"], "node": [], "stop": ["node", "link"], "section": ["node"]}
    order = tables.truncate_order(refs)
    assert all(order.index(a) < order.index(b) for a, others in refs.items() for b in others)
    with pytest.raises(ValueError):
        tables.truncate_order({"a": ["b"], "b": ["a"]})
    for name in refs:
        spark.range(3).write.parquet(str(tmp_path / name))
    assert tables.truncate_tables(spark, str(tmp_path), refs) == order
    assert all(spark.read.parquet(str(tmp_path / name)).count() == 0 for name in refs)


def test_variant_routes_are_added(spark):
    trips = spark.createDataFrame([("1001_a_1", "1001"), ("1001 3_b_1", "1001"), ("1002 1_c_1", "1002")], "trip_id string, route_id string")
    routes = spark.createDataFrame([("1001", 700), ("1002", 0), ("1002 1", 0)], "route_id string, route_type int")
    t, r = readers.variant_routes(trips, routes)
    assert {x.trip_id: x.route_id for x in t.collect()} == {"1001_a_1": "1001", "1001 3_b_1": "1001 3", "1002 1_c_1": "1002 1"}
    assert sorted(map(tuple, r.collect())) == [("1001", 700), ("1001 3", 700), ("1002", 0), ("1002 1", 0)]


def test_streams_give_each_position_once_and_close_sessions(spark, tmp_path):
    from haltwise.streaming import events

    rows = [(True, "VP", "j", at(0)), (True, "VP", "j", at(0)), (False, "VP", "j", at(1)), (True, "DUE", "j", at(2)), (True, "VP", "k", at(7200))]
    schema = "is_ongoing boolean, event_type string, jrnid string, tst timestamp"
    df = spark.createDataFrame(rows, schema)
    df.write.parquet(str(tmp_path / "in"))
    got = events.run_to_end(spark, lambda s: events.ingest(s).select("jrnid", "tst"), str(tmp_path / "in"), df.schema)
    assert sorted(r.jrnid for r in got.collect()) == ["j", "k"]
    done = events.run_to_end(spark, lambda s: events.sessions(s, "jrnid", "tst"), str(tmp_path / "in"), df.schema)
    assert [(r.jrnid, r.n) for r in done.collect()] == [("j", 4)]


def test_stops_grouped_on_an_edge(spark):
    snapped = spark.createDataFrame([(1, 7, 10.0, 90.0, 10.0, 0.0, "snapped"), (2, 7, 16.0, 84.0, 16.0, 0.0, "snapped"), (3, 7, 80.0, 20.0, 80.0, 0.0, "snapped")], "stop_id long, edge int, start_dist double, end_dist double, x double, y double, status string")
    groups = schedule.greedy_clusters(snapped, "edge", "start_dist", 10.0)
    edges = spark.range(1).select(F.lit(7).alias("edge"), g.make_line(g.point(F.lit(0.0), F.lit(0.0)), g.point(F.lit(100.0), F.lit(0.0))).alias("geom"))
    got = {r.stop_id: (r.start_dist, r.end_dist, r.x, r.status) for r in patterns.cluster_stops(snapped, groups, edges).collect()}
    assert got == {1: (13.0, 87.0, 13.0, "grouped"), 2: (13.0, 87.0, 13.0, "grouped"), 3: (80.0, 20.0, 80.0, "snapped")}


@pytest.mark.parametrize("seed", range(40))
def test_equal_costs_go_to_the_smaller_link_list(seed):
    import random

    import numpy as np

    rnd = random.Random(seed)
    edges = [(rnd.randrange(7), rnd.randrange(7), k, float(rnd.choice((0, 1, 1, 2)))) for k in range(18)]
    best: dict = {}

    def walk(node, seen, cost, path):
        best[node] = min(best.get(node, (cost, path)), (cost, path))
        for i, j, link, c in edges:
            if i == node and j not in seen:
                walk(j, seen | {j}, cost + c, (*path, link))

    walk(0, {0}, 0.0, ())
    graph = routing.Graph(*(np.array(x) for x in zip(*edges)))
    assert routing.shortest(graph, 0) == best
    assert routing.shortest(graph, 0, {3, 5, 99}) == {t: best[t] for t in (3, 5) if t in best}


def test_a_closed_edge_is_not_used(spark):
    df = spark.createDataFrame([(1, 1, 2, -1.0), (2, 1, 2, None), (3, 1, 2, 5.0)], "uniq_link_id long, i_node long, j_node long, cost double")
    pairs = spark.createDataFrame([(1, 2)], "i_node long, j_node long")
    assert [(r.cost, r.uniq_link_id) for r in routing.paths_for_pairs(pairs, df).collect()] == [(5.0, 3)]


@pytest.mark.parametrize("same_mode", [False, True])
def test_snapping_at_any_distance_against_brute_force(spark, same_mode):
    import random

    rnd = random.Random(5)
    links = [(k, [(x := rnd.uniform(0, 3000), y := rnd.uniform(0, 3000)), (x + rnd.uniform(-400, 400), y + rnd.uniform(-400, 400))], ["tram"] if k % 5 == 0 else ["bus"]) for k in range(25)]
    stops = [(k, rnd.uniform(-200, 3200), rnd.uniform(-200, 3200), "tram" if k % 3 == 0 else "bus") for k in range(30)]
    stops += [(100, 60_000.0, -40_000.0, "bus"), (101, -9_000.0, 100.0, "tram"), (102, None, 5.0, "bus"), (103, 10.0, 10.0, "ferry")]
    ls = spark.createDataFrame(links, "link_id long, geom array<struct<x: double, y: double>>, link_modes array<string>")
    ss = spark.createDataFrame(stops, "stop_id long, x double, y double, stop_mode string")
    from haltwise.operators import snapping

    def distance(x, y, geom):
        (ax, ay), (bx, by) = geom
        t = min(1, max(0, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / ((bx - ax) ** 2 + (by - ay) ** 2)))
        return ((x - ax - t * (bx - ax)) ** 2 + (y - ay - t * (by - ay)) ** 2) ** 0.5

    want = {}
    for i, x, y, mode in stops:
        fit = [(round(distance(x, y, geom), 3), k) for k, geom, modes in links if not same_mode or mode in modes] if x is not None else []
        if fit:
            want[i] = min(fit)
    got = {r.stop_id: (round(r.dist, 3), r.link_id) for r in snapping.snap_to_links(ss, ls, same_mode=same_mode).collect()}
    assert got == want
    assert snapping.snap_to_links(ss, ls.limit(0)).count() == 0 and snapping.snap_to_links(ss.limit(0), ls).count() == 0


def test_steps_leave_no_tables(spark):
    import pathlib

    from haltwise.operators.chains import smallest_labels
    from haltwise.sources.folders import shared_folder

    folder = pathlib.Path(shared_folder(spark).removeprefix("file:"))
    before = set(folder.iterdir())
    out = smallest_labels(spark.createDataFrame([(k, k + 1) for k in range(1, 20)], "u long, v long"))
    assert {r.label for r in out.collect()} == {1} and len(set(folder.iterdir()) - before) == 1


def test_numbers_are_dense_and_in_order(spark):
    rows = [(k * 37 % 101 - 50.0, k % 7, k) for k in range(200)] + [(None, 1, 900)]
    df = spark.createDataFrame(rows, "x double, y int, k int")
    got = network.numbered(df.repartition(5), "n", F.floor(F.col("x") / 10), "x", "y", "k").collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    assert [(r.x, r.y, r.k) for r in sorted(got, key=lambda r: r.n)] == order and sorted(r.n for r in got) == list(range(1, 202))


def test_import_as_a_job(spark, tmp_path):
    from haltwise.plans import imports

    def journey(name, route, odo):
        return [(name, route, 1, T0, at(k), k, float(odo * k), False, 10.0 * k, 0.0) for k in range(20)]

    raw = spark.createDataFrame(
        journey("good", "1", 10) + journey("still", "1", 0) + journey("unknown", "9", 10),
        "jrnid string, route string, dir int, start_tst timestamp_ntz, tst timestamp_ntz, obs_id long, odo double, drst boolean, x double, y double",
    )
    schedule = spark.createDataFrame([("1", 1, T0, "t1", "p1")], "route string, dir int, start_tst timestamp_ntz, ttid string, ptid string")
    log = {r.step: r for r in imports.run_import(raw, schedule, str(tmp_path), max_acc=20.0).collect()}
    assert {k: (r.status, r.n_rows) for k, r in log.items()} == {"clean": ("done", None), "journeys": ("done", 1), "rejected": ("done", 2), "points": ("done", 20)}
    back = lambda t: spark.read.parquet(f"{tmp_path}/{t}")
    assert [r.jrnid for r in back("journeys").collect()] == ["good"]
    assert {r.jrnid: r.invalid_reasons for r in back("rejected").collect()} == {"unknown": ["NULL ttid"], "still": ["Too little odometer sum vs. cumulative GPS distance"]}
    failed = imports.run_import(raw.drop("odo"), schedule, str(tmp_path)).collect()
    assert [(r.step, r.status) for r in failed] == [("clean", "failed")] and "odo" in failed[0].message
    assert back("import_log").count() == 5 and back("points").count() == 20


def test_section_halt_totals_without_a_shuffle_of_pairs(spark, monkeypatch):
    """Links twice on a section, two halts at a place, null times; broadcast and plain give the same, and the pairs are not shuffled."""
    from haltwise.operators import halts

    h = spark.createDataFrame([(1, 10, 4.0, 1.0, 2.0, 3.0), (1, 20, 8.0, 2.0, 4.0, None), (2, 10, 6.0, None, 3.0, 5.0)], "jrnid long, tst long, total_s double, door_open_s double, door_closed_s double, represents_time_s double")
    p = spark.createDataFrame([(1, 10, 7, True), (1, 20, 7, True), (2, 10, 8, False)], "jrnid long, tst long, link_id long, link_reversed boolean")
    s = spark.createDataFrame([(1, 7, True), (1, 7, True), (1, 8, True), (2, 8, False), (2, 7, True), (3, 9, True)], "section_id long, link_id long, link_reversed boolean")
    want = [(1, 1, 6.0, 12.0, 18.0), (2, 1, 3.0, 6.0, 9.0), (2, 2, 0.0, 3.0, 1.0)]
    out = halts.section_halt_totals(h, p, s)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, out.collect())) == want and "hashpartitioning(section_id#" in plan and not re.search(r"hashpartitioning\(section_id#\w+, jrnid", plan)
    monkeypatch.setattr(halts, "BROADCAST_PLACES", 0)
    assert sorted(map(tuple, halts.section_halt_totals(h, p, s).collect())) == want


def test_section_halt_totals_in_blocks_and_as_many_tasks_as_pairs(spark, monkeypatch):
    """Places beyond a broadcast go in blocks of journeys: pairs are not shuffled then either, and a task has its share of them only."""
    from haltwise.operators import halts

    h = spark.createDataFrame([(j, 10 * k, 4.0 + k, 1.0, 2.0, 3.0) for j in range(20) for k in range(3)], "jrnid long, tst long, total_s double, door_open_s double, door_closed_s double, represents_time_s double")
    p = spark.createDataFrame([(j, 10 * k, (j + k) % 6, True) for j in range(20) for k in range(3)], "jrnid long, tst long, link_id long, link_reversed boolean")
    s = spark.createDataFrame([(n, (n + k) % 6, True) for n in range(30) for k in range(n % 4)], "section_id long, link_id long, link_reversed boolean")
    whole = sorted(map(tuple, halts.section_halt_totals(h, p, s).collect()))
    monkeypatch.setattr(halts, "BROADCAST_PLACES", 25)
    monkeypatch.setattr(halts, "SECTION_TASKS", 1)
    monkeypatch.setattr(halts, "TASK_PAIRS", 10, raising=False)
    out = halts.section_halt_totals(h, p, s)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, out.collect())) == whole and len(whole) > 100
    assert "BroadcastHashJoin" in plan and not re.search(r"hashpartitioning\(section_id#\w+, jrnid", plan)
    # 429 pairs by link, three blocks: 15 tasks, which go through the blocks or are there for each.
    assert out.rdd.getNumPartitions() in (15, 45)


def test_stops_of_sections_are_written_compactly(spark):
    """Rows of one link lie together, so the stops that they meet are alike from row to row; all rows are there."""
    from haltwise.operators import network

    s = spark.range(400).selectExpr("id AS section_id", "CAST(1 AS INT) AS link_seq", "(id * 7919) % 16 AS link_id", "true AS link_reversed", "CAST(10 AS DOUBLE) AS length_m").coalesce(1)
    stops = spark.range(16 * 500).selectExpr("xxhash64(id) AS stop_id", "id % 16 AS link_id", "true AS link_reversed", "CAST(0.5 AS DOUBLE) AS location_on_link", "named_struct('x', CAST(id % 16 AS DOUBLE), 'y', 0D) AS place").coalesce(1)
    for out in (network.section_stop_points(s, stops), network.section_stop_places(s, stops)):
        links = [r.section_id * 7919 % 16 for r in out.select("section_id").collect()]
        assert len(links) == 400 * 500 and sum(a != b for a, b in zip(links, links[1:])) < 16 * 4
