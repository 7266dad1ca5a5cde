"""Schedules: service days, stop times, stop patterns, templates and segment times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haltwise.functions import geometry as g
from haltwise.operators.network import LINKS_AT_ONCE, nodes_of_links, numbered
from haltwise.operators.rawpoints import split_invalid
from haltwise.operators.walks import walk

WEEKDAYS = ("sunday", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday")


def service_dates(calendar: DataFrame, exceptions: DataFrame) -> DataFrame:
    """service_id and its days in order: weekdays within the calendar's span, plus added days, less removed ones.

    calendar: service_id, start_date, end_date, one boolean per weekday;
    exceptions: service_id, date, exception_type (1 added, 2 removed).
    """
    # A service's spans and exceptions meet in one row of arrays; no row a day is made.
    spans = calendar.where("start_date <= end_date").groupBy("service_id").agg(F.collect_list(F.struct(F.to_date("start_date").alias("lo"), F.to_date("end_date").alias("hi"), F.array(*WEEKDAYS).alias("on"))).alias("spans"))
    kind = lambda k: F.array_distinct(F.collect_list(F.when(F.col("exception_type") == k, F.to_date("date"))))
    changes = exceptions.groupBy("service_id").agg(kind(1).alias("added"), kind(2).alias("removed"))
    none = F.array().cast("array<date>")

    def weekly(s: Column, k: int) -> Column:
        """The days of one weekday within a span: every seventh from the first, so that no day is looked at by itself."""
        first = F.date_add(s["lo"], F.pmod(F.lit(k + 1) - F.dayofweek(s["lo"]), F.lit(7)))
        return F.when(F.get(s["on"], F.lit(k)) & (first <= s["hi"]), F.sequence(first, s["hi"], F.expr("interval 7 days"))).otherwise(none)

    days = lambda s: F.flatten(F.array(*[weekly(s, k) for k in range(7)]))
    regular = F.coalesce(F.flatten(F.transform("spans", days)), none)
    dates = F.sort_array(F.array_except(F.array_union(regular, F.coalesce("added", none)), F.coalesce("removed", none)))
    # As an array's element, so that the days are worked out once, not for the test of their number too.
    some = F.explode(F.filter(F.array(dates), lambda d: F.size(d) > 0))
    return spans.join(changes, "service_id", "full").where("service_id IS NOT NULL").select("service_id", some.alias("dates"))


def fix_direction(trips: DataFrame) -> DataFrame:
    """Directions 0 and 1 become 1 and 2, if the table has just these."""
    span = trips.agg(F.min("direction_id").alias("_lo"), F.max("direction_id").alias("_hi"))
    shift = F.when((F.col("_lo") == 0) & (F.col("_hi") <= 1), 1).otherwise(0)
    return trips.join(F.broadcast(span)).withColumn("direction_id", F.col("direction_id") + shift).drop("_lo", "_hi")


def trips_with_dates(trips: DataFrame, stop_times: DataFrame, dates: DataFrame) -> DataFrame:
    """Trips with their first departure (seconds) and service days, where they have them."""
    first = stop_times.groupBy("trip_id").agg(F.min_by("departure_s", "stop_sequence").alias("first_departure_s"))
    return trips.join(first, "trip_id", "left").join(dates, "service_id", "left")


def normalized_stop_times(stop_times: DataFrame) -> DataFrame:
    """Arrival and departure relative to the trip's first departure, and the share of the shape's length."""
    w = Window.partitionBy("trip_id")
    start = F.min("departure_s").over(w)
    share = F.try_divide(F.col("shape_dist"), F.max("shape_dist").over(w))
    return stop_times.select("trip_id", "stop_sequence", "stop_id", (F.col("arrival_s") - start).alias("arr_diff_s"), (F.col("departure_s") - start).alias("dep_diff_s"), share.alias("rel_dist"))


def stop_patterns(stop_times: DataFrame, order: tuple[str, ...] = ()) -> DataFrame:
    """Trips grouped by identical stop sequences: pattern number, stops, trips. Numbers follow the sequences' order."""
    seq = F.transform(F.array_sort(F.collect_list(F.struct("stop_sequence", *order, "stop_id"))), lambda r: r["stop_id"])
    trips = stop_times.groupBy("trip_id").agg(seq.alias("stops"))
    return trips.groupBy("stops").agg(F.count("*").alias("n_trips"), F.min("trip_id").alias("first_trip"))


def pattern_ids(patterns: DataFrame, route: str = "route", direction: str = "dir") -> DataFrame:
    """ptid: route, direction and number within them, numbered in a total order."""
    n = F.row_number().over(Window.partitionBy(route, direction).orderBy("first_trip"))
    return patterns.withColumn("ptid", F.concat_ws("_", route, direction, n))


def pattern_stops(patterns: DataFrame, key: str) -> DataFrame:
    """Patterns unnested: key, stop_seq, stop_id."""
    return patterns.select(key, F.posexplode("stops").alias("_p", "stop_id")).select(key, (F.col("_p") + 1).alias("stop_seq"), "stop_id")


def unique_stop_pairs(rows: DataFrame, key: str) -> DataFrame:
    """Consecutive stops of all patterns, once, with the number of patterns that have them."""
    w = Window.partitionBy(key).orderBy("stop_seq")
    pairs = rows.select(key, F.col("stop_id").alias("i_stop"), F.lead("stop_id").over(w).alias("j_stop")).where(F.col("j_stop").isNotNull())
    return pairs.groupBy("i_stop", "j_stop").agg(F.count_distinct(key).alias("n_patterns"), F.count("*").alias("n"))


def pattern_segments(path_links: DataFrame, key: str = "ptid") -> DataFrame:
    """Segments of patterns: number, span of distance from the start, and whether first or last. path_links: key, stop_seq, path_seq, link_id, length_m."""
    w = Window.partitionBy(key).orderBy("stop_seq", "path_seq")
    end = F.sum("length_m").over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = path_links.select(key, F.row_number().over(w).alias("segno"), "link_id", (end - F.col("length_m")).alias("dist_lo"), end.alias("dist_hi"))
    n = F.max("segno").over(Window.partitionBy(key))
    return out.withColumn("is_first", F.col("segno") == 1).withColumn("is_last", F.col("segno") == n)


def transferred_patterns(patterns: DataFrame) -> DataFrame:
    """Patterns that nothing speaks against, as schedules have them: ptid, route, dir, total_dist, gtfs_shape_id."""
    good, _ = split_invalid(patterns)
    return good.select("ptid", "route", "dir", F.col("nw_len_total").alias("total_dist"), F.col("shape_id").alias("gtfs_shape_id"))


def transferred_segments(patterns: DataFrame, stops: DataFrame, paths: DataFrame, links: DataFrame) -> DataFrame:
    """Segments of the given patterns in order, with the stops at their ends where there are any.

    stops: ptid, stop_seq, i_stop, j_stop; paths: ptid, stop_seq, path_seq, link_id, reversed; links: link_id, cost.
    A stop pair's first segment has its first stop, its last one the second. One shuffle by pattern serves all windows.
    """
    rows = paths.join(patterns.select("ptid"), "ptid", "left_semi").join(stops.select("ptid", "stop_seq", "i_stop", "j_stop"), ["ptid", "stop_seq"]).join(links.select("link_id", "cost"), "link_id")
    w = Window.partitionBy("ptid").orderBy("stop_seq", "path_seq")
    end = F.sum("cost").over(w.rowsBetween(Window.unboundedPreceding, 0))
    closes = F.coalesce(F.lead("stop_seq").over(w) != F.col("stop_seq"), F.lit(True))
    return rows.select(
        "ptid", F.row_number().over(w).alias("segno"), "link_id", "reversed", F.when(F.col("path_seq") == 1, F.col("i_stop")).alias("i_stop"), F.when(closes, F.col("j_stop")).alias("j_stop"),
        (end - F.col("cost")).alias("dist_lo"), end.alias("dist_hi"), "stop_seq",
    )


def trip_templates(trips: DataFrame, times: DataFrame) -> DataFrame:
    """Trips of one pattern with the same time differences, as templates: number, times, and start timestamps as (date, second)."""
    arr = F.transform(F.array_sort(F.collect_list(F.struct("stop_sequence", "dep_diff_s"))), lambda r: r["dep_diff_s"])
    by_trip = times.groupBy("trip_id").agg(arr.alias("diffs"))
    n = F.row_number().over(Window.partitionBy("ptid").orderBy("diffs"))
    joined = trips.join(by_trip, "trip_id").groupBy("ptid", "diffs").agg(F.count("*").alias("n_trips"), F.sort_array(F.collect_set("start_s")).alias("starts"))
    return joined.withColumn("ttid", F.concat_ws("_", "ptid", n))


def timepoint_templates(times: DataFrame, trips: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(templates: ttid, ptid, stop_seqs, arr_times, dep_times, n_trips; members: ttid, trip_id).

    Trips of one pattern with equal times at their time points are one template; a trip's last stop is a time
    point too. times: trip_id, stop_sequence, arr_diff_s, dep_diff_s, timepoint; trips: trip_id, ptid, each once.
    """
    last = F.col("stop_sequence") == F.max("stop_sequence").over(Window.partitionBy("trip_id"))
    at = times.withColumn("_tp", F.coalesce("timepoint", F.lit(False)) | last).where("_tp")
    points = F.array_sort(F.collect_list(F.struct("stop_sequence", "arr_diff_s", "dep_diff_s")))
    by_trip = at.groupBy("trip_id").agg(points.alias("points")).join(trips.select("trip_id", "ptid"), "trip_id")
    n = F.row_number().over(Window.partitionBy("ptid").orderBy("points"))
    found = by_trip.groupBy("ptid", "points").agg(F.count("*").alias("n_trips")).withColumn("ttid", F.concat_ws("_", "ptid", n))
    column = lambda c: F.transform("points", lambda p: p[c])
    templates = found.select("ttid", "ptid", column("stop_sequence").alias("stop_seqs"), column("arr_diff_s").alias("arr_times"), column("dep_diff_s").alias("dep_times"), "n_trips")
    return templates, by_trip.join(found.select("ttid", "ptid", "points"), ["ptid", "points"]).select("ttid", "trip_id")


def template_stops(templates: DataFrame) -> DataFrame:
    """Pairs of successive time points: ttid, i_stop_seq, j_stop_seq, i_dep_s, j_arr_s and the seconds between."""
    pair = lambda i: F.struct(*[F.get(c, i + d).alias(name) for name, c, d in (("i_stop_seq", "stop_seqs", 0), ("j_stop_seq", "stop_seqs", 1), ("i_dep_s", "dep_times", 0), ("j_arr_s", "arr_times", 1))])
    pairs = templates.where(F.size("stop_seqs") > 1).select("ttid", F.explode(F.transform(F.sequence(F.lit(0), F.size("stop_seqs") - 2), pair)).alias("p")).select("ttid", "p.*")
    return pairs.withColumn("ij_seconds", (F.col("j_arr_s") - F.col("i_dep_s")).cast("double"))


def template_timestamps(members: DataFrame, trips: DataFrame, dates: DataFrame, zone: str = "Europe/Helsinki") -> DataFrame:
    """(ttid, start_ts): when trips of a template start, once each, in UTC.

    trips: trip_id, service_id, start_s; dates: service_id, dates. A start is so many seconds after
    the day's local midnight, also on days when clocks change. Trips that start alike share their days: each
    template and second has its services' days once before they become rows.
    """
    alike = members.join(trips.select("trip_id", "service_id", "start_s"), "trip_id").where("start_s IS NOT NULL").select("ttid", "start_s", "service_id").distinct()
    days = alike.join(dates.select("service_id", "dates"), "service_id").groupBy("ttid", "start_s").agg(F.array_distinct(F.flatten(F.collect_list("dates"))).alias("days"))
    rows = days.select("ttid", "start_s", F.explode("days").alias("day"))
    midnight = F.convert_timezone(F.lit(zone), F.lit("UTC"), F.col("day").cast("timestamp_ntz"))
    return rows.select("ttid", (midnight + F.make_interval(secs=F.col("start_s"))).alias("start_ts")).distinct()


def segment_times(segments: DataFrame, spans: DataFrame, strict: bool = False) -> DataFrame:
    """Seconds of each segment by its share of the span between two time points.

    segments: ptid, segno, dist_lo, dist_hi; spans: ttid, ptid, seg_lo, seg_hi
    (half open), i_s, j_s. As existing results have it, the share is of the
    distance from the pattern's start to the span's end and the end time lacks
    the span's offset; strict spreads over the span itself.
    """
    w = Window.partitionBy("ttid", "seg_lo")
    rows = spans.join(segments, "ptid").where((F.col("segno") >= F.col("seg_lo")) & (F.col("segno") < F.col("seg_hi")))
    top, low = F.max("dist_hi").over(w), F.min("dist_lo").over(w)
    base = low if strict else F.lit(0.0)
    part = lambda c: (F.col("j_s") - F.col("i_s")) * F.try_divide(c - base, top - base)
    end = part(F.col("dist_hi")) + (F.col("i_s") if strict else F.lit(0.0))
    return rows.select("ttid", "segno", (F.col("i_s") + part(F.col("dist_lo"))).alias("enter_s"), end.alias("exit_s"))


def trips_view(templates: DataFrame, zone: str = "Europe/Helsinki") -> DataFrame:
    """One row per template and start, with the local day and clock. templates: ttid, starts (UTC timestamps)."""
    rows = templates.select("ttid", F.explode("starts").alias("start_ts"))
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), F.col("start_ts"))
    return rows.withColumn("oday", F.to_date(local)).withColumn("start", F.date_format(local, "HH:mm:ss"))


def greedy_clusters(stops: DataFrame, edge: str, place: str, tolerance: float) -> DataFrame:
    """Stops of an edge in order; one farther than the tolerance from its group's first stop opens a new group."""

    def step(state: tuple | None, r: dict) -> tuple[tuple, tuple]:
        anchor, n = state or (None, 0)
        if anchor is None or (r["p"] is not None and r["p"] > anchor + tolerance):
            anchor, n = r["p"], n + 1
        return (anchor, n), (r["edge"], r["stop_id"], n, anchor)

    rows = stops.select(F.col(edge).alias("edge"), F.col(place).cast("double").alias("p"), F.col("stop_id").cast("long").alias("stop_id"))
    kind = stops.schema[edge].dataType.simpleString()
    return walk(rows, "edge", ["p", "stop_id"], step, f"edge {kind}, stop_id long, grp int, anchor double").withColumnRenamed("edge", edge)


def split_links(links: DataFrame, cuts: DataFrame) -> DataFrame:
    """Parts of links between cuts (link_id, share strictly inside): link_id, part, lo, hi; uncut links are one part."""
    inside = cuts.where((F.col("share") > 0) & (F.col("share") < 1)).select("link_id", "share").distinct()
    marks = links.select("link_id", F.lit(0.0).alias("share")).unionByName(inside.join(links.select("link_id"), "link_id", "left_semi"))
    w = Window.partitionBy("link_id").orderBy("share")
    return marks.select("link_id", F.row_number().over(w).alias("part"), F.col("share").alias("lo"), F.coalesce(F.lead("share").over(w), F.lit(1.0)).alias("hi"))


def _bordered(edges: DataFrame, stops: DataFrame) -> DataFrame:
    """edges with the marks of their line, the metres at which parts begin and end, and how many parts there are. An edge meets its stops in one row."""
    marked = stops.where("start_dist > 0").groupBy(F.col("edge").alias("_e")).agg(F.collect_set(F.col("start_dist").cast("double")).alias("_at"))
    lines = edges.where("edge IS NOT NULL").join(marked, F.col("edge") == F.col("_e"), "left").drop("_e").withColumn("_marks", g.marks(F.col("geom")))
    lines = lines.withColumn("_m", F.element_at("_marks", -1)["at"])
    none = F.array().cast("array<double>")
    cuts = F.array_sort(F.filter(F.coalesce("_at", none), lambda d: d < F.col("_m")))
    return lines.withColumn("_borders", F.concat(F.array(F.lit(0.0)), cuts, F.array("_m"))).withColumn("_size", F.size("_borders") - 1).drop("_at", "_m")


def _pieces(lines: DataFrame, *kept: str) -> DataFrame:
    """The kept columns, part (from 1) and geom of each part of bordered lines. Parts end exactly in the line's own ends."""
    line, points, n = F.col("geom"), F.col("_marks"), F.col("_size")
    # Each place of a cut is worked out once, for the part before it and the one behind it.
    cuts = F.transform(F.slice("_borders", 2, n - 1), lambda m: g.at_metres(points, m))
    lines = lines.withColumn("_ends", F.when(n > 1, F.concat(F.array(g.start_point(line)), cuts, F.array(g.end_point(line)))))

    def piece(low: Column, i: Column) -> Column:
        return F.struct((i + 1).alias("part"), F.concat(F.slice("_ends", i + 1, F.lit(1)), g.inner_points(points, low, F.get("_borders", i + 1)), F.slice("_ends", i + 2, F.lit(1))).alias("geom"))

    whole = F.array(F.struct(F.lit(1).alias("part"), line.alias("geom")))
    parts = F.when(n == 1, whole).otherwise(F.transform(F.slice("_borders", 1, n), piece))
    return lines.select(*kept, F.explode(parts).alias("_p")).select(*kept, "_p.part", "_p.geom")


def cut_edges(edges: DataFrame, stops: DataFrame) -> DataFrame:
    """Edges cut where stops are, without ids: edge, part, geom. edges: edge, geom; stops: edge, start_dist (metres along it)."""
    return _pieces(_bordered(edges.select("edge", "geom"), stops), "edge")


def network_parts(edges: DataFrame, stops: DataFrame) -> DataFrame:
    """Links from edges cut where stops are: link_id, edge, part, mode, cost, reverse_cost (-1: closed), geom.

    edges: edge (each once), mode, oneway (FT: along it only), geom; stops: edge, start_dist (metres along it). Ids are dense,
    those of one edge in a row. An edge is numbered before it is cut, by how many parts it has, so parts are never shuffled.
    """
    ids = numbered(_bordered(edges.select("edge", "mode", "oneway", "geom"), stops), "_first", F.floor(F.col("edge") / LINKS_AT_ONCE), "edge", size="_size")
    rows = _pieces(ids, "_first", "edge", "mode", "oneway").withColumn("cost", g.length(F.col("geom")))
    reverse_cost = F.when(F.col("oneway") == "FT", -1.0).otherwise(F.col("cost"))
    return rows.select((F.col("_first") + F.col("part") - 1).alias("link_id"), "edge", "part", "mode", "cost", reverse_cost.alias("reverse_cost"), "geom")


def network_links(edges: DataFrame, stops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links, nodes) of a network whose edges are cut where stops are: `network_parts` with i_node and j_node, and the nodes at their ends."""
    return nodes_of_links(network_parts(edges, stops))
