"""Link traversals: interpolated times at link starts, and what follows from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from haltwise.functions.scalar import add_seconds, kmh, local_time, seconds_between


def by_link():
    return Window.partitionBy("jrnid").orderBy("link_seq")


def forth():
    return by_link().rowsBetween(Window.unboundedPreceding, 0)


def back():
    return by_link().rowsBetween(0, Window.unboundedFollowing)


def edge_points(points: DataFrame) -> DataFrame:
    """First and last time and location on each link of a journey."""
    order = F.struct("tst", "location_on_link")
    return points.groupBy("jrnid", "link_seq").agg(
        F.min("tst").alias("first_tst"), F.min_by("location_on_link", order).alias("first_loc"), F.max("tst").alias("last_tst"), F.max_by("location_on_link", order).alias("last_loc")
    )


def enter_timestamps(points: DataFrame, journey_links: DataFrame) -> DataFrame:
    """Interpolated time t at the start x of every link of a journey, observed or not.

    journey_links: jrnid, link_seq, length_m (all links of the journey's route).
    x0/t0 is the last observation before the link, x1/t1 the first on or after
    it; equal places give no time. All windows share one shuffle by journey.
    """
    links = journey_links.join(edge_points(points), ["jrnid", "link_seq"], "left")
    start = F.sum("length_m").over(forth()) - F.col("length_m")
    placed = links.withColumn("x", start)
    filled = placed.select(
        "jrnid",
        "link_seq",
        "x",
        F.last("last_tst", True).over(forth()).alias("_t0"),
        F.last(F.col("x") + F.col("last_loc") * F.col("length_m"), True).over(forth()).alias("_x0"),
        F.first("first_tst", True).over(back()).alias("t1"),
        F.first(F.col("x") + F.col("first_loc") * F.col("length_m"), True).over(back()).alias("x1"),
    )
    lagged = filled.withColumn("t0", F.lag("_t0").over(by_link())).withColumn("x0", F.lag("_x0").over(by_link()))
    seconds = (F.col("x") - F.col("x0")) * F.try_divide(seconds_between(F.col("t0"), F.col("t1")), F.col("x1") - F.col("x0"))
    return lagged.select("jrnid", "link_seq", "x0", "t0", "x1", "t1", "x", add_seconds(F.col("t0"), seconds).alias("t"))


def links_on_journey(entered: DataFrame, journey_links: DataFrame) -> DataFrame:
    """Enter and exit time of each link that has both; exit is the next link's enter."""
    both = entered.select("jrnid", "link_seq", F.col("t").alias("enter_tst"), F.lead("t").over(by_link()).alias("exit_tst"))
    return both.where(F.col("enter_tst").isNotNull() & F.col("exit_tst").isNotNull()).join(journey_links.select("jrnid", "link_seq", "link_id", "link_reversed"), ["jrnid", "link_seq"])


def traversal_report(traversals: DataFrame, journey_links: DataFrame) -> DataFrame:
    """Traversals found and expected (two fewer than the route's links) by journey."""
    expected = journey_links.groupBy("jrnid").agg((F.count("*") - 2).alias("n_expected"))
    return expected.join(traversals.groupBy("jrnid").agg(F.count("*").alias("n_found")), "jrnid", "left").select("jrnid", "n_expected", F.coalesce("n_found", F.lit(0)).alias("n_found"))


def link_stats(traversals: DataFrame, journeys: DataFrame, links: DataFrame) -> DataFrame:
    """Duration and speed of each traversal, with its journey's fields."""
    local = local_time(F.col("start_tst"))
    seconds = seconds_between(F.col("enter_tst"), F.col("exit_tst"))
    return (
        traversals.join(journeys, "jrnid")
        .join(links.select("link_id", "link_reversed", "length_m"), ["link_id", "link_reversed"])
        .select(
            "jrnid", "route", "dir", F.date_format(local, "yyyy-MM-dd").alias("oday"), F.date_format(local, "HH:mm:ss").alias("start"), "link_seq", "link_id", "link_reversed", "enter_tst", "exit_tst",
            seconds.alias("duration_s"), F.col("length_m").alias("link_length_m"), kmh(F.col("length_m"), seconds).alias("speed_kmh"),
        )
    )


def link_speed_summary(stats: DataFrame) -> DataFrame:
    """Traversals, mean and standard deviation of speed, and metres travelled, by directed link."""
    return stats.groupBy("link_id", "link_reversed").agg(
        F.count("*").alias("n"), F.avg("speed_kmh").alias("mean_speed_kmh"), F.stddev_samp("speed_kmh").alias("sd_speed_kmh"), F.sum("link_length_m").alias("metres")
    )


def section_bounds(section_links: DataFrame) -> DataFrame:
    """First (seq 1) and last directed link of each section."""
    last = section_links.groupBy("section_id").agg(F.max("link_seq").alias("link_seq"))
    i = section_links.where("link_seq = 1").select("section_id", F.col("link_id").alias("i_link_id"), F.col("link_reversed").alias("i_link_reversed"))
    j = section_links.join(last, ["section_id", "link_seq"]).select("section_id", F.col("link_id").alias("j_link_id"), F.col("link_reversed").alias("j_link_reversed"))
    return i.join(j, "section_id")


def section_traversals(traversals: DataFrame, section_links: DataFrame) -> DataFrame:
    """A row for each pair of traversals of a section's first and last link by one journey."""
    b = section_bounds(section_links)
    i = traversals.select("jrnid", F.col("link_id").alias("i_link_id"), F.col("link_reversed").alias("i_link_reversed"), F.col("enter_tst").alias("section_enter_tst"))
    j = traversals.select("jrnid", F.col("link_id").alias("j_link_id"), F.col("link_reversed").alias("j_link_reversed"), F.col("exit_tst").alias("section_exit_tst"))
    pairs = b.join(i, ["i_link_id", "i_link_reversed"]).join(j, ["jrnid", "j_link_id", "j_link_reversed"])
    return pairs.select("section_id", "jrnid", "section_enter_tst", "section_exit_tst", seconds_between(F.col("section_enter_tst"), F.col("section_exit_tst")).alias("section_duration_s"))


def points_combined(raw: DataFrame, on_links: DataFrame) -> DataFrame:
    """Raw points with where they are on a link, if they are."""
    return raw.join(on_links.select("jrnid", "tst", "link_seq", "link_id", "link_reversed", "location_on_link"), ["jrnid", "tst"], "left")


def journey_stats(journeys: DataFrame, combined: DataFrame, journey_links: DataFrame, traversals: DataFrame, halts: DataFrame) -> DataFrame:
    """Counts and times of each journey from its points, links, traversals and halts."""
    local = local_time(F.col("start_tst"))
    points = combined.groupBy("jrnid").agg(
        F.count("tst").alias("n_hfp_point"),
        F.count("link_seq").alias("n_point_on_link"),
        F.min("tst").alias("first_tst"),
        F.max("tst").alias("last_tst"),
        F.sum("represents_time_s").alias("total_represents_s"),
        F.sum(F.when(F.col("link_seq").isNull(), 0.0).otherwise(F.col("represents_time_s"))).alias("on_link_represents_s"),
    )
    count = lambda df, name: df.groupBy("jrnid").agg(F.count("*").alias(name))
    out = journeys.join(count(journey_links, "n_link_on_route"), "jrnid", "left").join(points, "jrnid", "left").join(count(traversals, "n_link_on_journey"), "jrnid", "left").join(count(halts, "n_halt_on_journey"), "jrnid", "left")
    return out.select(
        "jrnid", "route", "dir", F.date_format(local, "yyyy-MM-dd").alias("oday"), F.date_format(local, "HH:mm:ss").alias("start"), "oper", "veh", "n_link_on_route", "n_hfp_point", "n_point_on_link",
        "first_tst", "last_tst", seconds_between(F.col("first_tst"), F.col("last_tst")).alias("total_duration_s"), "total_represents_s", "on_link_represents_s", "n_link_on_journey", "n_halt_on_journey",
    )
