"""Folds in event order: greedy event clusters and ordered duplicates, and the rollups over them.

A fold walks the rows of a key in order with a small state. Keys are made fine
enough first that no rule crosses them; where a key stays long it is cut in time, and
the state is handed from part to part until nothing changes. Rows are dealt by key, sorted on
disk within the task and streamed past the state, so memory follows the open
events and not the rows of a key.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hazardspark import rules
from hazardspark.operators import chains
from hazardspark.operators.scoring import across, bands, cell, warning_level
from hazardspark.storage import Scratch

AREA_CELL_M = 55_000  # least side of the cells that areas are made of: some 160,000 cover the globe
SLAB_ROWS = 200_000
TRIED_AT_ONCE = 4  # rounds in which all parts are folded whose start changed; afterwards only the first of each session
_KEYS = ["kind", "area", "session", "slab"]
_TOLD = "kind string, area int, session long, slab long, open boolean, report_id long, event_id long, seq int, distance_m double, latitude double, longitude double, t long"


def fold(rows: DataFrame, start: Callable[[], Callable], seconds: int) -> DataFrame:
    """Deal rows by (kind, area, session, slab), sort, and give each report to step(row) of its key's own start().

    Rows with members are events open on entering: they fill step.events before the reports. Told are one row a report and, with `open`, one for each event that is still open after the last.
    """
    names = [x.strip().split()[0] for x in _TOLD.split(",")]

    def run(frames):
        now = step = last = None

        def closing():
            return [(*now, True, e[0], e[0], e[3], 0.0, e[1], e[2], e[4]) for e in step.events if e[4] >= last - seconds] if step else []

        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                key = (row.kind, row.area, row.session, row.slab)
                if key != now:
                    out += closing()
                    now, step, last = key, start(), row.t
                if row.members:
                    step.events.append([row.report_id, row.latitude, row.longitude, row.members, row.t])
                else:
                    out.append((*key, False, *step(row), 0.0, 0.0, 0))
                    last = row.t
            if out:
                yield pd.DataFrame(out, columns=names)
        if step and closing():
            yield pd.DataFrame(closing(), columns=names)

    rows = rows.select(*_KEYS, (F.col("members") == 0).alias("entered"), "t", "report_id", "latitude", "longitude", "members")
    return rows.repartition(*_KEYS).sortWithinPartitions(*_KEYS, "entered", "t", "report_id").mapInPandas(run, _TOLD)


def area_components(cells: dict[tuple[int, int], int], widths: dict[int, int]) -> dict[tuple[int, int], int]:
    """Number of the component of each occupied (band, cell), where cells touch that lie side by side or above each other, corners and the 180th meridian included.

    widths: cells of each band, those of the bands beside occupied ones as well.
    """
    left, number = set(cells), {}

    def beside(y, x):
        for band in (y - 1, y, y + 1):
            n, m = widths[y], widths[band]
            for i in range(x * m // n - 1, -(-(x + 1) * m // n) + 1):
                yield band, i % m

    for i, seed in enumerate(sorted(cells)):
        stack = [seed] if seed in left else []
        left.discard(seed)
        while stack:
            at = stack.pop()
            number[at] = i
            for near in beside(*at):
                if near in left:
                    left.discard(near)
                    stack.append(near)
    return number


def safe_groups(reports: DataFrame, radius_m: float = rules.CLUSTER_RADIUS_M, minutes: int = rules.CLUSTER_MINUTES, most: int = SLAB_ROWS) -> tuple[DataFrame, DataFrame | None]:
    """(rows, slabs): rows(kind, latitude, longitude, t, ..) with area, session and slab; reports of one event always share (kind, area, session).

    An event's centre stays within a radius of its last member, so a joining report is within
    two radii and `minutes` of a member. Areas are components of occupied grid cells, whose side is two radii or more: at most some 160,000 cells
    a type, whatever the input, and only these reach the driver. Sessions split where an area has no
    report for `minutes`, found on its distinct minutes. Sessions are cut in slabs of about `most` rows, between minutes: slabs(kind, area, session, slab, first) has the time
    of each one's first report, or is None where no area has more than `most` rows, so that all slabs are 0.
    """
    spark = reports.sparkSession
    side = max(2.1 * radius_m, AREA_CELL_M)
    rows = reports.withColumn("at", cell(F.col("latitude"), F.col("longitude"), side)).select("*", "at.cy", "at.cx").drop("at").withColumn("minute", F.floor(F.col("t") / 60))
    by_kind: dict[str, dict] = {}
    widths: dict[int, int] = {}
    beside = [across(F.col("cy") + d, bands(side)).alias(f"n{d + 1}") for d in (-1, 0, 1)]
    for r in rows.groupBy("kind", "cy", "cx").count().select("*", *beside).collect():
        by_kind.setdefault(r.kind, {})[r.cy, r.cx] = r["count"]
        widths |= {r.cy - 1: r.n0, r.cy: r.n1, r.cy + 1: r.n2}
    table, sizes = [], {}
    for kind, cells in by_kind.items():
        for (y, x), n in area_components(cells, widths).items():
            table.append((kind, y, x, n))
            sizes[kind, n] = sizes.get((kind, n), 0) + cells[y, x]
    areas = spark.createDataFrame(table, "kind string, cy long, cx long, area int")
    rows = rows.join(F.broadcast(areas), ["kind", "cy", "cx"])
    w = Window.partitionBy("kind", "area").orderBy("minute")
    busy = rows.groupBy("kind", "area", "minute").agg(F.count("*").alias("n"), F.min("t").alias("first"))
    fresh = F.coalesce(F.col("minute") - F.lag("minute").over(w) > minutes, F.lit(True))  # whole minutes between, and so more than `minutes` from report to report
    busy = busy.withColumn("fresh", fresh).withColumn("session", F.sum(F.col("fresh").cast("long")).over(w))
    before = F.sum("n").over(Window.partitionBy("kind", "area", "session").orderBy("minute")) - F.col("n")
    cut = max(sizes.values(), default=0) > most
    busy = busy.withColumn("slab", F.floor(before / most) if cut else F.lit(0).cast("long"))
    placed = rows.join(busy.select("kind", "area", "minute", "session", "slab"), ["kind", "area", "minute"]).drop("cy", "cx", "minute")
    if not cut:
        return placed, None
    w = Window.partitionBy("kind", "area", "session").orderBy("slab")  # numbers without gaps, where one minute fills several
    slabs = busy.groupBy("kind", "area", "session", "slab").agg(F.min("first").alias("first")).withColumn("no", (F.row_number().over(w) - 1).cast("long"))
    placed = placed.join(slabs.select("kind", "area", "session", "slab", "no"), ["kind", "area", "session", "slab"]).drop("slab").withColumnRenamed("no", "slab")
    return placed, slabs.select("kind", "area", "session", F.col("no").alias("slab"), "first")


def _metres(lat: float, lon: float, lats: np.ndarray, lons: np.ndarray) -> np.ndarray:
    a = np.sin(np.radians(lats - lat) / 2) ** 2 + math.cos(math.radians(lat)) * np.cos(np.radians(lats)) * np.sin(np.radians(lons - lon) / 2) ** 2
    return 2 * rules.EARTH_RADIUS_M * np.arcsin(np.sqrt(np.minimum(a, 1.0)))


def _moved(centre: float, n: int, lon: float) -> float:
    """The mean longitude of a centre of n and one more, taken the short way round where they lie across the 180th meridian."""
    lon += 360 if centre - lon > 180 else -360 if lon - centre > 180 else 0
    mean = round((centre * n + lon) / (n + 1), 6)
    return mean - 360 if mean > 180 else mean + 360 if mean < -180 else mean


def greedy(radius_m: float, seconds: int) -> Callable:
    """step(row) -> (report_id, event_id, seq, distance_m): the nearest live event within the radius takes the row, else it starts one.

    The event's centre moves to the mean of its n members and the row; ties go to the smaller event id.
    """
    events: list[list] = []  # [event_id, lat, lon, n, last]

    def step(row):
        events[:] = [e for e in events if e[4] >= row.t - seconds]
        if events:
            d = _metres(row.latitude, row.longitude, np.array([e[1] for e in events]), np.array([e[2] for e in events]))
            best = min(range(len(events)), key=lambda i: (d[i], events[i][0]))
            if d[best] <= radius_m:
                e = events[best]
                e[1], e[2] = round((e[1] * e[3] + row.latitude) / (e[3] + 1), 6), _moved(e[2], e[3], row.longitude)
                e[3], e[4] = e[3] + 1, max(e[4], row.t)
                return row.report_id, e[0], e[3], float(d[best])
        events.append([row.report_id, row.latitude, row.longitude, 1, row.t])
        return row.report_id, row.report_id, 1, 0.0

    step.events = events  # open ones, for callers that keep them elsewhere between rows
    return step


def located(reports: DataFrame) -> DataFrame:
    """Originals that have a type, a time and a finite place."""
    real = lambda c, most: F.abs(F.col(c)) <= most  # noqa: E731  (false for NaN, which is above all numbers)
    return reports.where(real("latitude", 90) & real("longitude", 180) & F.expr("duplicate_of_report_id is null and observed_at is not null and predicted_event_type is not null"))


def cluster(reports: DataFrame, radius_m: float = rules.CLUSTER_RADIUS_M, minutes: int = rules.CLUSTER_MINUTES, most: int = SLAB_ROWS) -> DataFrame:
    """(report_id, event_id, seq, distance_m) of located originals, walked by (observed_at, report_id); an event is named by its first report.

    A task folds about `most` rows (a slab, or one minute of an area where that holds more). A session of several slabs is folded in rounds: all slabs from an empty start, then
    again each whose start differs from the events open at the end of the one before, until none does. The first slab is right at once, and each round
    makes at least the next one right, so the result is that of one walk; mostly few rounds do, as events close.
    """
    seconds = minutes * 60
    rows = located(reports).select(
        "report_id", F.col("predicted_event_type").alias("kind"), "latitude", "longitude", F.unix_seconds(F.col("observed_at").cast("timestamp")).alias("t")
    )
    start = lambda: greedy(radius_m, seconds)
    rows, slabs = safe_groups(rows, radius_m, minutes, most)
    rows = rows.withColumn("members", F.lit(0))
    members = ("report_id", "event_id", "seq", "distance_m")
    if slabs is None:
        return fold(rows, start, seconds).where("not open").select(*members)
    with Scratch(reports.sparkSession) as scratch:
        rows, slabs = scratch.stored(rows), scratch.stored(slabs)
        return scratch.kept(_in_slabs(rows, slabs, start, seconds, scratch).select(*members))


def _in_slabs(rows: DataFrame, slabs: DataFrame, start: Callable, seconds: int, scratch: Scratch) -> DataFrame:
    """The told reports of all slabs at the fixed point. Each round stores what it folded; a slab's last version counts, and only open events are carried on."""
    event = F.struct("event_id", "latitude", "longitude", "seq", "t")
    told = scratch.stored(fold(rows, start, seconds))
    parts, changed_in = [told.where("not open").withColumn("round", F.lit(0))], []
    ends = told.where("open").groupBy(*_KEYS).agg(F.sort_array(F.collect_list(event)).alias("open"))  # open events of a slab, as many as the fold itself holds
    used = None  # (keys, open): starts other than the empty one that slabs were last folded from
    while True:
        alive = F.filter("open", lambda e: e["t"] >= F.col("first") - seconds)
        begins = ends.withColumn("slab", F.col("slab") + 1).join(slabs, _KEYS).select(*_KEYS, alive.alias("open")).where("size(open) > 0")
        changed = begins if used is None else begins.join(used.withColumnRenamed("open", "was"), _KEYS, "full").where("not (open <=> was)").drop("was")
        if len(changed_in) >= TRIED_AT_ONCE:
            w = Window.partitionBy(*_KEYS[:3]).orderBy("slab")
            changed = changed.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")
        changed = scratch.stored(changed)
        if changed.isEmpty():
            break
        entering = changed.select(*_KEYS, F.inline("open")).select(*_KEYS, F.col("event_id").alias("report_id"), "latitude", "longitude", "t", F.col("seq").alias("members"))
        told = scratch.stored(fold(rows.join(changed.select(*_KEYS), _KEYS, "left_semi").unionByName(entering), start, seconds))
        changed_in.append(changed.select(*_KEYS).withColumn("round", F.lit(len(changed_in) + 1)))
        parts.append(told.where("not open").withColumn("round", F.lit(len(changed_in))))
        new_ends = told.where("open").groupBy(*_KEYS).agg(F.sort_array(F.collect_list(event)).alias("open"))
        keys = changed.select(*_KEYS)
        ends = scratch.stored(ends.join(keys, _KEYS, "left_anti").unionByName(new_ends))
        begun = changed.where("open is not null")
        used = scratch.stored(begun if used is None else used.join(keys, _KEYS, "left_anti").unionByName(begun))
    every, versions = parts[0], None
    for part, keys in zip(parts[1:], changed_in):
        every, versions = every.unionByName(part), keys if versions is None else versions.unionByName(keys)
    if versions is None:
        return every
    latest = versions.groupBy(*_KEYS).agg(F.max("round").alias("latest"))
    return every.join(latest, _KEYS, "left").where("round = coalesce(latest, 0)")


def event_rollup(members: DataFrame, assessed: DataFrame) -> DataFrame:
    """An event's type, span, reports, distinct sources, evidence, support and flagged reports, with its levels. assessed has score, support, needs_review."""
    got = members.join(assessed, "report_id").groupBy("event_id").agg(
        F.min("predicted_event_type").alias("event_type"), F.min("observed_at").alias("start_time"), F.max("observed_at").alias("last_updated"), F.count("*").cast("int").alias("report_count"),
        F.count_distinct("source_id").cast("int").alias("source_count"), F.round(F.avg("score"), 4).alias("evidence_score"), F.round(F.avg(F.coalesce("support", F.lit(0.5))), 4).alias("corroboration_score"),
        F.count_if("needs_review").cast("int").alias("flagged_report_count"),
    )
    return warning_level(got.withColumn("status", F.lit("DETECTED"))).drop("status").withColumnRenamed("auto_status", "status")


def event_history(members: DataFrame, assessed: DataFrame) -> DataFrame:
    """An event after each report that it took: running counts, means and the level, by event_id and seq."""
    w = Window.partitionBy("event_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    new = F.row_number().over(Window.partitionBy("event_id", "source_id").orderBy("seq")) == 1
    rows = members.join(assessed, "report_id").withColumn("new", (new & F.col("source_id").isNotNull()).cast("int"))
    got = rows.select(
        "event_id", "seq", "report_id", F.count("*").over(w).cast("int").alias("report_count"), F.sum("new").over(w).cast("int").alias("source_count"),
        F.round(F.avg("score").over(w), 4).alias("evidence_score"), F.sum(F.col("needs_review").cast("int")).over(w).cast("int").alias("flagged_report_count"),
    )
    return warning_level(got.withColumn("status", F.lit("DETECTED"))).withColumnRenamed("warning_level", "level").drop("status").withColumnRenamed("auto_status", "status")


def top_contributors(members: DataFrame, assessed: DataFrame, n: int = 6) -> DataFrame:
    """The n sources with most reports of each event, with their mean score."""
    by = members.join(assessed, "report_id").groupBy("event_id", "source_id").agg(F.count("*").alias("reports"), F.round(F.avg("score"), 4).alias("avg_score"))
    w = Window.partitionBy("event_id").orderBy(F.desc("reports"), "source_id")
    return by.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)


def hash_duplicates(rows: DataFrame, hours: float = 2) -> DataFrame:
    """(report_id, duplicate_of): of rows(report_id, text_hash, t in seconds) each row is an original or copies the original of its hash within the hours before."""
    span = int(hours * 3600)
    rows = rows.where("text_hash is not null")
    with Scratch(rows.sparkSession) as scratch:
        rows = scratch.stored(rows.select("report_id", "text_hash", F.col("t").cast("long").alias("t")))
        stand = chains.orbits(rows.select(F.col("text_hash").alias("key"), "t", F.col("report_id").alias("id")), span, scratch)
        originals = rows.join(stand.select(F.col("id").alias("report_id")), "report_id")
        twins = rows.join(stand.select(F.col("id").alias("report_id")), "report_id", "left_anti")
        found = chains.copies(twins, originals, ["text_hash"], span)
        return scratch.kept(rows.select("report_id").join(found.select("report_id", F.col("target").alias("duplicate_of")), "report_id", "left"))
