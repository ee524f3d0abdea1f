"""Event clusters of a stream: the fold of operators/clustering.py with its open events in a state store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from hazardspark import rules
from hazardspark.operators.clustering import greedy, located

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MEMBERS = "report_id long, event_id long, seq int, distance_m double"
_WAITING = "report_id long, latitude double, longitude double, t long"
_OPEN = "event_id long, latitude double, longitude double, members int, last long"


class _Clusters(StatefulProcessor):
    """Rows wait in the state until the watermark has passed them, and are then taken in the order of (t, report_id), as in a table. An event goes once no row that can still come can join it."""

    def __init__(self, radius_m: float, seconds: int):
        self.radius_m, self.seconds = radius_m, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting, self.open = handle.getListState("waiting", _WAITING), handle.getListState("open", _OPEN)

    def handleInputRows(self, key, rows, timerValues):
        now = timerValues.getCurrentWatermarkInMs()
        new = [(r.report_id, r.latitude, r.longitude, r.t) for r in rows if r.t * 1000 > now]  # later ones would change what was told
        if new:
            self.waiting.appendList(new)
            for t in {r[3] for r in new}:
                self.handle.registerTimer(t * 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = timerValues.getCurrentWatermarkInMs()
        rows = sorted((Row(report_id=r[0], latitude=r[1], longitude=r[2], t=r[3]) for r in self.waiting.get()), key=lambda r: (r.t, r.report_id)) if self.waiting.exists() else []
        due = [r for r in rows if r.t * 1000 <= now]
        if due:
            later = [tuple(r) for r in rows if r.t * 1000 > now]
            self.waiting.put(later) if later else self.waiting.clear()
        step = greedy(self.radius_m, self.seconds)
        step.events.extend([list(e) for e in self.open.get()] if self.open.exists() else [])
        told = [step(r) for r in due]
        left = [tuple(e) for e in step.events if (e[4] + self.seconds) * 1000 >= now]
        if left:
            self.open.put(left)
            self.handle.registerTimer(max(now + 1, (min(e[4] for e in left) + self.seconds) * 1000 + 1))
        else:
            self.open.clear()
        for report_id, event_id, seq, distance in told:
            yield Row(report_id=report_id, event_id=event_id, seq=seq, distance_m=distance)


def clusters(reports: DataFrame, radius_m: float = rules.CLUSTER_RADIUS_M, minutes: int = rules.CLUSTER_MINUTES, late: str = "2 hours", area: Column | None = None) -> DataFrame:
    """(report_id, event_id, seq, distance_m) of located originals of a stream, as cluster() gives for a table.

    A report is told once the watermark, `late` behind the latest report, has passed it; reports that come later than
    that are left out. area: parts of the map that share no event, so that a type isn't one key; reports without a type, a finite place or a time are left out.
    State holds what waits and the open events; both follow the rate of reports, not the length of the stream. Needs the RocksDB state store, which is set here.
    """
    reports.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    rows = located(reports).select(
        F.col("predicted_event_type").alias("kind"), (F.lit("") if area is None else area.cast("string")).alias("area"), "report_id", "latitude", "longitude", "observed_at", F.unix_seconds(F.col("observed_at").cast("timestamp")).alias("t")
    )
    return rows.withWatermark("observed_at", late).groupBy("kind", "area").transformWithState(_Clusters(radius_m, minutes * 60), MEMBERS, "Append", "EventTime")
