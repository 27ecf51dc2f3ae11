"""The lead run: extracts, combine, scores and leads, with marks and repeatable writes."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from zealmark.functions.columns import hours_before, parse_as_of
from zealmark.operators import dwell as dw
from zealmark.operators import touchpoints as tp
from zealmark.operators.catalog import Content, Dims, content
from zealmark.operators.combine import STAGES, combine, stamp_actions, touchpoint
from zealmark.operators.hot_keys import HOT_ROWS
from zealmark.operators.leads import leads
from zealmark.operators.scoring import lead_scores
from zealmark.schemas import METRICS, TABLES, enforce_schema
from zealmark.session import job_scratch, side_by_side, stage_all
from zealmark.sources import state
from zealmark.sources.versions import VersionedTable


@dataclass
class Sources:
    """Frames of the platform's tables."""

    actions: DataFrame
    views: DataFrame
    session_events: DataFrame
    checkins: DataFrame
    checkin_notes: DataFrame
    users: DataFrame
    details: DataFrame
    applications: DataFrame
    dims: Dims


def extracts(
    src: Sources, track_join: str = "left", user_match: str = "inner", hot_rows: int | None = None
) -> dict[str, DataFrame]:
    """The seven touchpoint extracts over whatever facts ``src`` holds.

    Times are the events' own, so a look back by hours cuts where it says.
    What two extracts share (item counts, dwell
    per item, the content) is grouped first and stored. With ``hot_rows`` items of more rows are split.
    """
    about = content(src.dims, track_join)
    shared = stage_all(
        {
            "bookmarked": tp.item_counts(src.actions, "bookmarkButton"),
            "viewed": tp.item_counts(src.views, "item"),
            "dwelt": dw.dwell_per_item(dw.event_dwell(src.views, src.session_events)),
            "sessions": about.sessions,
            "speakers": about.speakers,
        }
    )
    about = Content(shared["sessions"], shared["speakers"], hot_rows)
    return {
        "bookmarks": tp.bookmarked_sessions(shared["bookmarked"], about),
        "views": tp.viewed_sessions(shared["viewed"], about),
        "speaker_bookmarks": tp.bookmarked_speakers(shared["bookmarked"], about),
        "speaker_views": tp.viewed_speakers(shared["viewed"], about, src.users, src.details, user_match),
        "checkins": tp.checkins(src.checkins, src.checkin_notes, about, src.users),
        "session_dwell": dw.session_seconds(shared["dwelt"], about),
        "speaker_dwell": dw.speaker_seconds(shared["dwelt"], about),
    }


# extract, its table, and the column by which its loads are told apart
TARGETS = {
    "bookmarks": ("sessions_bookmarked", "batchid"),
    "views": ("sessions_viewed", "batchid"),
    "speaker_bookmarks": ("sessions_speakers_bookmarked", "batchid"),
    "speaker_views": ("sessions_speakers_viewed", "batchid"),
    "session_dwell": ("sessions_viewed_timespent", "batch_id"),
    "speaker_dwell": ("sessions_speakers_viewed_timespent", "batchid"),
    "checkins": ("sessions_checkins_status", None),
}


# how each table is split; those with a day are split by the day of ``created`` as well
SPLIT: dict[str, tuple[tuple[str, ...], str | None]] = {
    **{table: ((batch,) if batch else (), "created") for table, batch in TARGETS.values()},
    **{f"combine_{place + 1}": ((), "created") for place in range(len(STAGES))},
    **{table: (("batchid",), None) for table in ("actions_stag", "scores", "leads")},
}


class LeadsJob:
    """Incremental lead run over tables under ``root``, a folder all executors share.

    Every write replaces batches or a time window in one step (``versions``), and
    marks are advanced after the tables they describe, so a run that failed
    half-way is simply run again; it gets an id of its own.
    """

    def __init__(self, spark: SparkSession, src: Sources, root: str, bootstrap: bool = True):
        self.spark, self.src, self.root, self.bootstrap = spark, src, root.rstrip("/"), bootstrap
        self.marks = state.Marks(spark, f"{self.root}/run_marks")

    def stored(self, name: str) -> VersionedTable:
        parts, day_of = SPLIT[name]
        return VersionedTable(self.spark, f"{self.root}/{name}", parts, day_of)

    def table(self, name: str, after: datetime | None = None) -> DataFrame:
        """Table as written so far, or its rows after a time; empty before its first load."""
        return self.stored(name).read_after(TABLES[name], after)

    def vacuum(self, keep: int = 3) -> None:
        """Delete what the newest ``keep`` versions of no table hold; for times without a run."""
        for name in SPLIT:
            self.stored(name).vacuum(keep)

    def _new_facts(self) -> tuple[Sources, dict[str, int]]:
        """Facts after the marks, bounded by what is there now, so that late writers wait for the next run."""
        facts = {"actions": self.src.actions, "views": self.src.views, "sessions": self.src.session_events}
        now = {}
        for name, df in facts.items():
            # only what lies after the mark is looked at, never the whole history
            facts[name] = state.since(df, "batch_id", self.marks.read(name), bootstrap=self.bootstrap)
            now[name] = state.high_water(facts[name], "batch_id")
            facts[name] = state.since(facts[name], "batch_id", None, now[name], bootstrap=True)

        seen = self._checkins_seen()
        fresh = Sources(
            actions=facts["actions"],
            views=facts["views"],
            session_events=facts["sessions"],
            checkins=state.since(self.src.checkins, "created", seen, bootstrap=self.bootstrap),
            checkin_notes=self.src.checkin_notes,
            users=self.src.users,
            details=self.src.details,
            applications=self.src.applications,
            dims=self.src.dims,
        )
        return fresh, {name: mark for name, mark in now.items() if mark is not None}

    def _checkins_seen(self) -> datetime | None:
        """Time of the newest check-in that is loaded."""
        name = "sessions_checkins_status"
        newest_day = self.stored(name).last_day()
        if newest_day is None:
            return None
        return state.high_water(self.table(name, newest_day - timedelta(microseconds=1)), "created")

    def load_touchpoints(self) -> None:
        fresh, now = self._new_facts()
        built = extracts(fresh, hot_rows=HOT_ROWS)
        batches = sorted(set().union(*map(self._batches, (fresh.actions, fresh.views, fresh.session_events))))
        # each extract has a table of its own, so the replaces run at once; marks follow when all are in place
        seen = self._checkins_seen() or datetime(1970, 1, 1)
        replaces = [
            partial(self.stored(table).replace_batches, enforce_schema(built[name], table), batches) for name, (table, batch) in TARGETS.items() if batch
        ]
        side_by_side([*replaces, partial(self.stored("sessions_checkins_status").replace_window, built["checkins"], seen)])
        self.marks.advance(**now)

    @staticmethod
    def _batches(facts: DataFrame) -> set[int]:
        """Ids of the batches in newly arrived facts: one row per batch."""
        return {row[0] for row in facts.select("batch_id").distinct().collect() if row[0] is not None}

    def combine(self, as_of: str | datetime, lookback_hours: float = 72, min_views: int = 2) -> None:
        """Six stages, each recomputed for the look-back window and stored."""
        cut = parse_as_of(as_of) - timedelta(hours=lookback_hours)
        recent = {name: self.table(table, cut) for name, (table, _) in TARGETS.items()}
        after = hours_before(as_of, lookback_hours)
        out = touchpoint(recent["bookmarks"], "num_bookmarks", "num_bookmarks", after)
        for place, step in enumerate(STAGES):
            least = min_views if step.metric == "sessions_viewed" else None
            right = touchpoint(recent[step.source], step.value, step.metric, after, least)
            table = f"combine_{place + 1}"
            carried = METRICS[: place + 1] if place else ()
            summed = () if place else ("num_bookmarks",)
            combined = enforce_schema(combine(out, right, step.metric, carried, step.how, summed, HOT_ROWS), table)
            self.stored(table).replace_window(combined, cut)
            out = self.table(table, cut)

    def score(self, as_of: str | datetime, lookback_hours: float = 72, zero_range: str = "reference", run: int | None = None) -> int:
        """Stamp, score and enrich one batch; running it again replaces the batch."""
        run = self.marks.next_run() if run is None else run
        recent = self.table("combine_6", parse_as_of(as_of) - timedelta(hours=lookback_hours))
        actions = stamp_actions(recent, run, as_of, lookback_hours)
        self.stored("actions_stag").replace_batches(actions, [run])
        batch = self.table("actions_stag").filter(f"batchid = {run}")
        if batch.isEmpty():  # what an earlier attempt of this run wrote goes as well
            for table in ("scores", "leads"):
                self.stored(table).drop_batches([run])
            return run
        self.stored("scores").replace_batches(lead_scores(batch, zero_range), [run])
        scored = self.table("scores").filter(f"batchid = {run}")
        people = leads(scored, self.src.details, self.src.applications, latest_only=False)
        self.stored("leads").replace_batches(people, [run])
        return run

    def run(self, as_of: str | datetime, lookback_hours: float = 72) -> int:
        with job_scratch(self.spark):
            self.load_touchpoints()
            self.combine(as_of, lookback_hours)
            run = self.score(as_of, lookback_hours, run=self.marks.claim_run())
            self.marks.advance(run=run + 1)
        return run
