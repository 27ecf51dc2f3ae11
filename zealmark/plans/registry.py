"""Registered queries: every operator over the whole test tables, at the events' own times."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zealmark.functions.columns import parse_as_of
from zealmark.operators import dwell as dw
from zealmark.operators import experiment as ex
from zealmark.operators import health as he
from zealmark.operators import leads as le
from zealmark.operators import scoring as sc
from zealmark.operators import topics as to
from zealmark.operators import touchpoints as tp
from zealmark.operators.catalog import Content, Dims, content
from zealmark.operators.combine import STAGES, combine_stages, combine_summed, stamp_actions
from zealmark.plans.experiment_job import build_cohorts, interest_of, write_payload
from zealmark.plans.health_job import event_health, weekly_messages
from zealmark.plans.leads_job import LeadsJob, Sources, extracts
from zealmark.plans.topics_job import run_topic_scores, run_topic_validation, topic_table
from zealmark.schemas import METRICS, TABLES, enforce_schema
from zealmark.session import scratch_path, stage, stage_all, tune
from zealmark.sources import state, tables
from zealmark.sources.fixtures import AS_OF, SCHEMAS, Platform
from zealmark.sources.versions import VersionedTable
from zealmark.streaming import loads

DENSE, RECENT = 720, 72  # hours looked back

_REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[Platform], DataFrame]) -> Callable[[Platform], DataFrame]:
    _REGISTRY[fn.__name__] = lambda spark, sf_dir: rounded(fn(Platform(tune(spark), sf_dir)))
    return fn


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_REGISTRY)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to six places, so that the order of additions cannot show."""
    doubles = [f.name for f in df.schema if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns({c: F.round(c, digits) for c in doubles}) if doubles else df


def dims(p: Platform) -> Dims:
    return Dims(
        p.ratings_item, p.ratings_topic, p.ratings_itemfiltermappings, p.ratings_filters, p.ratings_itemmappings
    )


def about(p: Platform, track_join: str = "left") -> Content:
    return content(dims(p), track_join)


def sources(p: Platform) -> Sources:
    return Sources(
        p.fact_actions_live,
        p.fact_views_live,
        p.fact_sessions_live,
        p.ratings_usercheckins,
        p.ratings_usercheckinnotes,
        p.authdb_is_users,
        p.ratings_globaluserdetails,
        p.authdb_applications,
        dims(p),
    )


def stored_extracts(p: Platform, upto: int = len(STAGES)) -> dict[str, DataFrame]:
    """The extracts that the first ``upto`` stages read, as tables, which is how a run hands them to the combine."""
    built = extracts(sources(p))
    return stage_all({name: built[name] for name in ("bookmarks", *(step.source for step in STAGES[:upto]))})


# --- extracts ------------------------------------------------------------------------------


@query
def sessions_bookmarked(p: Platform) -> DataFrame:
    return tp.bookmarks(p.fact_actions_live, about(p))


@query
def sessions_bookmarked_inner(p: Platform) -> DataFrame:
    return tp.bookmarks(p.fact_actions_live, about(p, "inner"))


@query
def sessions_viewed(p: Platform) -> DataFrame:
    return tp.views(p.fact_views_live, about(p))


@query
def sessions_speakers_bookmarked(p: Platform) -> DataFrame:
    return tp.speaker_bookmarks(p.fact_actions_live, about(p))


@query
def sessions_speakers_viewed(p: Platform) -> DataFrame:
    return tp.speaker_views(
        p.fact_views_live, about(p), p.authdb_is_users, p.ratings_globaluserdetails
    )


@query
def sessions_checkins(p: Platform) -> DataFrame:
    return tp.checkins(p.ratings_usercheckins, p.ratings_usercheckinnotes, about(p), p.authdb_is_users)


def _split(name: str) -> Callable[[Platform], DataFrame]:
    """An extract in which every item of more than three rows is dealt over several tasks."""

    def fn(p: Platform) -> DataFrame:
        return extracts(sources(p), hot_rows=3)[name]

    fn.__name__ = f"extract_{name}_split"
    return query(fn)


for _name in ("bookmarks", "views", "speaker_bookmarks", "speaker_views", "checkins", "session_dwell", "speaker_dwell"):
    _split(_name)


@query
def actions_bookmark_scan(p: Platform) -> DataFrame:
    return p.fact_actions_live.filter(F.col("identifier") == "bookmarkButton")


@query
def rejected_item_ids(p: Platform) -> DataFrame:
    return tp.rejected_item_ids(p.fact_views_live)


@query
def audience_coverage(p: Platform) -> DataFrame:
    return tp.audience_coverage(
        p.fact_views_live,
        dims(p),
        p.authdb_is_users,
        p.authdb_applications,
        p.implementation,
        "2024-01-01 00:00:00",
        "2024-02-15 00:00:00",
    )


# --- dwell ---------------------------------------------------------------------------------


@query
def event_lag(p: Platform) -> DataFrame:
    return dw.event_lag(p.fact_views_live, p.fact_sessions_live)


def _steps(p: Platform) -> DataFrame:
    return dw.event_dwell(p.fact_views_live, p.fact_sessions_live)


@query
def dwell_filtered(p: Platform) -> DataFrame:
    return _steps(p).drop("next_created", "dwell_us")


@query
def dwell_events(p: Platform) -> DataFrame:
    return _steps(p)


@query
def dwell_events_cut(p: Platform) -> DataFrame:
    """Dwell with visits of more than two events cut into chunks, inside a minute and inside one time where need be."""
    return dw.event_dwell(p.fact_views_live, p.fact_sessions_live, group_limit=2)


@query
def event_lag_cut(p: Platform) -> DataFrame:
    return dw.event_lag(p.fact_views_live, p.fact_sessions_live, group_limit=3)


@query
def sessions_timespent(p: Platform) -> DataFrame:
    return dw.session_dwell(_steps(p), about(p))


@query
def speakers_timespent(p: Platform) -> DataFrame:
    return dw.speaker_dwell(_steps(p), about(p))


# --- loads ---------------------------------------------------------------------------------


@query
def incremental_actions(p: Platform) -> DataFrame:
    """Bookmarks after a target that was loaded up to the twentieth."""
    target = tp.bookmarks(p.fact_actions_live.filter(F.col("batch_id") <= 20), about(p))
    fresh = state.since(p.fact_actions_live, "batch_id", state.high_water(target, "batchid"))
    return tp.bookmarks(fresh, about(p))


@query
def incremental_checkins(p: Platform) -> DataFrame:
    loaded = p.ratings_usercheckins.filter(F.col("created") <= F.lit("2024-01-21 00:00:00").cast("timestamp_ntz"))
    fresh = state.since(p.ratings_usercheckins, "created", state.high_water(loaded, "created"))
    return tp.checkins(fresh, p.ratings_usercheckinnotes, about(p), p.authdb_is_users)


@query
def incremental_bounded(p: Platform) -> DataFrame:
    """Dwell of the batches after the stored marks, up to what each source holds now."""
    marks = state.Marks(p.spark, scratch_path(p.spark, "marks"))
    marks.advance(views=10, sessions=10)
    bounded = [
        state.since(df, "batch_id", marks.read(name), state.high_water(df, "batch_id"))
        for name, df in (("views", p.fact_views_live), ("sessions", p.fact_sessions_live))
    ]
    return dw.event_dwell(*bounded)


@query
def run_counter(p: Platform) -> DataFrame:
    """Rows per run of two runs that each stamp the bookmarks with their own id."""
    marks = state.Marks(p.spark, scratch_path(p.spark, "runs"))
    path = scratch_path(p.spark, "stamped")
    for _ in range(2):
        run = marks.claim_run()
        extract = tp.bookmarks(p.fact_actions_live, about(p))
        state.replace_batch(extract.withColumn("batchid", F.lit(run).cast("bigint")), path)
        marks.advance(run=run + 1)
    stamped = p.spark.read.schema(TABLES["sessions_bookmarked"]).parquet(path)
    return stamped.groupBy("batchid").agg(F.count(F.lit(1)).alias("rows"))


def _rolling(p: Platform, finish: bool) -> DataFrame:
    """Combined bookmarks and check-ins of two days ago with the last 72 hours recomputed, twice; the last time put in place or not."""
    facts = stored_extracts(p, 1)
    early = combine_stages(facts, "2024-01-29 00:00:00", DENSE, upto=1)
    late = combine_stages(facts, AS_OF, RECENT, upto=1)
    table = VersionedTable(p.spark, scratch_path(p.spark, "combine_1"), (), "created")
    table.replace_window(early, datetime(1970, 1, 1))
    cut = parse_as_of(AS_OF) - timedelta(hours=RECENT)
    prepared = table.prepare_window(late, cut)
    if finish:
        table.commit(prepared)
        table.replace_window(late, cut)
    return table.read(TABLES["combine_1"])


@query
def rolling_replace(p: Platform) -> DataFrame:
    return _rolling(p, True)


@query
def rolling_replace_cut_short(p: Platform) -> DataFrame:
    """A window replace that ended before its version was put in place: the old rows, whole."""
    return _rolling(p, False)


def _batches_table(p: Platform) -> VersionedTable:
    """Bookmarks loaded without trackless sessions."""
    table = VersionedTable(p.spark, scratch_path(p.spark, "sessions_bookmarked"), ["batchid"], "created")
    table.replace_batches(tp.bookmarks(p.fact_actions_live, about(p, "inner")))
    return table


@query
def batch_replace(p: Platform) -> DataFrame:
    """Bookmarks loaded without trackless sessions, then later batches replaced with all sessions, twice."""
    table = _batches_table(p)
    again = tp.bookmarks(p.fact_actions_live.filter(F.col("batch_id") > 15), about(p))
    for _ in range(2):
        table.replace_batches(again)
    table.vacuum(1)
    return table.read(TABLES["sessions_bookmarked"])


@query
def batch_replace_cut_short(p: Platform) -> DataFrame:
    """The same, ended before the later batches were put in place."""
    table = _batches_table(p)
    table.prepare(tp.bookmarks(p.fact_actions_live.filter(F.col("batch_id") > 15), about(p)), lambda values: False)
    return table.read(TABLES["sessions_bookmarked"])


@query
def csv_roundtrip(p: Platform) -> DataFrame:
    path = scratch_path(p.spark, "score-pairs")
    tables.write_csv(p.score_pairs, path)
    return tables.read_csv(p.spark, path, p.score_pairs.schema)


@query
def sink_append(p: Platform) -> DataFrame:
    """Two appends by column name to one batch-partitioned table."""
    path = scratch_path(p.spark, "appended")
    extract = tp.bookmarks(p.fact_actions_live, about(p))
    for half in (F.col("batchid") <= 15, F.col("batchid") > 15):
        shuffled_columns = extract.filter(half).select(*reversed(extract.columns))
        tables.append(shuffled_columns, path, "sessions_bookmarked", "batchid")
    return enforce_schema(p.spark.read.schema(TABLES["sessions_bookmarked"]).parquet(path), "sessions_bookmarked")


@query
def sink_overwrite(p: Platform) -> DataFrame:
    path = scratch_path(p.spark, "overwritten")
    for rows in (p.fact_actions_live.filter(F.col("batch_id") <= 15), p.fact_actions_live):
        tables.overwrite(rows, path)
    return p.spark.read.parquet(path)


@query
def schema_contract(p: Platform) -> DataFrame:
    return enforce_schema(tp.views(p.fact_views_live, about(p)), "sessions_viewed")


@query
def stream_bookmarks(p: Platform) -> DataFrame:
    return loads.stream_bookmarks(_stream(p).fact_actions_live, about(p))


@query
def stream_batch_replace(p: Platform) -> DataFrame:
    facts = _stream(p).fact_actions_live
    # all batches, then those of even number once more
    return loads.stream_batch_replace(facts, facts.filter(F.col("batch_id") % 2 == 0))


@query
def stream_bookmarks_redelivered(p: Platform) -> DataFrame:
    """The facts twice over and their even batches a third time, each time in a feed of its own."""
    facts = _stream(p).fact_actions_live
    return loads.stream_bookmarks(facts, about(p), facts, facts.filter(F.col("batch_id") % 2 == 0))


@query
def stream_batch_corrected(p: Platform) -> DataFrame:
    """Three deliveries of which two meet in one run: all batches, those of even number without their likes, and every fifth once more, stamped."""
    facts, spark = p.fact_actions_live, p.spark
    arrived, path, marks = (scratch_path(spark, name) for name in ("arrived", "stream-table", "stream-marks"))
    even, fifth = F.col("batch_id") % 2 == 0, F.col("batch_id") % 5 == 0
    corrected = facts.filter(even & (F.col("identifier") != "likeButton"))
    final = facts.filter(fifth).withColumn("session_id", F.lit("final"))
    for run in ({"0001": facts, "0002": corrected}, {"0003": final}):
        for name, rows in run.items():
            tables.overwrite(rows, f"{arrived}/{name}")
        stream = loads.file_stream(spark, f"{arrived}/*", facts.schema, delivery="folder")
        loads.replace_available(stream, path, marks, versioned=True)
    return loads.read_batches(spark, path, facts.schema)


class _StreamPlatform(Platform):
    """The same tables with the events arriving as a file stream."""

    def _scan(self, name: str) -> DataFrame:
        return loads.file_stream(self.spark, self.sf_dir, SCHEMAS[name], f"{name}.parquet")


def _stream(p: Platform) -> Platform:
    return _StreamPlatform(p.spark, p.sf_dir)


# --- combine, scores, leads ----------------------------------------------------------------


def _combine_query(upto: int) -> None:
    def fn(p: Platform) -> DataFrame:
        return combine_stages(stored_extracts(p, upto), AS_OF, DENSE, upto)

    fn.__name__ = f"combine_{upto}"
    query(fn)


for _upto in range(1, 7):
    _combine_query(_upto)


@query
def combine_6_split(p: Platform) -> DataFrame:
    """All stages; keys of more than eight rows on a side are split."""
    return combine_stages(stored_extracts(p), AS_OF, DENSE, last_join="full", hot_rows=8)


@query
def combine_6_recent(p: Platform) -> DataFrame:
    return combine_stages(stored_extracts(p), AS_OF, RECENT)


@query
def combine_6_full(p: Platform) -> DataFrame:
    return combine_stages(stored_extracts(p), AS_OF, DENSE, last_join="full")


@query
def combine_6_single_views(p: Platform) -> DataFrame:
    return combine_stages(stored_extracts(p), AS_OF, RECENT, min_views=1)


@query
def combine_summed_6(p: Platform) -> DataFrame:
    return combine_summed(stored_extracts(p), AS_OF, DENSE)


@query
def combine_summed_full(p: Platform) -> DataFrame:
    return combine_summed(stored_extracts(p), AS_OF, DENSE, last_join="full")


@query
def lead_scores_summed(p: Platform) -> DataFrame:
    combined = combine_summed(stored_extracts(p), AS_OF, DENSE)
    return sc.lead_scores(stage(stamp_actions(combined, 1, AS_OF, DENSE), "actions"))


def _actions(p: Platform, hours: int = DENSE, batch: int = 1) -> DataFrame:
    """Stored action set of one run."""
    combined = combine_stages(stored_extracts(p), AS_OF, hours)
    return stage(stamp_actions(combined, batch, AS_OF, hours), "actions")


@query
def actions_stag(p: Platform) -> DataFrame:
    return _actions(p)


@query
def range_score(p: Platform) -> DataFrame:
    return sc.range_score(sc.zero_missing(_actions(p)), METRICS, undefined="zero")


@query
def lead_scores(p: Platform) -> DataFrame:
    return sc.lead_scores(_actions(p))


@query
def lead_scores_recent(p: Platform) -> DataFrame:
    return sc.lead_scores(_actions(p, RECENT))


@query
def title_bucket(p: Platform) -> DataFrame:
    return le.titles(p.ratings_globaluserdetails)


@query
def leads(p: Platform) -> DataFrame:
    return le.leads(sc.lead_scores(_actions(p)), p.ratings_globaluserdetails, p.authdb_applications)


@query
def latest_batch_leads(p: Platform) -> DataFrame:
    """Leads of the second of two runs."""
    return le.leads(_two_runs(p), p.ratings_globaluserdetails, p.authdb_applications)


def _two_runs(p: Platform) -> DataFrame:
    """Stored scores of two runs over the same extracts."""
    facts = stored_extracts(p)
    runs = [
        sc.lead_scores(stage(stamp_actions(combine_stages(facts, AS_OF, hours), batch, AS_OF, hours), "actions"))
        for batch, hours in ((1, DENSE), (2, RECENT))
    ]
    return stage(runs[0].unionByName(runs[1]), "scores")


@query
def new_leads(p: Platform) -> DataFrame:
    """Leads that a target with the first run's leads lacks."""
    scores, people = _two_runs(p), (p.ratings_globaluserdetails, p.authdb_applications)
    target = le.leads(scores.filter("batchid = 1"), *people)
    return le.new_leads(scores, target, *people)


# --- topics --------------------------------------------------------------------------------


@query
def semantic_actions(p: Platform) -> DataFrame:
    return to.semantic_actions(_actions(p), p.session_tags_v0)


@query
def semantic_gate(p: Platform) -> DataFrame:
    return to.semantic_gate(to.semantic_actions(_actions(p), p.session_tags_v0))


def _topic_scores(p: Platform) -> DataFrame:
    return to.topic_scores(stage(semantic_gate(p), "gated"))


@query
def topic_scores(p: Platform) -> DataFrame:
    return _topic_scores(p)


@query
def topic_leads(p: Platform) -> DataFrame:
    return le.topic_leads(_topic_scores(p), p.ratings_globaluserdetails, p.authdb_applications)


def _sides(p: Platform) -> tuple[DataFrame, DataFrame]:
    return p.session_topics_manual, p.session_tags_v0


@query
def topic_sides(p: Platform) -> DataFrame:
    return to.topic_sides(*_sides(p))


@query
def topic_matches(p: Platform) -> DataFrame:
    return to.topic_matches(*_sides(p))


@query
def topic_misses(p: Platform) -> DataFrame:
    return to.topic_misses(*_sides(p))


@query
def topic_totals(p: Platform) -> DataFrame:
    return to.topic_totals(*_sides(p))


@query
def topic_validation(p: Platform) -> DataFrame:
    return to.topic_validation(*_sides(p))


@query
def pr_correlation(p: Platform) -> DataFrame:
    return to.correlation_label(to.topic_validation(*_sides(p)), "recall", "precision")


@query
def pr_histogram(p: Platform) -> DataFrame:
    return to.histogram(to.topic_validation(*_sides(p)), ["recall", "precision"])


@query
def pr_linear_fit(p: Platform) -> DataFrame:
    return to.linear_fit(to.topic_validation(*_sides(p)), "recall", "precision")


@query
def pr_fit_band(p: Platform) -> DataFrame:
    return to.fit_with_band(stage(to.topic_validation(*_sides(p)), "validation"), "recall", "precision")


@query
def score_profile(p: Platform) -> DataFrame:
    return to.score_profile(p.score_pairs, ["svd_social", "svd_content"])


@query
def score_pairs_graded(p: Platform) -> DataFrame:
    scored = sc.range_score(p.score_pairs, ["svd_social", "svd_content"], "score")
    return sc.grade(scored, "score", sc.LEAD_CUTS)


# --- whole jobs -----------------------------------------------------------------------------


def _facts_up_to(src: Sources, batch: int) -> Sources:
    """What a run on the day of ``batch`` finds."""
    seen = F.col("batch_id") <= batch
    checkins_seen = src.checkins.filter(F.dayofmonth("created") <= batch)
    return replace(src, actions=src.actions.filter(seen), views=src.views.filter(seen), session_events=src.session_events.filter(seen), checkins=checkins_seen)


@query
def lead_run_twice(p: Platform) -> DataFrame:
    """The leads of two lead runs over overlapping look-backs, of which the second finds two more days of facts."""
    src, root = sources(p), scratch_path(p.spark, "lead-runs")
    LeadsJob(p.spark, _facts_up_to(src, 28), root).run("2024-01-29 00:00:00", 240)
    job = LeadsJob(p.spark, src, root)
    job.run(AS_OF, RECENT)
    return job.table("leads")


def _topic_run(p: Platform, table: str) -> DataFrame:
    """A table after two topic runs over one batch, of which the second replaces the first."""
    actions, root = _actions(p), scratch_path(p.spark, "topic-runs")
    for _ in range(2):
        run_topic_scores(p.spark, actions, p.session_tags_v0, p.ratings_globaluserdetails, p.authdb_applications, root)
    return topic_table(p.spark, root, table)


@query
def topic_run_scores(p: Platform) -> DataFrame:
    return _topic_run(p, "scores_semantic")


@query
def topic_run_leads(p: Platform) -> DataFrame:
    return _topic_run(p, "leads_semantic")


@query
def topic_validation_run(p: Platform) -> DataFrame:
    """The validation table, written over an older one."""
    path = scratch_path(p.spark, "validation")
    for generated in (p.session_tags_v0.limit(1), p.session_tags_v0):
        run_topic_validation(p.session_topics_manual, generated, path)
    return p.spark.read.schema(TABLES["topic_validation"]).parquet(path)


@query
def cohort_payload_run(p: Platform) -> DataFrame:
    """The cohorts as the chat service gets them: written as JSON and read back."""
    path = scratch_path(p.spark, "payload")
    write_payload(build_cohorts(_actions(p), p.session_topics_manual, p.authdb_is_users, p.authdb_applications), path)
    return tables.read_json(p.spark, path, "cohorts")


# --- choices that the other queries leave at their defaults -----------------------------------


@query
def lead_scores_without_flat(p: Platform) -> DataFrame:
    """Scores where nobody checked in: the metric without range is left out."""
    actions = stage(_actions(p).withColumn("num_checkins", F.lit(0).cast("bigint")), "no-checkins")
    return sc.lead_scores(actions, zero_range="ignore")


@query
def sessions_speakers_viewed_once(p: Platform) -> DataFrame:
    """Views of speakers, each counted once however many accounts and profiles the viewer has."""
    return tp.speaker_views(p.fact_views_live, about(p), p.authdb_is_users.unionByName(p.authdb_is_users), p.ratings_globaluserdetails, "semi")


@query
def incremental_bootstrap(p: Platform) -> DataFrame:
    """Bookmarks of a load that has no mark yet."""
    empty = tp.bookmarks(p.fact_actions_live.filter(F.lit(False)), about(p))
    return tp.bookmarks(state.since(p.fact_actions_live, "batch_id", state.high_water(empty, "batchid"), bootstrap=True), about(p))


@query
def csv_inferred(p: Platform) -> DataFrame:
    """A CSV file read without a schema."""
    path = scratch_path(p.spark, "inferred")
    tables.write_csv(p.score_pairs, path)
    return tables.read_csv(p.spark, path)


# --- event health and mailing --------------------------------------------------------------


@query
def event_ratios(p: Platform) -> DataFrame:
    return he.event_ratios(p.eventcubesummary, p.implementation, AS_OF)


@query
def event_score(p: Platform) -> DataFrame:
    return he.event_score(stage(event_ratios(p), "event-ratios"))


@query
def event_grade(p: Platform) -> DataFrame:
    return event_health(p.eventcubesummary, p.implementation, AS_OF)


@query
def outreach_percent(p: Platform) -> DataFrame:
    return he.headline_percent(event_grade(p), AS_OF)


@query
def outreach_messages(p: Platform) -> DataFrame:
    messages = weekly_messages(
        event_grade(p),
        p.ratings_globaluserdetails,
        AS_OF,
        "activity_report",
        "Event activity report",
        "news@example.com",
        "The events team",
    )
    return messages.withColumns({"tags": F.to_json("tags"), "vars": F.to_json("vars")})


# --- experiment ----------------------------------------------------------------------------


def _base(p: Platform) -> DataFrame:
    return ex.experiment_base(_actions(p), p.session_topics_manual, p.authdb_is_users)


@query
def experiment_base(p: Platform) -> DataFrame:
    return _base(p)


@query
def experiment_base_apps(p: Platform) -> DataFrame:
    return ex.experiment_base(_actions(p), p.session_topics_manual, p.authdb_is_users, app_ids=["APP-1", "app-3"])


def _interest(p: Platform) -> DataFrame:
    return interest_of(_actions(p), p.session_topics_manual, p.authdb_is_users)


@query
def topic_interest(p: Platform) -> DataFrame:
    return _interest(p)


def _top(p: Platform) -> DataFrame:
    return stage(ex.top_topic(_interest(p)), "top-topic")


@query
def top_topic(p: Platform) -> DataFrame:
    return _top(p)


@query
def topic_pairs(p: Platform) -> DataFrame:
    return ex.contrast_topic(_top(p))


@query
def control_pool(p: Platform) -> DataFrame:
    return ex.control_pool(p.authdb_is_users, _top(p))


@query
def control_split(p: Platform) -> DataFrame:
    return ex.repeat_copies(ex.split_exact(ex.control_pool(p.authdb_is_users, _top(p))))


@query
def topic_high_low(p: Platform) -> DataFrame:
    return ex.high_low(_top(p))


@query
def cohort_high_low(p: Platform) -> DataFrame:
    top = _top(p)
    halves = ex.split_exact(ex.control_pool(p.authdb_is_users, top))
    return ex.cohort_high_low(ex.repeat_copies(halves.filter(F.col("half") == 2)), ex.high_low(top))


@query
def cohort_random(p: Platform) -> DataFrame:
    top = _top(p)
    halves = ex.split_exact(ex.control_pool(p.authdb_is_users, top))
    return ex.random_pair(halves.filter(F.col("half") == 1), ex.contrast_topic(top))


@query
def cohorts(p: Platform) -> DataFrame:
    return ex.cohorts(_top(p), p.authdb_is_users)


def _named(p: Platform) -> DataFrame:
    return ex.cohorts_named(ex.cohorts(_top(p), p.authdb_is_users), p.authdb_applications)


@query
def cohorts_named(p: Platform) -> DataFrame:
    return _named(p)


@query
def cohort_slice(p: Platform) -> DataFrame:
    return ex.cohort_slice(_named(p), applicationid="APP-3")


@query
def chat_payload_json(p: Platform) -> DataFrame:
    return ex.chat_payload(_named(p))


@query
def chat_responses_scan(p: Platform) -> DataFrame:
    """Responses written as JSON and read back with their schema."""
    path = scratch_path(p.spark, "responses")
    tables.write_json(p.chat_responses, path)
    return tables.read_json(p.spark, path, "chat_responses")


@query
def response_tally(p: Platform) -> DataFrame:
    return ex.tally(p.chat_responses, ["1", "2"])


@query
def response_tally_all(p: Platform) -> DataFrame:
    return ex.tally(p.chat_responses)
