"""SQL that states each registered query a second time, for DuckDB.

The statements follow the plain meaning of each operator (join all rows, then
group), not the layout of the DataFrame jobs.
"""

from __future__ import annotations

from zealmark.schemas import METRICS

AS_OF = "timestamp '2024-01-30 18:30:00'"

FIXTURES: dict[str, str] = {
    "ev": """
        select event_id, user_id, event_type, value,
               case when event_type = 'view' then date_trunc('day', ts) + to_hours(cast(floor(extract(hour from ts) / 6.0) * 6 as integer))
                    else ts end as created,
               (cast(json_extract_string(props, '$.k') as bigint) % 20) * 5 + user_id % 5 as k,
               cast(extract(day from ts) as bigint) as batch_id,
               cast(user_id as varchar) || '-w' || cast(cast(floor(extract(day from ts) / 7.0) as bigint) as varchar) as session_id,
               'App-' || cast(user_id % 5 as varchar) as application_id,
               'U' || cast(user_id as varchar) as global_user_id
        from events""",
    "fact_views_live": """
        select application_id, global_user_id, session_id, created,
               case when event_type = 'view' then 'item' else 'list' end as identifier,
               case when event_type = 'view' or value >= 30 then '{"ItemId": ' || cast(k as varchar) || '}' else '{}' end as metadata,
               batch_id, event_id
        from ev where event_type in ('view', 'click')""",
    "fact_sessions_live": """
        select application_id, global_user_id, session_id, created, 'session' as identifier,
               cast(null as varchar) as metadata, batch_id, event_id
        from ev where event_type = 'error'""",
    "fact_actions_live": """
        select application_id, global_user_id, session_id, created,
               case when value < 60 then 'bookmarkButton' else 'likeButton' end as identifier,
               '{"ItemId": ' || cast(k as varchar) || '}' as metadata, batch_id, event_id
        from ev where event_type = 'purchase'""",
    "ratings_usercheckins": """
        select event_id as checkinid, user_id as userid, upper(application_id) as applicationid, k as itemid, created
        from ev where event_type = 'signup'""",
    "ratings_usercheckinnotes": "select event_id as checkinid from ev where event_type = 'signup' and value >= 15",
    "ratings_item": """
        select p_partkey as itemid, p_name as name, cast(floor(p_partkey / 5.0) as bigint) % 25 as parenttopicid,
               case when p_size = 7 then 1 else 0 end as isdisabled
        from part""",
    "ratings_topic": """
        select cast(n_nationkey as bigint) as topicid, n_name as name,
               case when n_regionkey < 3 then 2 when n_regionkey = 3 then 4 else 3 end as listtypeid,
               case when n_name = 'NATION_12' then 1 else 0 end as isdisabled
        from nation""",
    "ratings_itemmappings": """
        select p_partkey - 5 as sourceitemid, p_partkey as targetitemid from part
        union all select p_partkey - 10, p_partkey from part""",
    "ratings_itemfiltermappings": """
        select p_partkey as itemid, cast(p_size % 25 as bigint) as filterid from part where p_size > 10
        union all select p_partkey, cast((p_size + 1) % 25 as bigint) from part where p_size > 38""",
    "ratings_filters": "select cast(n_nationkey as bigint) as filterid, n_name as name from nation",
    "authdb_is_users": """
        select c_custkey as userid, 'u' || cast(c_custkey as varchar) as globaluserid,
               'app-' || cast(c_custkey % 5 as varchar) as applicationid
        from customer""",
    "ratings_globaluserdetails": """
        select 'u' || cast(c_custkey as varchar) as globaluserid,
               (['Product Specialist', 'SVP Sales', 'vice president, ops', 'Account Manager', 'Director of IT',
                 'Chief Engineer', 'Chief of Staff', 'CTO', 'ceo', 'Analyst', 'vp sales', null])[c_custkey % 12 + 1] as title,
               'user' || cast(c_custkey as varchar) || '@example.com' as emailaddress,
               'First' || cast(c_custkey as varchar) as firstname, 'Last' || cast(c_custkey as varchar) as lastname,
               c_mktsegment as company, '000-' || cast(c_custkey as varchar) as phone
        from customer where c_acctbal >= 0""",
    "authdb_applications": """
        select 'APP-' || cast(r_regionkey as varchar) as applicationid, 'Event ' || r_name as name,
               timestamp '2024-01-01 00:00:00' as startdate, timestamp '2024-02-01 00:00:00' as enddate
        from region""",
    "implementation": """
        select 'APP-' || cast(c_custkey as varchar) as applicationid from customer where c_mktsegment <> 'FURNITURE'""",
    "session_tags_v0": """
        select p_partkey as itemid, unnest([split_part(p_name, ' ', 1), split_part(p_name, ' ', 2), p_type]) as topic,
               'APP-' || cast(p_partkey % 5 as varchar) as applicationid
        from part""",
    "session_topics_manual": """
        select p_partkey as itemid,
               unnest([upper(split_part(p_name, ' ', 1)), case when p_size % 3 <> 0 then lower(p_type) else 'misc' end]) as topic
        from part where p_size > 8""",
    "eventcubesummary": """
        select 'app-' || cast(user_id as varchar) as applicationid, min(created) as startdate,
               cast(max(created) as date) + cast(user_id % 12 as integer) as enddate,
               count(*) as users,
               count(distinct case when user_id % 17 <> 0 then batch_id end) as usersactive,
               count(distinct case when event_type = 'view' then batch_id end) as usersengaged,
               count(*) filter (event_type = 'click') as posts, count(*) filter (event_type = 'purchase') as likes,
               count(*) filter (event_type = 'signup') as comments, count(*) filter (event_type = 'error') as checkins
        from ev group by user_id""",
    "chat_responses": """
        select 'APP-' || cast(conv_id % 5 as varchar) as application_id,
               case when turn % 4 < 2 then cast(turn % 4 + 1 as varchar) else "text" end as body
        from conversations""",
    "score_pairs": """
        select vec_id, abs(cast(embedding[1] as double)) as svd_social, abs(cast(embedding[2] as double)) as svd_content
        from embeddings""",
    # sessions with their tracks, and speakers with the sessions they speak in
    "session_tracks": """
        select it.itemid, it.name as session_name, m.filterid, f.filterid as track_id, f.name as session_track,
               it.isdisabled as item_off, t.isdisabled as topic_off
        from ratings_item it join ratings_topic t on t.topicid = it.parenttopicid and t.listtypeid = 2
        left join ratings_itemfiltermappings m on m.itemid = it.itemid
        left join ratings_filters f on f.filterid = m.filterid""",
    "speaker_tracks": """
        select sp.itemid as speakerid, s.*
        from ratings_item sp join ratings_topic t on t.topicid = sp.parenttopicid and t.listtypeid = 4
        join ratings_itemmappings l on l.targetitemid = sp.itemid
        join session_tracks s on s.itemid = l.sourceitemid and s.item_off = 0
        where sp.isdisabled = 0""",
}

_ITEM = "cast(json_extract_string({0}.metadata, '$.ItemId') as bigint)"


def _touch(fact: str, metric: str, identifier: str, content: str, key: str, joins: str = "", where: str = "") -> str:
    return f"""
        select lower(e.application_id) as application_id, e.global_user_id, e.created,
               c.session_track, cast(count(*) as bigint) as {metric}, c.itemid, c.filterid, c.session_name,
               e.batch_id as batchid
        from {fact} e join {content} c on c.{key} = {_ITEM.format('e')} {joins}
        where e.identifier = '{identifier}' and c.item_off = 0 {where}
        group by all"""


def bookmarks_sql(where: str = "", content: str = "session_tracks") -> str:
    return _touch("fact_actions_live", "num_bookmarks", "bookmarkButton", content, "itemid", where=where)


def views_sql(where: str = "") -> str:
    return _touch("fact_views_live", "num_views", "item", "session_tracks", "itemid", where=where)


def checkins_sql(where: str = "") -> str:
    return f"""
        select lower(e.applicationid) as applicationid, u.globaluserid as global_user_id, e.created,
               c.session_track, cast(count(*) as bigint) as num_checkins, c.itemid, c.filterid, c.session_name
        from ratings_usercheckins e join ratings_usercheckinnotes n on n.checkinid = e.checkinid
        join session_tracks c on c.itemid = e.itemid and c.topic_off = 0
        join authdb_is_users u on u.userid = e.userid
        {where} group by all"""


def lag_sql(low: int | None = None) -> str:
    bound = "" if low is None else f"where batch_id > {low}"
    return f"""
        select application_id, global_user_id, session_id, created, event_id, batch_id, identifier, itemid,
               lag(identifier) over visit as previousidentifier, lag(itemid) over visit as previousitemid
        from (select *, {_ITEM.format('v')} as itemid
              from (from fact_views_live union all by name from fact_sessions_live) v {bound})
        window visit as (partition by application_id, global_user_id, session_id order by created, event_id)"""


_KEEP = """(identifier <> 'item' or previousitemid is null
        or (identifier = 'item' and identifier <> previousidentifier and itemid <> previousitemid))"""


def kept_sql(lagged: str) -> str:
    return f"select * exclude (previousidentifier, previousitemid) from {lagged} where {_KEEP}"


def dwell_sql(kept: str) -> str:
    return f"""
        select *, date_diff('microsecond', created, next_created) as dwell_us
        from (select *, lead(created) over (partition by application_id, global_user_id, session_id
                                            order by created, event_id) as next_created from {kept})"""


SESSION_DWELL = f"""
    select lower(e.application_id) as application_id, e.global_user_id, e.created, c.session_track,
           cast(sum(e.dwell_us) as bigint) / 1000000.0::double as timespent, c.itemid, c.track_id as filterid,
           c.session_name, e.batch_id
    from dwell e join session_tracks c on c.itemid = e.itemid and c.item_off = 0
    where e.identifier = 'item' group by all"""
SPEAKER_DWELL = f"""
    select lower(e.application_id) as application_id, e.global_user_id, e.created, c.session_track,
           cast(sum(e.dwell_us) as bigint) / 1000000.0::double as timespent, c.itemid, c.filterid,
           c.session_name, e.batch_id as batchid
    from dwell e join speaker_tracks c on c.speakerid = e.itemid group by all"""

EXTRACTS: dict[str, str] = {
    "x_bookmarks": bookmarks_sql(),
    "x_views": views_sql(),
    "x_speaker_bookmarks": _touch("fact_actions_live", "num_bookmarks", "bookmarkButton", "speaker_tracks", "speakerid"),
    "x_speaker_views": _touch(
        "fact_views_live",
        "num_views",
        "item",
        "speaker_tracks",
        "speakerid",
        joins="""join authdb_is_users u on lower(u.globaluserid) = lower(e.global_user_id)
                 join ratings_globaluserdetails d on lower(d.globaluserid) = lower(e.global_user_id)""",
    ),
    "x_checkins": checkins_sql(),
    "lagged": lag_sql(),
    "kept": kept_sql("lagged"),
    "dwell": dwell_sql("kept"),
    "x_session_dwell": SESSION_DWELL,
    "x_speaker_dwell": SPEAKER_DWELL,
}

_STAGES = (
    # extract, its application column, its measure, the metric it becomes, kind of join
    ("x_checkins", "applicationid", "num_checkins", "num_checkins", "full"),
    ("x_speaker_bookmarks", "application_id", "num_bookmarks", "speakers_bookmarked", "full"),
    ("x_speaker_views", "application_id", "num_views", "speakers_viewed", "full"),
    ("x_speaker_dwell", "application_id", "timespent", "speakers_viewed_timespent", "full"),
    ("x_views", "application_id", "num_views", "sessions_viewed", "full"),
    ("x_session_dwell", "application_id", "timespent", "sessions_timespent", "left"),
)
_KEYS = ("application_id", "global_user_id", "created", "session_track", "itemid", "filterid", "session_name")


def _metric_sum(metric: str, of: str) -> str:
    return f"round(sum({of}), 6)" if metric.endswith("timespent") else f"cast(sum({of}) as bigint)"


def combine_sql(hours: int, as_of: str = AS_OF, prefix: str = "c", upto: int = 6, min_views: int = 2) -> dict[str, str]:
    """CTEs ``<prefix>1`` .. ``<prefix><upto>``."""
    recent = f"created > {as_of} - interval '{hours} hours'"
    out = {}
    left = "(select *, cast(itemid as varchar) as item_text, cast(filterid as varchar) as filter_text from x_bookmarks)"
    for place, (extract, app, value, metric, how) in enumerate(_STAGES[:upto]):
        if place:
            left = f"(select *, itemid as item_text, filterid as filter_text from {prefix}{place})"
        more = f" and num_views >= {min_views}" if extract == "x_views" else ""
        carried = METRICS[: place + 1] if place else ()
        adds = [*(["num_bookmarks"] if place == 0 else [])]
        out[f"{prefix}{place + 1}"] = f"""
            select coalesce(l.application_id, lower(r.{app})) as application_id,
                   coalesce(l.global_user_id, r.global_user_id) as global_user_id,
                   least(l.created, r.created) as created,
                   coalesce(l.session_track, r.session_track) as session_track,
                   coalesce(l.item_text, cast(r.itemid as varchar)) as itemid,
                   coalesce(l.filter_text, cast(r.filterid as varchar)) as filterid,
                   coalesce(l.session_name, r.session_name) as session_name,
                   {''.join(f'l.{m}, ' for m in carried)}
                   {''.join(f'cast(sum(l.{m}) as bigint) as {m}, ' for m in adds)}
                   {_metric_sum(metric, f'r.{value}')} as {metric}
            from (select * from {left} where {recent}) l
            {how} join (select * from {extract} where {recent}{more}) r
              on lower(l.application_id) = lower(r.{app}) and lower(l.global_user_id) = lower(r.global_user_id)
             and l.item_text = cast(r.itemid as varchar) and l.filter_text = cast(r.filterid as varchar)
             and lower(l.session_track) = lower(r.session_track)
            group by all"""
    return out


def summed_sql(hours: int, last_join: str) -> dict[str, str]:
    """CTE ``summed``: all recent touchpoints of one person, item and track in one row."""
    sources = (("x_bookmarks", "application_id", "num_bookmarks", "num_bookmarks"), *(stage[:4] for stage in _STAGES))
    parts = " union all by name ".join(
        f"""select lower({app}) as application_id, global_user_id, created, session_track, cast(itemid as varchar) as itemid,
                   cast(filterid as varchar) as filterid, session_name, {value} as {metric}, '{metric}' as part
            from {extract} where created > {AS_OF} - interval '{hours} hours' {"and num_views > 1" if extract == "x_views" else ""}"""
        for extract, app, value, metric in sources
    )
    kept = "" if last_join == "full" else "having bool_or(part <> 'sessions_timespent')"
    return {
        "summed": f"""
            select application_id, min(global_user_id) as global_user_id, min(created) as created, min(session_track) as session_track,
                   itemid, filterid, min(session_name) as session_name, {', '.join(f'{_metric_sum(m, m)} as {m}' for m in METRICS)}
            from ({parts})
            group by application_id, lower(global_user_id), itemid, filterid, lower(session_track),
                     case when session_track is null or filterid is null or itemid is null then part end {kept}"""
    }


def _score(source: str, metrics: tuple[str, ...], undefined: str) -> str:
    """Ranges and score of ``source``'s rows; a metric without range makes the score undefined or infinite."""
    low_high = ", ".join(f"max({m}) as hi_{m}, min({m}) as lo_{m}" for m in metrics)
    terms = " + ".join(f"cast({m} as double) / nullif(cast(hi_{m} - lo_{m} as double), 0)" for m in metrics)
    zero = " or ".join(f"(hi_{m} = lo_{m} and hi_{m} = 0)" for m in metrics)
    flat = " or ".join(f"hi_{m} = lo_{m}" for m in metrics)
    return f"""
        select s.*, case when {zero} then {undefined} when {flat} then 'infinity'::double else {terms} end as score
        from {source} s, (select {low_high} from {source}) r"""


def _graded(source: str, low: float, high: float) -> str:
    return f"""
        select s.*, case when score <= q[1] then 'C' when score <= q[2] then 'B' when score is not null then 'A' end as grade_score
        from {source} s, (select quantile_cont(score, [{low}, {high}]) as q from {source} where score is not null)"""


_FILLED_METRICS = ", ".join(f"coalesce({m}, 0) as {m}" for m in METRICS)


def scores_sql(combined: str, prefix: str, batch: int = 1) -> dict[str, str]:
    """CTEs of one batch's lead scores, ending in ``<prefix>scores``."""
    return {
        f"{prefix}filled": f"""
            select application_id, global_user_id, created, coalesce(session_track, '0') as session_track, itemid,
                   coalesce(filterid, '0') as filterid, session_name, {_FILLED_METRICS}, cast({batch} as bigint) as batchid
            from {combined}""",
        f"{prefix}scored": _score(f"{prefix}filled", METRICS, "0.0"),
        f"{prefix}graded": _graded(f"{prefix}scored", 0.2, 0.8),
        f"{prefix}scores": f"select * exclude (score), score as zscore from {prefix}graded",
    }


_TITLE = """case
    when title ilike '%specialist%' then 'Individual Contributor'
    when title like '%VP%' or title ilike '%vice president%' then 'Vice President'
    when title ilike '%manager%' then 'Manager'
    when title ilike '%director%' then 'Director'
    when title ilike '%engineer%' then 'Engineer'
    when title ilike '%chief%' or title like '%CEO%' or title like '%CMO%' or title like '%CCO%' or title like '%COO%'
        or title like '%CRO%' or title like '%CTO%' or title like '%CFO%' then 'C-Level exec'
    else 'Individual Contributor' end"""


def leads_sql(scores: str, how: str, score: str, extra: str = "") -> str:
    return f"""
        select s.application_id, a.name as event_name, a.startdate, a.enddate, s.global_user_id, {_TITLE} as title,
               s.session_track, s.created, s.itemid, s.filterid, s.session_name, d.emailaddress, d.firstname, d.lastname,
               d.company, d.phone, d.title as detailed_title, s.batchid, {extra} {score}, s.grade_score
        from {scores} s {how} join ratings_globaluserdetails d on lower(d.globaluserid) = lower(s.global_user_id)
        join authdb_applications a on lower(a.applicationid) = lower(s.application_id)"""


VALIDATION: dict[str, str] = {
    "pairs": """
        select m.itemid, lower(m.topic) as manual, lower(g.topic) as generated
        from session_topics_manual m join session_tags_v0 g on g.itemid = m.itemid""",
    "matched": """
        select itemid, count(distinct manual) as num_manual_matches from pairs where manual = generated group by itemid""",
    "missed": """
        select p.itemid, count(distinct p.manual) as num_manual_notmatches from pairs p
        where not exists (from pairs q where q.itemid = p.itemid and q.generated = p.manual) group by p.itemid""",
    "totals": """
        select itemid, count(distinct manual) as num_manual, count(distinct generated) as num_generated
        from pairs group by itemid""",
    "validation": """
        select itemid, num_manual, num_generated, coalesce(num_manual_matches, 0) as num_manual_matches,
               coalesce(num_manual_notmatches, 0) as num_manual_notmatches,
               coalesce(num_manual_matches, 0) / num_generated::double as "precision",
               coalesce(num_manual_matches, 0) / num_manual::double as recall
        from totals left join matched using (itemid) left join missed using (itemid)""",
}

HEALTH: dict[str, str] = {
    "rated": f"""
        select e.*, {', '.join(f"case when usersactive = 0 then 0.0::double else {c}::double / usersactive end as {n}"
                               for n, c in (('percentengaged', 'usersengaged'), ('percentpost', 'posts'),
                                            ('percentlikes', 'likes'), ('percentcomments', 'comments'),
                                            ('percentcheckins', 'checkins')))}
        from eventcubesummary e join implementation i on lower(i.applicationid) = lower(e.applicationid)
        where e.startdate > {AS_OF} - interval '18 months'""",
    "health_scored": _score(
        "rated",
        ("percentengaged", "percentpost", "percentlikes", "percentcomments", "percentcheckins", "users"),
        "null",
    ),
    "health": """
        select s.*, case when score <= q[1] and enddate between date '2024-01-30' and date '2024-01-30' + 6 then 'C'
                         when users <= 50 then 'B' when score <= q[2] then 'B' when score is not null then 'A' end as grade_score
        from health_scored s, (select quantile_cont(score, [0.33, 0.66]) as q from health_scored)""",
    "headline": f"""
        select round_even(100 * (count(*) - count(*) filter (grade_score = 'C'))::double / nullif(count(*), 0), 1)::double as percent
        from health where enddate >= {AS_OF} and enddate <= {AS_OF} + interval '5 days'""",
}


def _draw(seed: str, *keys: str) -> str:
    text = " || '|' || ".join([f"'{seed}'", *[f"cast({k} as varchar)" for k in keys]])
    return f"(('0x' || substr(md5({text}), 1, 13))::bigint / 4503599627370496::double)"


def semantic_sql(actions: str) -> dict[str, str]:
    return {
        "tagged": f"""
            select a.*, t.topic as semantic_topic from {actions} a
            join session_tags_v0 t on cast(t.itemid as varchar) = a.itemid and lower(t.applicationid) = lower(a.application_id)""",
        "gated": f"""
            select application_id, global_user_id, created, coalesce(session_track, '0') as session_track, itemid,
                   coalesce(filterid, '0') as filterid, session_name, {_FILLED_METRICS}, batchid, semantic_topic,
                   coalesce(num_checkins, 0) + coalesce(num_bookmarks, 0) + coalesce(speakers_bookmarked, 0)
                     + coalesce(speakers_viewed, 0) + coalesce(sessions_viewed, 0) as tot
            from tagged where tot > 5""",
        "topic_scored": _score("gated", METRICS, "null"),
        "topic_graded": _graded("topic_scored", 0.33, 0.66),
        "topic_scores": "select * exclude (score), score as V18 from topic_graded",
    }


def experiment_sql(actions: str) -> dict[str, str]:
    spans = "sum(n) over (partition by {0} order by {1}) - n as first, sum(n) over (partition by {0} order by {1}) as past"
    return {
        "base": f"""
            select u.userid, lower(a.application_id) as applicationid, a.created, t.topic, a.itemid,
                   {', '.join('a.' + m for m in METRICS)}
            from {actions} a join session_topics_manual t on t.itemid = cast(a.itemid as bigint)
            join authdb_is_users u on lower(u.globaluserid) = lower(a.global_user_id)
                                  and lower(u.applicationid) = lower(a.application_id)""",
        "sums": f"""
            select userid, applicationid, topic,
                   {', '.join(_metric_sum(m, f'coalesce({m}, 0)') + ' as ' + m for m in METRICS)}
            from base group by userid, applicationid, topic""",
        "interest_scored": _score("sums", METRICS, "null"),
        "interest": _graded("interest_scored", 0.2, 0.8),
        "top": """
            select userid, applicationid, topic as topic_1 from interest
            qualify row_number() over (partition by userid, applicationid order by grade_score, score desc, topic) = 1""",
        "laid": f"""
            select applicationid, topic_1, n, {spans.format('applicationid', 'md5(topic_1)')}
            from (select applicationid, topic_1, count(*) as n from top group by all)""",
        "chosen": f"""
            select t.userid, t.applicationid, t.topic_1,
                   cast(floor({_draw('123|contrast', 't.userid', 't.applicationid')} * (w.everyone - o.n)) as bigint) as place, o.first as own, o.n
            from top t join laid o using (applicationid, topic_1)
            join (select applicationid, max(past) as everyone from laid group by applicationid) w on w.applicationid = t.applicationid
            where w.everyone > o.n""",
        "identified": """
            select c.userid, c.applicationid, c.topic_1, l.topic_1 as topic_2
            from (select *, case when place < own then place else place + n end as pos from chosen) c
            join laid l on l.applicationid = c.applicationid and c.pos >= l.first and c.pos < l.past""",
        "pool": "select userid, applicationid from authdb_is_users where userid not in (select userid from top)",
        "split": f"""
            select userid, applicationid, case when place <= floor(0.5 * everyone) then 1 else 2 end as half
            from (select *, row_number() over (order by {_draw('123|split', 'userid', 'applicationid')}, userid, applicationid) as place,
                         count(*) over () as everyone from pool)""",
        "popular": """
            select applicationid, max_by(topic_1, n * 100000 + seq) as high, min_by(topic_1, n * 100000 + seq) as low
            from (select *, row_number() over (order by topic_1) as seq from laid) group by applicationid""",
        "by_popularity": """
            select s.userid, s.applicationid, p.high as topic_1, p.low as topic_2
            from split s join popular p on lower(p.applicationid) = lower(s.applicationid) where s.half = 2""",
        "pair_spans": """
            select applicationid, topic_1, topic_2,
                   sum(n) over (partition by applicationid order by md5(topic_1 || '|' || topic_2)) - n as first,
                   sum(n) over (partition by applicationid order by md5(topic_1 || '|' || topic_2)) as past
            from (select applicationid, topic_1, topic_2, count(*) as n from identified group by all)""",
        "by_chance": f"""
            select s.userid, s.applicationid, p.topic_1, p.topic_2
            from (select distinct s.userid, s.applicationid,
                         cast(floor({_draw('123|pair', 's.userid', 's.applicationid')} * w.everyone) as bigint) as pos
                  from split s join (select applicationid, max(past) as everyone from pair_spans group by all) w
                    on lower(w.applicationid) = lower(s.applicationid) where s.half = 1) s
            join pair_spans p on lower(p.applicationid) = lower(s.applicationid) and s.pos >= p.first and s.pos < p.past""",
        "all_cohorts": """
            select *, 'identified' as identification_type from identified
            union all select *, 'random_high_low' from by_popularity
            union all select *, 'random' from by_chance""",
        "named": """
            select c.userid, lower(c.applicationid) as applicationid, lower(c.topic_1) as topic_1, lower(c.topic_2) as topic_2,
                   c.identification_type, a.name as event_name
            from all_cohorts c join authdb_applications a on lower(a.applicationid) = lower(c.applicationid)""",
    }


def two_loads_sql() -> tuple[dict[str, str], dict[str, str], dict[str, str]]:
    """Extracts of facts that were loaded up to the 28th and after it, and the combines of the run on each load."""
    loads = {}
    for number, seen in ((1, "<="), (2, ">")):
        loads[f"lagged_{number}"] = lag_sql(28).replace("batch_id > 28", f"batch_id {seen} 28")
        loads[f"kept_{number}"] = kept_sql(f"lagged_{number}")
        loads[f"dwell_{number}"] = dwell_sql(f"kept_{number}")
    # a dwell ends with the load
    loads["dwell"] = "from dwell_1 union all by name from dwell_2"
    extracts = {**{k: v for k, v in EXTRACTS.items() if k not in ("lagged", "kept", "dwell", "x_session_dwell", "x_speaker_dwell")}, **loads}
    extracts |= {k: EXTRACTS[k] for k in ("x_session_dwell", "x_speaker_dwell")}
    batch = {"x_session_dwell": "batch_id", "x_checkins": "day(created)"}
    extracts |= {f"y{k[1:]}": f"from {k} where {batch.get(k, 'batchid')} <= 28" for k, *_ in (("x_bookmarks",), *_STAGES)}
    first = combine_sql(240, "timestamp '2024-01-29 00:00:00'", "p")
    return extracts, {k: v.replace("x_", "y_") for k, v in first.items()}, combine_sql(72, prefix="s")


def statement(final: str, *ctes: dict[str, str]) -> str:
    """``final`` with the fixtures, the extracts and ``ctes`` before it."""
    parts = {**FIXTURES}
    for more in ctes:
        parts.update(more)
    body = ",\n".join(f"{name} as ({sql})" for name, sql in parts.items())
    return f"with {body}\n{final}"


def oracle_sql() -> dict[str, str]:
    x = EXTRACTS
    dense, sparse = combine_sql(720), combine_sql(72, prefix="s")
    out = {
        "sessions_bookmarked": statement("from x_bookmarks", x),
        "sessions_viewed": statement("from x_views", x),
        "sessions_speakers_bookmarked": statement("from x_speaker_bookmarks", x),
        "sessions_speakers_viewed": statement("from x_speaker_views", x),
        "sessions_checkins": statement("from x_checkins", x),
        "sessions_timespent": statement("from x_session_dwell", x),
        "speakers_timespent": statement("from x_speaker_dwell", x),
        "event_lag": statement("from lagged", x),
        "dwell_filtered": statement("from kept", x),
        "dwell_events": statement("from dwell", x),
        "actions_bookmark_scan": statement("from fact_actions_live where identifier = 'bookmarkButton'"),
        "rejected_item_ids": statement(
            """select count(*) as facts, count(*) filter (json_extract_string(metadata, '$.ItemId') is not null and
               try_cast(json_extract_string(metadata, '$.ItemId') as bigint) is null) as rejected from fact_views_live"""
        ),
    }
    out["sessions_bookmarked_inner"] = statement(
        "select * exclude (batchid), batchid from ("
        + bookmarks_sql(
            content="(select * from session_tracks where track_id is not null)"
        )
        + ")"
    )
    out["audience_coverage"] = statement(
        f"""
        select e.application_id, count(distinct u.userid) as num_users_sessions_viewed, count(*) as num_views_sessions
        from fact_views_live e join ratings_item it on it.itemid = {_ITEM.format('e')} and it.isdisabled = 0
        join ratings_topic t on t.topicid = it.parenttopicid and t.listtypeid = 2
        join authdb_is_users u on lower(u.globaluserid) = lower(e.global_user_id)
        join authdb_applications a on lower(a.applicationid) = lower(e.application_id)
        join implementation i on lower(i.applicationid) = lower(e.application_id)
        where e.identifier = 'item' and a.enddate between timestamp '2024-01-01' and timestamp '2024-02-15'
        group by e.application_id"""
    )
    # loads
    out["incremental_actions"] = statement(bookmarks_sql("and e.batch_id > 20"))
    out["incremental_checkins"] = statement(
        checkins_sql(
            """where e.created > (select max(created) from ratings_usercheckins
                                  where created <= timestamp '2024-01-21 00:00:00')"""
        )
    )
    # items that are split come out as they do whole
    for extract, whole in (
        ("bookmarks", "sessions_bookmarked"),
        ("views", "sessions_viewed"),
        ("speaker_bookmarks", "sessions_speakers_bookmarked"),
        ("speaker_views", "sessions_speakers_viewed"),
        ("checkins", "sessions_checkins"),
        ("session_dwell", "sessions_timespent"),
        ("speaker_dwell", "speakers_timespent"),
    ):
        out[f"extract_{extract}_split"] = out[whole]
    out["dwell_events_cut"] = out["dwell_events"]
    out["event_lag_cut"] = out["event_lag"]
    out["incremental_bounded"] = statement(
        "from dwell", {"lagged": lag_sql(10), "kept": kept_sql("lagged"), "dwell": dwell_sql("kept")}
    )
    early = combine_sql(720, "timestamp '2024-01-29 00:00:00'", "e", 1)
    late = combine_sql(72, AS_OF, "l", 1)
    out["rolling_replace"] = statement(
        f"from e1 where created <= {AS_OF} - interval '72 hours' union all by name from l1", x, early, late
    )
    out["batch_replace"] = statement(
        f"""from ({bookmarks_sql("and e.batch_id <= 15", "(select * from session_tracks where track_id is not null)")})
            union all by name from ({bookmarks_sql("and e.batch_id > 15")})"""
    )
    # a replace that was not put in place leaves the old rows
    out["rolling_replace_cut_short"] = statement("from e1", x, early)
    out["batch_replace_cut_short"] = out["sessions_bookmarked_inner"]
    out["csv_roundtrip"] = statement(
        "select vec_id, round(svd_social, 6) as svd_social, round(svd_content, 6) as svd_content from score_pairs"
    )
    out["run_counter"] = statement(
        "select run as batchid, (select count(*) from x_bookmarks) as rows from (values (1::bigint), (2::bigint)) v(run)", x
    )
    out["sink_append"] = out["sessions_bookmarked"]
    out["sink_overwrite"] = statement("from fact_actions_live")
    out["schema_contract"] = out["sessions_viewed"]
    out["stream_bookmarks"] = out["sessions_bookmarked"]
    out["stream_bookmarks_redelivered"] = out["sessions_bookmarked"]
    out["stream_batch_replace"] = statement("from fact_actions_live")
    out["stream_batch_corrected"] = statement(
        """select * replace (case when batch_id % 5 = 0 then 'final' else session_id end as session_id)
           from fact_actions_live where batch_id % 5 = 0 or batch_id % 2 <> 0 or identifier <> 'likeButton'"""
    )
    # combine, scores, leads
    for place in range(1, 7):
        out[f"combine_{place}"] = statement(f"from c{place}", x, dense)
    out["combine_6_recent"] = statement("from s6", x, sparse)
    full = combine_sql(720, prefix="f")
    full["f6"] = full["f6"].replace("left join", "full join")
    out["combine_6_full"] = statement("from f6", x, full)
    out["combine_6_split"] = out["combine_6_full"]
    single = combine_sql(72, prefix="o", min_views=1)
    out["combine_6_single_views"] = statement("from o6", x, single)
    for name, how in (("combine_summed_6", "left"), ("combine_summed_full", "full")):
        out[name] = statement("from summed", x, summed_sql(720, how))
    out["lead_scores_summed"] = statement(
        "select * replace (round(zscore, 6) as zscore) from scores", x, summed_sql(720, "left"), scores_sql("summed", "")
    )
    out["actions_stag"] = statement("select *, cast(1 as bigint) as batchid from c6", x, dense)
    scored = scores_sql("c6", "")
    out["range_score"] = statement("select * exclude (score), round(score, 6) as zscore from scored", x, dense, scored)
    out["lead_scores"] = statement("select * replace (round(zscore, 6) as zscore) from scores", x, dense, scored)
    recent = scores_sql("s6", "")
    out["lead_scores_recent"] = statement("select * replace (round(zscore, 6) as zscore) from scores", x, sparse, recent)
    out["title_bucket"] = statement(
        f"select globaluserid, title as detailed_title, {_TITLE} as title from ratings_globaluserdetails"
    )
    zscore = "round(s.zscore, 6) as zscore"
    out["leads"] = statement(leads_sql("scores", "inner", zscore), x, dense, scored)
    second = {**scores_sql("s6", "", 2)}
    out["latest_batch_leads"] = statement(leads_sql("scores", "inner", zscore), x, sparse, second)
    out["new_leads"] = out["latest_batch_leads"]
    loaded, first, later = two_loads_sql()
    out["lead_run_twice"] = statement(
        f"""{leads_sql("first_scores", "inner", zscore)}
            union all by name {leads_sql("later_scores", "inner", zscore)}""",
        loaded, first, later, scores_sql("p6", "first_", 1), scores_sql("s6", "later_", 2),
    )
    seen = tuple(m for m in METRICS if m != "num_checkins")
    flat = scores_sql("(select * replace (cast(0 as bigint) as num_checkins) from c6)", "")
    out["lead_scores_without_flat"] = statement(
        "select * replace (round(zscore, 6) as zscore) from scores", x, dense, flat | {"scored": _score("filled", seen, "0.0")}
    )
    out["sessions_speakers_viewed_once"] = statement(
        _touch(
            "fact_views_live", "num_views", "item", "speaker_tracks", "speakerid",
            where="""and lower(e.global_user_id) in (select lower(globaluserid) from authdb_is_users)
                     and lower(e.global_user_id) in (select lower(globaluserid) from ratings_globaluserdetails)""",
        )
    )
    out["incremental_bootstrap"] = out["sessions_bookmarked"]
    out["csv_inferred"] = out["csv_roundtrip"]
    # topics
    actions = {"actions": "select *, cast(1 as bigint) as batchid from c6"}
    semantic = semantic_sql("actions")
    out["semantic_actions"] = statement("from tagged", x, dense, actions, semantic)
    out["semantic_gate"] = statement("from gated", x, dense, actions, semantic)
    out["topic_scores"] = statement("select * replace (round(V18, 6) as V18) from topic_scores", x, dense, actions, semantic)
    out["topic_leads"] = statement(
        leads_sql("topic_scores", "left", "round(s.V18, 6) as z_score", "s.semantic_topic,"), x, dense, actions, semantic
    )
    out["topic_run_scores"], out["topic_run_leads"] = out["topic_scores"], out["topic_leads"]
    out["topic_sides"] = statement(
        """select itemid, topic, bool_or(m) as manual, bool_or(not m) as generated from (
             select itemid, lower(topic) as topic, true as m from session_topics_manual
             union all select itemid, lower(topic), false from session_tags_v0)
           where itemid in (select itemid from session_topics_manual) and itemid in (select itemid from session_tags_v0)
           group by itemid, topic"""
    )
    out["topic_matches"] = statement("from matched", VALIDATION)
    out["topic_misses"] = statement("from missed", VALIDATION)
    out["topic_totals"] = statement("from totals", VALIDATION)
    out["topic_validation"] = statement(
        'select * replace (round("precision", 6) as "precision", round(recall, 6) as recall) from validation', VALIDATION
    )
    out["topic_validation_run"] = out["topic_validation"]
    out["pr_correlation"] = statement(
        """select 'r =  ' || regexp_replace(cast(cast(round_even(corr(recall, "precision"), 2) as double) as varchar), '\\.0$', '') as label
           from validation""",
        VALIDATION,
    )
    out["pr_histogram"] = statement(
        """select measure, cast(ceil(round(v / 0.1::double - 0.5, 9)) as bigint) as bin, count(*) as frequency,
                  round(cast(ceil(round(v / 0.1::double - 0.5, 9)) as bigint) * 0.1::double, 9) as bin_centre
           from (select 'recall' as measure, recall as v from validation union all select 'precision', "precision" from validation)
           group by all""",
        VALIDATION,
    )
    out["pr_linear_fit"] = statement(
        """select round(slope, 6) as slope, round(intercept, 6) as intercept, round(r2, 6) as r2, n,
                  round(sxx, 6) as sxx, round(syy, 6) as syy, round(x_mean, 6) as x_mean,
                  round(sqrt(syy * (1 - r2) / (n - 2)), 6) as residual_se,
                  round(sqrt(syy * (1 - r2) / (n - 2)) / sqrt(sxx), 6) as slope_se
           from (select regr_slope("precision", recall) as slope, regr_intercept("precision", recall) as intercept,
                        regr_r2("precision", recall) as r2, cast(regr_count("precision", recall) as bigint) as n,
                        regr_sxx("precision", recall) as sxx, regr_syy("precision", recall) as syy,
                        regr_avgx("precision", recall) as x_mean from validation)""",
        VALIDATION,
    )
    # Student's t by its finite sums for whole degrees of freedom, inverted by halving
    band = {
        "fit": """
            select regr_slope("precision", recall) as slope, regr_intercept("precision", recall) as intercept,
                   regr_r2("precision", recall) as r2, cast(regr_count("precision", recall) as bigint) as n,
                   regr_sxx("precision", recall) as sxx, regr_syy("precision", recall) as syy, regr_avgx("precision", recall) as x_mean,
                   min(recall) as low, max(recall) as high
            from validation where recall is not null and "precision" is not null""",
        "terms": """
            select n - 2 as freedom, list(k order by k) as ks, list(c order by k) as cs
            from (select n, k, exp(sum(case when k = 0 then 0 when n % 2 = 0 then ln((2.0 * k - 1) / (2.0 * k)) else ln(2.0 * k / (2.0 * k + 1)) end)
                                   over (order by k)) as c
                  from fit, unnest(range(0, greatest(cast(floor((n - 2) / 2) as bigint), 1))) t(k))
            group by n""",
        "halving": """
            select 0 as step, 0.0::double as low, 64.0::double as high
            union all
            select step + 1, case when share < 0.95 then middle else h.low end, case when share < 0.95 then h.high else middle end
            from (select step, h.low, h.high, (h.low + h.high) / 2 as middle, atan((h.low + h.high) / 2 / sqrt(freedom)) as theta,
                         case when freedom % 2 = 0 then sin(theta) * list_sum(list_transform(ks, lambda k: cs[k + 1] * pow(cos(theta), 2 * k)))
                              when freedom = 1 then 2 / pi() * theta
                              else 2 / pi() * (theta + sin(theta) * cos(theta) * list_sum(list_transform(ks, lambda k: cs[k + 1] * pow(cos(theta), 2 * k))))
                         end as share
                  from halving h, terms where step < 80) h""",
    }
    out["pr_fit_band"] = statement(
        """select cast(i as integer) as point, round(x, 6) as x, round(fitted, 6) as fitted, round(fitted_se, 6) as fitted_se,
                  round(fitted - t * fitted_se, 6) as lower, round(fitted + t * fitted_se, 6) as upper
           from (select i, low + (high - low) * i / 79 as x, intercept + slope * x as fitted,
                        sqrt(syy * (1 - r2) / (n - 2)) * sqrt(1 / n + (x - x_mean) * (x - x_mean) / sxx) as fitted_se, t
                 from fit, unnest(range(0, 80)) u(i), (select high as t from halving order by step desc limit 1))""",
        VALIDATION,
        band,
    ).replace("with ", "with recursive ", 1)
    out["score_profile"] = statement(
        """select measure, count(v) as n, round(avg(v), 6) as mean, round(stddev_samp(v), 6) as sd, round(min(v), 6) as low,
                  round(max(v), 6) as high, (select round(corr(svd_social, svd_content), 6) from score_pairs) as correlation
           from (select 'svd_social' as measure, svd_social as v from score_pairs
                 union all select 'svd_content', svd_content from score_pairs) group by measure"""
    )
    pair_score = {
        "pair_scored": _score("score_pairs", ("svd_social", "svd_content"), "null"),
        "pair_graded": _graded("pair_scored", 0.2, 0.8),
    }
    out["score_pairs_graded"] = statement(
        """select vec_id, round(svd_social, 6) as svd_social, round(svd_content, 6) as svd_content, round(score, 6) as score,
                  grade_score from pair_graded""",
        pair_score,
    )
    # event health and mailing
    ratio_names = ("percentengaged", "percentpost", "percentlikes", "percentcomments", "percentcheckins")
    rounded = ", ".join(f"round({c}, 6) as {c}" for c in ratio_names)
    out["event_ratios"] = statement(f"select * replace ({rounded}) from rated", HEALTH)
    out["event_score"] = statement(f"select * replace ({rounded}, round(score, 6) as score) from health_scored", HEALTH)
    out["event_grade"] = statement(f"select * replace ({rounded}, round(score, 6) as score) from health", HEALTH)
    out["outreach_percent"] = statement("from headline", HEALTH)
    out["outreach_messages"] = statement(
        """select emailaddress as recipient, 'news@example.com' as from_email, 'The events team' as from_name,
                  'Event activity report' as subject, 'activity_report' as template, '["activity_report"]' as tags,
                  '[{"name":"PERCENT","content":"' || cast(percent as varchar) || '%"},{"name":"USER_NAME","content":"'
                    || firstname || '"}]' as vars, true as track_clicks, true as track_opens
           from ratings_globaluserdetails, headline""",
        HEALTH,
    )
    # experiment
    ex = (x, dense, actions, experiment_sql("actions"))
    out["experiment_base"] = statement("from base", *ex)
    out["experiment_base_apps"] = statement("from base where applicationid in ('app-1', 'app-3')", *ex)
    out["topic_interest"] = statement("select * replace (round(score, 6) as score) from interest", *ex)
    out["top_topic"] = statement("from top", *ex)
    out["topic_pairs"] = statement("from identified", *ex)
    out["control_pool"] = statement("from pool", *ex)
    out["control_split"] = statement("from split", *ex)
    out["topic_high_low"] = statement("from popular", *ex)
    out["cohort_high_low"] = statement("from by_popularity", *ex)
    out["cohort_random"] = statement("from by_chance", *ex)
    out["cohorts"] = statement("from all_cohorts", *ex)
    out["cohorts_named"] = statement("from named", *ex)
    out["cohort_payload_run"] = out["cohorts_named"]
    out["cohort_slice"] = statement("from named where applicationid = 'app-3'", *ex)
    out["chat_payload_json"] = statement(
        """select '{"userid":' || userid || ',"applicationid":"' || applicationid || '","topic_1":"' || topic_1
                  || '","topic_2":"' || topic_2 || '","identification_type":"' || identification_type
                  || '","event_name":"' || event_name || '"}' as json from named""",
        *ex,
    )
    counted = "select application_id, body, count(*) as responses from chat_responses {0} group by all"
    out["response_tally"] = statement(counted.format("where body in ('1', '2')"))
    out["response_tally_all"] = statement(counted.format(""))
    out["chat_responses_scan"] = statement("from chat_responses")
    return out
