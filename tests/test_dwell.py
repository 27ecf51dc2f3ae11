"""Which events end a dwell, and what a dwell is."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest

from zealmark.operators.dwell import event_dwell, event_lag
from zealmark.operators.ordered import CHUNK, cut_hot_groups

SCHEMA = (
    "application_id string, global_user_id string, session_id string, created timestamp_ntz, identifier string, "
    "metadata string, batch_id bigint, event_id bigint"
)


def event(no, minute, kind, item=None, session="s", user="u"):
    meta = None if kind == "session" else ("{}" if item is None else f'{{"ItemId": {item}}}')
    at = datetime(2024, 1, 1, 10) + timedelta(minutes=minute)
    return ("a", user, session, str(at), kind, meta, 1, no)


def kept(frame, events, **options):
    views = [e for e in events if e[4] != "session"]
    other = [e for e in events if e[4] == "session"]
    out = event_dwell(frame(views, SCHEMA), frame(other, SCHEMA), **options)
    return {r.event_id: r.dwell_us for r in out.collect()}


def test_second_item_in_a_row_is_dropped_and_the_first_goes_on(frame):
    got = kept(frame, [event(1, 0, "item", 1), event(2, 5, "item", 2), event(3, 20, "session")])
    assert got == {1: 20 * 60 * 10**6, 3: None}


def test_item_after_list_without_item_is_kept(frame):
    assert kept(frame, [event(1, 0, "list"), event(2, 1, "item", 1)]) == {1: 60 * 10**6, 2: None}


def test_item_after_list_with_another_item_is_kept(frame):
    assert set(kept(frame, [event(1, 0, "list", 1), event(2, 1, "item", 2)])) == {1, 2}


def test_item_after_list_with_the_same_item_is_dropped(frame):
    assert kept(frame, [event(1, 0, "list", 1), event(2, 1, "item", 1)]) == {1: None}


def test_first_event_and_events_of_other_visits_are_kept(frame):
    events = [event(1, 0, "item", 1), event(2, 1, "item", 2, session="t"), event(3, 2, "item", 3, user="v")]
    assert kept(frame, events) == {1: None, 2: None, 3: None}


def test_missing_kind_is_kept_only_after_no_item(frame):
    events = [event(1, 0, "item", 1), event(2, 1, None, 2), event(3, 2, "session"), event(4, 3, None, 5)]
    assert set(kept(frame, events)) == {1, 3, 4}


def test_equal_times_follow_the_event_id(frame):
    events = [event(2, 0, "item", 1), event(1, 0, "list")]
    assert kept(frame, events) == {1: 0, 2: None}


def test_item_id_that_is_no_number_counts_as_none(frame):
    bad = ("a", "u", "s", "2024-01-01 09:00:00", "item", '{"ItemId": "x"}', 1, 1)
    assert set(kept(frame, [bad, event(2, 1, "item", 1)])) == {1, 2}


def _many(seed):
    rng = random.Random(seed)
    out, minute = [], 0
    for no in range(400):
        minute += rng.choice([0, 0, 1, 3])
        kind = rng.choice(["item", "item", "list", "session"])
        item = rng.choice([None, 1, 2, 3]) if kind == "list" else rng.randint(1, 3)
        session = rng.choice(["hot", "hot", "hot", None, None, "cold"])
        out.append(event(no, minute, kind, item, session=session))
    return out


def _by_hand(events):
    visits = {}
    for e in sorted(events, key=lambda e: (datetime.fromisoformat(e[3]), e[7])):
        visits.setdefault(e[2], []).append(e)
    out = {}
    for rows in visits.values():
        steps, before = [], None
        for e in rows:
            item = None if e[5] in (None, "{}") else int(e[5].split(":")[1].strip(" }"))
            if before is None or before[1] is None or e[4] != "item" or (before[0] != "item" and before[1] != item):
                steps.append(e)
            before = (e[4], item)
        for this, after in zip(steps, [*steps[1:], None]):
            gap = after and datetime.fromisoformat(after[3]) - datetime.fromisoformat(this[3])
            out[this[7]] = None if after is None else round(gap.total_seconds() * 10**6)
    return out


@pytest.mark.parametrize("limit", [7, 50, 10**6])
def test_cut_groups_give_the_same_dwell(frame, limit):
    events = _many(limit)
    assert kept(frame, events, group_limit=limit) == _by_hand(events)


def test_cut_groups_give_the_same_neighbours(frame, collected):
    events = _many(3)
    views = frame([e for e in events if e[4] != "session"], SCHEMA)
    other = frame([e for e in events if e[4] == "session"], SCHEMA)
    assert collected(event_lag(views, other, group_limit=9)) == collected(event_lag(views, other))


@pytest.mark.parametrize("limit", [1, 4, 40])
def test_one_time_is_no_limit(frame, limit):
    """Three hundred events of one visit at one time, with ids near and far apart, and a few minutes around them."""
    rng = random.Random(limit)
    ids = rng.sample(range(-500, 500), 200) + [rng.randrange(-(2**62), 2**62) for _ in range(100)]
    events = [event(no, 30, rng.choice(["item", "list"]), rng.randint(1, 3), session="s") for no in ids]
    events += [event(10**6 + no, minute, "item", 1, session="s") for no, minute in enumerate([0, 10, 20, 40, 50])]
    assert kept(frame, events, group_limit=limit) == _by_hand(events)


def test_no_chunk_is_much_larger_than_the_limit(frame):
    events = [event(no, 30 if no % 3 else no, "item", 1, session="s") for no in range(400)]
    cut, any_cut = cut_hot_groups(frame(events, SCHEMA), ["session_id"], "created", 20, "event_id")
    sizes = [r["count"] for r in cut.groupBy("session_id", CHUNK).count().collect()]
    assert any_cut and sum(sizes) == 400 and max(sizes) < 40
