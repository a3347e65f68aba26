"""Event times against recursion: chains, cycles, ties of authority, zones, days that are 23 or 25 hours long."""

import random
from datetime import datetime, time, timedelta
from zoneinfo import ZoneInfo

from tallyframe.operators import event_times

UTC = ZoneInfo("UTC")
KIND = "world long, event string, authority int, zone string, when timestamp, date_only boolean, minutes int, anchor string, offset_days int, at string"


def interval(s, events, path):
    if s["anchor"]:
        state, start, _ = decided(s["anchor"], events, path)
        if state == "waits":
            return "waits"
        if state != "known":
            return None
        local = datetime.combine(start.astimezone(ZoneInfo(s["zone"])).date() + timedelta(days=s["offset_days"]), time.fromisoformat(s["at"]))
        length = s["minutes"] or 0
    elif s["when"] is None:
        return None
    else:
        local, length = (datetime.combine(s["when"].date(), time(0)), 1440) if s["date_only"] else (s["when"], s["minutes"] or 0)
    start = local.replace(tzinfo=ZoneInfo(s["zone"]))
    return start.astimezone(UTC), (start + timedelta(minutes=length)).astimezone(UTC)


def decided(event, events, path=()):
    """State and interval; `waits` inside a cycle."""
    if event in path:
        return "waits", None, None
    own = events.get(event, [])
    if not own:
        return "unknown", None, None
    top = max(1 if s["authority"] is None else s["authority"] for s in own)
    found = [interval(s, events, (*path, event)) for s in own if (1 if s["authority"] is None else s["authority"]) == top]
    if any(f is None for f in found):
        return "unknown", None, None
    if "waits" in found:
        return "waits", None, None
    return ("conflict", None, None) if len(set(found)) > 1 else ("known", *found[0])


def source(event, zone="UTC", when=None, authority=None, anchor=None, **more):
    return {"event": event, "authority": authority, "zone": zone, "when": when, "date_only": None, "minutes": None, "anchor": anchor, "offset_days": None, "at": None} | more


def frame(spark, worlds):
    names = [c.split()[0] for c in KIND.split(", ")][1:]
    return spark.createDataFrame([(w, *[s[n] for n in names]) for w, sources in worlds.items() for s in sources], KIND)


def test_same_as_recursion(spark):
    random.seed(7)
    zones = ["America/New_York", "Europe/London", "Asia/Tokyo", "Australia/Sydney", "UTC"]
    worlds = {}
    for w in range(150):
        names = [f"e{k}" for k in range(random.randint(1, 7))]
        worlds[w] = []
        for n in names:
            for _ in range(random.choice([1, 1, 1, 2, 3])):
                more = {"authority": random.choice([None, 1, 1, 2])}
                if random.random() < 0.55:
                    more |= {"anchor": random.choice([*names, "nobody"]), "offset_days": random.randint(-3, 3), "at": f"{random.randint(0, 23):02d}:{random.choice(['00', '30'])}", "minutes": random.choice([None, 30, 2000])}
                elif random.random() < 0.9:
                    more |= {"when": datetime(2026, random.choice([3, 10, 11]), random.randint(1, 28), random.randint(0, 23), 30), "date_only": random.choice([None, False, True]), "minutes": random.choice([None, 60, 14 * 1440])}
                worlds[w].append(source(n, random.choice(zones), **more))
    got = {(r.world, r.event): r for r in event_times.event_intervals(frame(spark, worlds)).collect()}
    states = set()
    for w, sources in worlds.items():
        events = {}
        for s in sources:
            events.setdefault(s["event"], []).append(s)
        for e in events:
            state, start, end = decided(e, events)
            r = got.pop((w, e))
            states.add(r.state)
            if state == "known":
                assert (r.state, r.start.replace(tzinfo=UTC), r.end.replace(tzinfo=UTC)) == (state, start, end), (w, e, sources)
            else:
                assert (r.state, r.start, r.end) == ("cyclic" if state == "waits" else state, None, None), (w, e, sources)
    assert not got and states == {"known", "unknown", "conflict", "cyclic"}


def test_relations(spark):
    day = lambda k, h=0: datetime(2026, 3, k, h)
    worlds = {None: [source("a", when=day(1), minutes=60), source("b", when=day(1, 1), minutes=60)], 1: [source("a", when=day(2), date_only=True), source("b", when=day(2, 9), minutes=30)], 2: [source("a", when=day(2), minutes=90), source("b", when=day(2, 1), minutes=90), source("b", when=day(3), minutes=90)], 3: [source("a", when=day(2), minutes=90), source("b", when=day(2, 1), minutes=90)]}
    found = event_times.event_intervals(frame(spark, worlds))
    asked = spark.createDataFrame([(None, "a", "b"), (None, "b", "a"), (1, "b", "a"), (1, "a", "c"), (2, "a", "b"), (3, "a", "b"), (9, "a", "b")], "world long, a string, b string")
    got = {(r.world, r.a, r.b): (r.relation, r.reason) for r in event_times.relations(asked, found).collect()}
    assert got == {
        (None, "a", "b"): ("before", "a_ends_before_b_starts"), (None, "b", "a"): ("after", "a_starts_after_b_ends"), (1, "b", "a"): ("during", "a_within_b"), (1, "a", "c"): ("unknown", "missing_or_underspecified_time"),
        (2, "a", "b"): ("conflicting", "conflicting_timestamps"), (3, "a", "b"): ("unknown", "partial_overlap_or_underspecified"), (9, "a", "b"): ("unknown", "missing_or_underspecified_time"),
    }


def test_no_sources(spark):
    empty = spark.createDataFrame([], KIND)
    assert event_times.event_intervals(empty).count() == 0
