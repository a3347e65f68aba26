"""Each event's decision is written once, however many rounds its world takes; chains longer than a put-together too."""

from tallyframe.operators import event_times


def test_decisions_are_written_once(spark, monkeypatch):
    written, given = [], event_times.stored

    def counted(df):
        out = given(df)
        if "state" in out.columns:
            written.append(out.count())
        return out

    monkeypatch.setattr(event_times, "stored", counted)
    rows = [(w, f"e{k}", None, "UTC", "2024-01-01 09:00:00" if k == 0 else None, False, 60, f"e{k - 1}" if k else None, 1 if k else None, "10:00" if k else None) for w in range(3) for k in range(4)]
    frame = spark.createDataFrame(rows, "world long, event string, authority int, zone string, when string, date_only boolean, minutes int, anchor string, offset_days int, at string")
    frame = frame.withColumn("when", frame["when"].cast("timestamp"))
    assert {(r.world, r.event): (r.state, r.start.day) for r in event_times.event_intervals(frame).collect()} == {(w, f"e{k}"): ("known", 1 + k) for w in range(3) for k in range(4)}
    assert sum(written) == 12
    monkeypatch.setattr(event_times, "TOGETHER", 2)
    assert event_times.event_intervals(frame).where("state = 'known'").count() == 12
