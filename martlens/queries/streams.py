"""Windows and sessions of events: as streams, drained, against the SQL without what the watermark keeps open; and in batch.

st01, st04 and st05 are streams, st02 and st03 the same functions over a batch.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from martlens.streaming import events as E


def _path(d: str) -> str:
    return f"{d}/events.parquet"


def _daily(s, d):
    out = E.drain(E.windowed(E.read_events(s, _path(d))))
    return out.selectExpr("CAST(window_start AS date) AS day", "event_type", "events", "value")


def _hourly_slide(s, d):
    out = E.windowed(E.read_events(s, _path(d), stream=False), "6 hours", "3 hours")
    return out.selectExpr("CAST(window_start AS timestamp_ntz) AS window_start", "event_type", "events", "value")


def _sessions(s, d):
    out = E.sessions(E.read_events(s, _path(d), stream=False))
    return out.groupBy("user_id").agg(F.max("events").alias("most_events"), F.count("*").alias("sessions"))


def _sliding_stream(s, d):
    out = E.drain(E.windowed(E.read_events(s, _path(d)), "6 hours", "3 hours"))
    return out.selectExpr("CAST(window_start AS timestamp_ntz) AS window_start", "event_type", "events", "value")


def _session_stream(s, d):
    out = E.drain(E.sessions(E.read_events(s, _path(d))))
    return out.selectExpr("user_id", "CAST(session_start AS timestamp_ntz) AS session_start", "events")


QUERIES = {
    "st01_daily_windows": _daily, "st02_sliding_windows": _hourly_slide, "st03_sessions": _sessions,
    "st04_sliding_stream": _sliding_stream, "st05_session_stream": _session_stream,
}
ORACLE = {
    "st01_daily_windows": """WITH m AS (SELECT max(ts) - INTERVAL 1 HOUR AS mark FROM events)
        SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS events, round(sum(value), 2) AS value FROM events, m
        WHERE CAST(ts AS DATE) + INTERVAL 1 DAY <= mark GROUP BY 1, 2""",
    "st02_sliding_windows": """WITH w AS (SELECT time_bucket(INTERVAL 3 HOUR, ts, TIMESTAMP '1970-01-01') - o * INTERVAL 3 HOUR AS window_start, event_type, value FROM events, (VALUES (0), (1)) AS t(o))
        SELECT window_start, event_type, count(*) AS events, round(sum(value), 2) AS value FROM w GROUP BY 1, 2""",
    "st03_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
        s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM g), c AS (SELECT user_id, n, count(*) AS events FROM s GROUP BY 1, 2)
        SELECT user_id, max(events) AS most_events, count(*) AS sessions FROM c GROUP BY 1""",
    "st04_sliding_stream": """WITH m AS (SELECT max(ts) - INTERVAL 1 HOUR AS mark FROM events),
        w AS (SELECT time_bucket(INTERVAL 3 HOUR, ts, TIMESTAMP '1970-01-01') - o * INTERVAL 3 HOUR AS window_start, event_type, value FROM events, (VALUES (0), (1)) AS t(o))
        SELECT window_start, event_type, count(*) AS events, round(sum(value), 2) AS value FROM w, m WHERE window_start + INTERVAL 6 HOUR <= mark GROUP BY 1, 2""",
    "st05_session_stream": """WITH m AS (SELECT max(ts) - INTERVAL 1 HOUR AS mark FROM events),
        g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
        s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM g)
        SELECT user_id, min(ts) AS session_start, count(*) AS events FROM s, m GROUP BY user_id, n, mark HAVING max(ts) + INTERVAL 6 HOUR <= mark""",
}
