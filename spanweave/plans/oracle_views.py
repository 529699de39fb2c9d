"""The derived views as SQL, for the oracles."""

FRAMES = """frames AS (SELECT user_id AS source_id, event_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS frame FROM events)"""
EVENTS = """ev AS (SELECT user_id AS source_id, event_id, event_type AS category,
  CASE WHEN event_id % 7 = 0 THEN 'full_scene' WHEN event_id % 11 = 0 THEN 'overlay' ELSE 'local_redaction' END AS role,
  event_id * 53 % 2000 AS s, event_id * 53 % 2000 + 1 + event_id % 9 AS e FROM events)"""
CUTS = """cuts AS (SELECT source_id, a, a + 5 + source_id % 6 AS b, a - coalesce(sum(5 + source_id % 6) OVER (PARTITION BY source_id ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS boundary, 5 + source_id % 6 AS len
  FROM (SELECT DISTINCT user_id AS source_id, 100 + k * 400 + user_id % 37 AS a FROM events, range(0, 5) t(k)))"""
REGIONS = (
    FRAMES
    + """, regions AS (SELECT source_id, frame, o AS ord, 'U' || CAST(frame % 5 AS VARCHAR) AS region_id,
  100 + source_id % 50 + event_id * 37 % 12 + o * 3 AS x, 200 + event_id * 91 % 10 + o * 2 AS y, 60 + event_id * 13 % 30 AS w, 20 + event_id * 7 % 8 AS h,
  CASE event_id % 3 WHEN 0 THEN 'ocr' WHEN 1 THEN 'tracked' ELSE 'backfilled' END AS origin,
  CASE WHEN event_id % 10 = 0 THEN 'line_fallback' ELSE 'characters' END AS box_method,
  CASE event_id % 4 WHEN 0 THEN '0.94' WHEN 1 THEN '1.06' ELSE '1.0' END AS scale, value / 500 AS confidence
  FROM frames, range(0, 2) t(o) WHERE o <= event_id % 2)"""
)
