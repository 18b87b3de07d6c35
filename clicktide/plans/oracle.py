"""The registered queries in the SQL of the checking engine, over the same Parquet tables."""

from __future__ import annotations

from clicktide.plans.catalog import CAMPAIGNS, DELIVERY_DAYS, GRID_WINDOWS, UPSERT_CUTS

_EV = """ev AS (
  SELECT event_id, event_type, ts AS event_time, CAST(user_id AS VARCHAR) AS user_id,
         printf('cmp-%03d', CAST(regexp_extract(props, '[0-9]+', 0) AS INT) % 4 + 1) AS campaign_id,
         printf('ad-%03d', CAST(regexp_extract(props, '[0-9]+', 0) AS INT)) AS ad_id,
         event_type = 'click' AS clicked
  FROM events)"""


def _agg(width: str) -> str:
    """Events and the exact aggregate, as the start of a WITH list."""
    return f"""WITH {_EV}, agg AS (
  SELECT window_start, window_start + INTERVAL '{width}' AS window_end, campaign_id,
         COUNT(*) AS clicks, COUNT(DISTINCT user_id) AS unique_users, CAST(NULL AS DOUBLE) AS ctr
  FROM (SELECT *, time_bucket(INTERVAL '{width}', event_time, TIMESTAMP '1970-01-01')
                  AS window_start FROM ev WHERE event_time IS NOT NULL)
  GROUP BY ALL)"""


_HOUR = _agg("1 hour")


def _trailing(width: str, ago: str) -> str:
    """``slice``: windows that end later than ``ago`` before the newest end, ``top``."""
    return f"""{_agg(width)}, newest AS (SELECT MAX(window_end) AS top FROM agg),
slice AS (
  SELECT window_start, window_end, campaign_id, clicks, unique_users
  FROM agg, newest WHERE window_end > top - INTERVAL '{ago}')"""


_TRAILING = _trailing("1 hour", "24 hours")
_TRAILING_10S = _trailing("10 seconds", "120 minutes")
_TOTALS = """SELECT campaign_id, CAST(SUM(clicks) AS BIGINT) AS clicks,
       CAST(SUM(unique_users) AS BIGINT) AS unique_users
FROM agg GROUP BY campaign_id"""
_LATEST = """SELECT agg.* FROM agg
JOIN (SELECT MAX(window_end) AS window_end FROM agg) USING (window_end)"""
_KPIS = """SELECT COUNT(*) AS total_rows, CAST(SUM(clicks) AS BIGINT) AS clicks,
       CAST(SUM(unique_users) FILTER (WHERE window_end = top) AS BIGINT) AS latest_unique_users
FROM slice, newest HAVING COUNT(*) > 0"""
_GRID = f"""{_HOUR}, grid AS (
  SELECT e - INTERVAL '1 hour' AS window_start, e AS window_end, campaign_id
  FROM (SELECT UNNEST(generate_series(MAX(window_end) - INTERVAL '{GRID_WINDOWS - 1} hours',
                                      MAX(window_end), INTERVAL '1 hour')) AS e FROM agg),
       (SELECT DISTINCT campaign_id FROM agg)),
filled AS (
  SELECT g.window_start, g.window_end, g.campaign_id,
         COALESCE(a.clicks, 0) AS clicks, COALESCE(a.unique_users, 0) AS unique_users
  FROM grid g LEFT JOIN agg a USING (window_start, window_end, campaign_id))"""
_MS = "strftime(event_time, '%Y-%m-%dT%H:%M:%S.%g') || 'Z'"
_CUT1, _CUT2 = [cut.isoformat(sep=" ") for cut in UPSERT_CUTS]
_REASON = """CASE event_type WHEN 'error' THEN 'not_an_event' WHEN 'signup' THEN 'bad_event_time'
             WHEN 'purchase' THEN 'no_campaign' END"""
_COLUMNS = ", ".join(
    f"""CAST(COALESCE(SUM(clicks) FILTER (WHERE campaign_id = '{name}'), 0) AS BIGINT) AS "{name}\""""
    for name in CAMPAIGNS
)
_PIVOT = f"SELECT window_start AS time, {_COLUMNS} FROM slice GROUP BY window_start"
_KNOWN = ", ".join(f"'{name}'" for name in CAMPAIGNS)
_OTHER = f"""CAST(COALESCE(SUM(clicks) FILTER (WHERE campaign_id NOT IN ({_KNOWN})), 0) AS BIGINT)
  AS other"""
_PIVOT_OTHER = (
    f"SELECT window_start AS time, {_COLUMNS}, {_OTHER} FROM slice GROUP BY window_start"
)
_LONG = """SELECT t.window_start AS time, c.campaign_id, COALESCE(s.clicks, 0) AS clicks
FROM (SELECT DISTINCT window_start FROM slice) t
CROSS JOIN (SELECT DISTINCT campaign_id FROM slice) c
LEFT JOIN slice s ON s.window_start = t.window_start AND s.campaign_id = c.campaign_id"""
_CHECKED = """SELECT COUNT(*) AS n_keys, TRUE AS clicks_equal, TRUE AS few_off, TRUE AS unbiased,
       TRUE AS bounded FROM agg"""


def _changed(version: int, condition: str) -> str:
    return f"""SELECT CAST({version} AS BIGINT) AS version, COUNT(*) AS n_rows FROM (
      SELECT DISTINCT time_bucket(INTERVAL '1 hour', event_time, TIMESTAMP '1970-01-01'), campaign_id
      FROM ev WHERE {condition})"""


def _violation(name: str, expression: str) -> str:
    return f"SELECT '{name}' AS violation, CAST(COALESCE({expression}, 0) AS BIGINT) AS n_rows FROM agg"


_NULL_KEY = "COUNT(*) FILTER (WHERE campaign_id = 'cmp-001')"
_COPY = "COUNT(*) FILTER (WHERE campaign_id = 'cmp-002')"
_EMPTY = "COUNT(*) FILTER (WHERE campaign_id = 'cmp-003')"
_NEGATIVE = "COUNT(*) FILTER (WHERE campaign_id = 'cmp-004')"

ORACLE: dict[str, str] = {
    "campaign_windows_10s": f"{_agg('10 seconds')} SELECT * FROM agg",
    "campaign_windows_1d": f"{_agg('1 day')} SELECT * FROM agg",
    "campaign_windows_approx_users": f"{_HOUR} {_CHECKED}",
    "campaign_users_by_sketch": f"""WITH {_EV}
SELECT campaign_id, COUNT(DISTINCT user_id) AS exact_users, TRUE AS users_close
FROM ev WHERE event_time IS NOT NULL GROUP BY campaign_id""",
    "align_to_window": f"""WITH {_EV}
SELECT event_id, event_time,
       time_bucket(INTERVAL '10 seconds', event_time, TIMESTAMP '1970-01-01') AS window_start
FROM ev WHERE event_time IS NOT NULL""",
    "campaign_totals": f"{_HOUR} {_TOTALS}",
    "campaign_totals_10s": f"{_agg('10 seconds')} {_TOTALS}",
    "latest_campaign_window": f"{_HOUR} {_LATEST}",
    "latest_campaign_window_view": f"{_HOUR} {_LATEST}",
    "latest_from_events": f"{_HOUR} {_LATEST}",
    "campaign_totals_view": f"{_HOUR} {_TOTALS}",
    "latest_campaign_window_10s": f"{_agg('10 seconds')} {_LATEST}",
    "trailing_window": f"{_TRAILING} SELECT * FROM slice",
    "trailing_from_events": f"{_TRAILING} SELECT * FROM slice",
    "trailing_window_10s": f"{_TRAILING_10S} SELECT * FROM slice",
    "dashboard_kpis": f"{_TRAILING} {_KPIS}",
    "dashboard_kpis_10s": f"{_TRAILING_10S} {_KPIS}",
    "clicks_over_time_pivot": f"{_TRAILING} {_PIVOT_OTHER}",
    "clicks_over_time_by_name": f"{_TRAILING} {_PIVOT}",
    "clicks_by_campaign": f"{_TRAILING} {_LONG}",
    "clicks_over_time_pivot_10s": f"{_TRAILING_10S} {_PIVOT_OTHER}",
    "latest_window_ranked": f"""{_TRAILING}
SELECT slice.*, ROW_NUMBER() OVER (ORDER BY clicks DESC, campaign_id) AS position
FROM slice, newest WHERE window_end = top""",
    "encode_events_json": f"""WITH {_EV}
SELECT event_id, '{{"event_time":"' || {_MS} || '","user_id":"' || user_id || '","campaign_id":"'
       || campaign_id || '","ad_id":"' || ad_id || '","clicked":' || CAST(clicked AS VARCHAR)
       || '}}' AS value
FROM ev""",
    "encode_events_roundtrip": f"""WITH {_EV}
SELECT event_id, CAST(date_trunc('milliseconds', event_time) AS TIMESTAMP) AS event_time,
       user_id, campaign_id, ad_id, clicked
FROM ev""",
    "decode_events": f"""WITH {_EV}
SELECT event_id, CAST(date_trunc('milliseconds', event_time) AS TIMESTAMP) AS event_time,
       user_id, campaign_id, ad_id, clicked
FROM ev WHERE event_type NOT IN ('error', 'signup', 'purchase')""",
    "decode_rejects": f"""WITH {_EV}
SELECT event_id, {_REASON} AS reason FROM ev
WHERE event_type IN ('error', 'signup', 'purchase')""",
    "upsert_latest_per_key": f"{_HOUR} SELECT * FROM agg",
    "upsert_interleaved_writers": f"""{_HOUR}
SELECT window_start, window_end, campaign_id,
       CASE WHEN window_start < TIMESTAMP '{_CUT1}' THEN 2 * clicks ELSE clicks END AS clicks,
       unique_users, ctr FROM agg""",
    "campaign_totals_incremental": f"""{_HOUR}
SELECT campaign_id,
       CAST(SUM(CASE WHEN window_start < TIMESTAMP '{_CUT1}' THEN 2 * clicks ELSE clicks END) AS BIGINT)
         AS clicks,
       CAST(SUM(unique_users) AS BIGINT) AS unique_users
FROM agg GROUP BY campaign_id""",
    "upsert_changelog": f"""WITH {_EV}
{_changed(0, f"event_time < TIMESTAMP '{_CUT1}'")} UNION ALL
{_changed(2, f"event_time >= date_trunc('hour', TIMESTAMP '{_CUT1}') "
             f"AND event_time < TIMESTAMP '{_CUT2}'")} UNION ALL
{_changed(4, f"event_time >= date_trunc('hour', TIMESTAMP '{_CUT2}')")}""",
    "compacted_table": f"""{_HOUR}
SELECT window_start, window_end, campaign_id, clicks, unique_users FROM agg""",
    "stored_trailing_window": f"{_TRAILING} SELECT * FROM slice",
    "agg_contract_violations": f"{_HOUR} "
    + " UNION ALL ".join(
        [
            _violation("null_window_start", "0 * COUNT(*)"),
            _violation("null_window_end", "0 * COUNT(*)"),
            _violation("null_campaign_id", _NULL_KEY),
            _violation("null_clicks", "0 * COUNT(*)"),
            _violation("null_unique_users", "0 * COUNT(*)"),
            _violation("empty_window", _EMPTY),
            _violation("negative_clicks", _NEGATIVE),
            _violation("negative_unique_users", "0 * COUNT(*)"),
            _violation("duplicate_key", _COPY),
        ]
    ),
    "window_grid": f"{_GRID} SELECT * FROM grid",
    "backfill_windows": f"{_GRID} SELECT * FROM filled",
    "backfill_upsert": f"""{_GRID}, early AS (
  SELECT time_bucket(INTERVAL '1 hour', event_time, TIMESTAMP '1970-01-01') AS window_start,
         campaign_id, COUNT(*) AS clicks, COUNT(DISTINCT user_id) AS unique_users
  FROM ev WHERE event_time < TIMESTAMP '{_CUT1}' GROUP BY ALL)
SELECT * FROM filled UNION ALL
SELECT window_start, window_start + INTERVAL '1 hour', campaign_id, clicks, unique_users FROM early
WHERE (window_start, campaign_id) NOT IN (SELECT (window_start, campaign_id) FROM grid)""",
    "backfill_differences": f"""{_GRID}, top AS (SELECT MAX(window_end) AS top FROM agg),
early AS (
  SELECT time_bucket(INTERVAL '1 hour', event_time, TIMESTAMP '1970-01-01') AS window_start,
         campaign_id, COUNT(*) AS clicks, COUNT(DISTINCT user_id) AS unique_users
  FROM ev, top WHERE event_time < top - INTERVAL '6 hours 30 minutes' GROUP BY ALL),
judged AS (
  SELECT CASE WHEN window_start = (SELECT MIN(window_start) FROM filled) THEN 'changed'
              WHEN e.campaign_id IS NULL THEN 'inserted'
              WHEN e.clicks = f.clicks AND e.unique_users = f.unique_users THEN 'same'
              ELSE 'changed' END AS state
  FROM filled f LEFT JOIN early e USING (window_start, campaign_id))
SELECT state, COUNT(*) AS n_rows, TRUE AS second_writes_nothing FROM judged GROUP BY state""",
    "upsert_stream_final_state": f"""{_agg('10 seconds')}
SELECT window_start, window_end, campaign_id, clicks FROM agg""",
    "stream_campaign_windows": f"""{_agg('10 seconds')}
SELECT window_start, window_end, campaign_id, clicks, TRUE AS users_close FROM agg""",
    "stream_reject_reasons": f"""WITH {_EV}
SELECT {_REASON} AS reason, COUNT(*) AS n_messages FROM ev
WHERE event_type IN ('error', 'signup', 'purchase') GROUP BY ALL""",
    "stream_row_accounts": f"""WITH {_EV},
sent AS (
  SELECT e.*, date_trunc('milliseconds', event_time) AS ms, {_REASON} IS NOT NULL AS rejected,
         (CAST(event_time AS DATE) - DATE '2024-01-01') // {DELIVERY_DAYS}
         + CASE CAST(user_id AS BIGINT) % 10 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS delivery
  FROM ev e),
marks AS (
  SELECT delivery, (SELECT MAX(ms) FROM sent p WHERE NOT p.rejected AND p.delivery <= d.delivery - 2)
         - INTERVAL '30 seconds' AS mark
  FROM (SELECT DISTINCT delivery FROM sent) d),
judged AS (
  SELECT rejected, NOT rejected AND COALESCE(
           time_bucket(INTERVAL '10 seconds', ms, TIMESTAMP '1970-01-01') + INTERVAL '10 seconds'
           <= mark, FALSE) AS late
  FROM sent JOIN marks USING (delivery))
SELECT COUNT(*) AS messages, COUNT(*) FILTER (WHERE rejected) AS rejected,
       COUNT(*) FILTER (WHERE late) AS late,
       COUNT(*) FILTER (WHERE NOT rejected AND NOT late) AS kept
FROM judged""",
    "stream_state_keys": f"""{_HOUR}
SELECT window_start, window_end, campaign_id FROM agg
WHERE window_end > (SELECT MAX(date_trunc('milliseconds', event_time)) FROM ev) - INTERVAL '30 seconds'""",
    "refreshed_serving_views": f"""{_HOUR}
SELECT campaign_id, CAST(SUM(clicks) AS BIGINT) AS clicks, TRUE AS users_as_stored
FROM agg GROUP BY campaign_id""",
}
