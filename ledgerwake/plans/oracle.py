"""The same results in plain SQL, for an independent engine on the same tables."""

from __future__ import annotations

from ledgerwake.plans.catalogue import REPLAY_END, RUN_TS

LINES = """
lines AS (
  SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS transaction_id,
         CAST(o_custkey AS VARCHAR) AS customer_id,
         strftime(o_orderdate, '%d/%m/%y') AS customer_dob,
         substr(c_mktsegment, 1, 1) AS customer_gender,
         n_name AS customer_location,
         CAST(c_acctbal * 20 AS DECIMAL(12,2)) AS customer_account_balance,
         CAST(CASE WHEN l_returnflag = 'R' THEN -l_extendedprice ELSE l_extendedprice END
              AS DECIMAL(12,2)) AS transaction_amount_inr,
         l_shipdate AS event_time, l_partkey, l_suppkey, l_linenumber
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey
  JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey
)"""

EVENTS = """
lines AS (
  SELECT CAST(event_id AS VARCHAR) AS transaction_id,
         CAST(user_id AS VARCHAR) AS customer_id,
         CAST(NULL AS VARCHAR) AS customer_dob,
         CAST(NULL AS VARCHAR) AS customer_gender,
         event_type AS customer_location,
         CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) * 10 AS DECIMAL(12,2))
           AS customer_account_balance,
         CAST(value AS DECIMAL(12,2)) AS transaction_amount_inr,
         ts AS event_time
  FROM events
)"""

# Gaps as nulls; nan_balance marks those that stand for NaN.
GAPPY = (
    LINES
    + """,
gappy AS (
  SELECT transaction_id,
         CASE WHEN l_linenumber = 2 AND customer_gender = 'B' THEN NULL ELSE customer_id END
           AS customer_id,
         CASE WHEN l_linenumber = 4 THEN NULL ELSE customer_dob END AS customer_dob,
         CASE WHEN l_linenumber = 5 THEN NULL ELSE customer_gender END AS customer_gender,
         CASE WHEN l_linenumber = 6 AND customer_gender = 'M' THEN NULL
              ELSE customer_location END AS customer_location,
         CASE WHEN l_linenumber = 1 OR (l_linenumber = 3 AND customer_gender = 'A') THEN NULL
              ELSE customer_account_balance END AS customer_account_balance,
         CASE WHEN l_linenumber = 7 AND customer_gender IN ('H', 'F') THEN NULL
              ELSE transaction_amount_inr END AS transaction_amount_inr,
         event_time, l_partkey, l_suppkey, l_linenumber,
         l_linenumber = 3 AND customer_gender = 'A' AS nan_balance
  FROM lines
)"""
)


def _detect(source: str, absolute: int = 50000, where: str = "TRUE") -> str:
    """Three filters put together, one per rule.

    A null measure fires nothing.  A comparison with NaN is false, but the absolute rule
    compares the amount only, so it still holds beside a balance of NaN.
    """
    nan = " OR nan_balance" if source == "gappy" else ""
    rules = {
        "high_value_relative": "transaction_amount_inr > customer_account_balance * 0.5",
        "high_value_absolute":
            f"(customer_account_balance IS NOT NULL{nan})"
            f" AND abs(transaction_amount_inr) > {absolute}",
        "overdraft_attempt": "customer_account_balance - transaction_amount_inr < 0",
    }
    parts = [
        f"SELECT *, '{reason}' AS anomaly_reason FROM {source} WHERE ({where}) AND ({rule})"
        for reason, rule in rules.items()
    ]
    return "found AS (" + " UNION ALL ".join(parts) + ")"


COMPLETE = "transaction_id IS NOT NULL AND customer_id IS NOT NULL AND customer_location IS NOT NULL"

ANOMALY_COLUMNS = """
  customer_id, transaction_id, CAST(transaction_amount_inr AS DOUBLE) AS amount,
  customer_location AS location, anomaly_reason,
  CAST(customer_account_balance AS DOUBLE) AS current_balance"""

ALERT_ID = """
  md5(concat_ws('|', coalesce('+' || transaction_id, '-'), coalesce('+' || customer_id, '-'),
      coalesce('+' || customer_location, '-'),
      coalesce('+' || CAST(CAST(transaction_amount_inr AS DECIMAL(18,2)) AS VARCHAR), '-'),
      coalesce('+' || CAST(CAST(customer_account_balance AS DECIMAL(18,2)) AS VARCHAR), '-'),
      coalesce('+' || CAST(epoch_us(event_time) // 1000000 AS VARCHAR), '-'),
      '+' || anomaly_reason)) AS alert_id"""


def _anomalies(ctes: str, source: str = "lines", where: str = COMPLETE) -> str:
    return f"WITH {ctes}, {_detect(source, where=where)} SELECT {ANOMALY_COLUMNS}, event_time FROM found"


def _batch_profile(ctes: str, source: str = "lines") -> str:
    return f"""
WITH {ctes},
counts AS (
  SELECT customer_id, customer_location, count(*) AS cnt FROM {source}
  GROUP BY customer_id, customer_location
),
tops AS (
  SELECT customer_id, customer_location AS top_location FROM (
    SELECT *, row_number() OVER (PARTITION BY customer_id
      ORDER BY cnt DESC, customer_location DESC NULLS LAST) AS place FROM counts)
  WHERE place = 1
),
totals AS (
  SELECT customer_id,
         -- Six decimals, half up, in whole numbers: a double can miss an exact tie.
         sign(sum(transaction_amount_inr))
           * ((20000 * abs(CAST(sum(transaction_amount_inr) * 100 AS HUGEINT))
               + count(transaction_amount_inr)) // (2 * count(transaction_amount_inr)))
           / 1000000.0 AS avg_transaction,
         CAST(max(customer_account_balance) AS DOUBLE) AS max_balance,
         count(*) AS transaction_count
  FROM {source} GROUP BY customer_id
)
SELECT totals.customer_id, avg_transaction, max_balance, transaction_count,
       CASE WHEN avg_transaction > 50000 THEN 'premium'
            WHEN transaction_count > 10 THEN 'frequent' ELSE 'standard' END AS segment,
       TIMESTAMP '{RUN_TS}' AS last_updated, top_location
FROM totals LEFT JOIN tops ON totals.customer_id = tops.customer_id"""


def _windows(source: str, start: str, width: str, where: str = "TRUE") -> str:
    """CTE `profiles`: one row per customer and window."""
    return f"""
timed AS (SELECT *, {start} AS window_start FROM {source} WHERE {where}),
places AS (
  SELECT window_start, customer_id, customer_location, count(*) AS cnt,
         min(event_time) AS first_seen
  FROM timed GROUP BY window_start, customer_id, customer_location
),
tops AS (
  SELECT window_start, customer_id, customer_location AS top_location FROM (
    SELECT *, row_number() OVER (PARTITION BY window_start, customer_id
      ORDER BY cnt DESC, first_seen, customer_location NULLS FIRST) AS place FROM places)
  WHERE place = 1
),
totals AS (
  SELECT window_start, customer_id,
         CAST(sum(transaction_amount_inr) AS DOUBLE) / count(*) AS average,
         greatest(0, CAST(max(customer_account_balance) AS DOUBLE)) AS max_balance,
         count(*) AS transaction_count
  FROM timed GROUP BY window_start, customer_id
),
profiles AS (
  SELECT totals.window_start, totals.window_start + INTERVAL '{width}' AS window_end,
         totals.customer_id, round(average, 6) AS avg_transaction, max_balance,
         transaction_count,
         CASE WHEN average > 15000 THEN 'premium' ELSE 'regular' END AS segment,
         TIMESTAMP '{RUN_TS}' AS last_updated, top_location
  FROM totals JOIN tops ON totals.window_start = tops.window_start
    AND totals.customer_id = tops.customer_id
),
latest AS (
  SELECT * EXCLUDE (place) FROM (
    SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY window_start DESC) AS place
    FROM profiles)
  WHERE place = 1
)"""


FIVE_MINUTES = "time_bucket(INTERVAL '5 minutes', event_time)"
ONE_DAY = "date_trunc('day', event_time)"
STORED_PROFILE = """customer_id, avg_transaction, max_balance, transaction_count, segment,
  last_updated, top_location"""
# The stream has closed a window once the latest event is two minutes past its end.
CLOSED = """window_end <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL '2 minutes'
  FROM events)"""

FIRST_LINES = """
firsts AS (
  SELECT * EXCLUDE (place) FROM (
    SELECT *, row_number() OVER (PARTITION BY transaction_id
      ORDER BY event_time, l_partkey, l_suppkey) AS place FROM lines)
  WHERE place = 1
)"""

RAW_COLUMNS = """transaction_id, customer_id, customer_dob, customer_gender, customer_location,
  CAST(customer_account_balance AS DOUBLE) AS customer_account_balance,
  CAST(transaction_amount_inr AS DOUBLE) AS transaction_amount_inr, event_time"""

DATASET = (
    GAPPY
    + """,
dataset AS (
  SELECT transaction_id, l_partkey, l_suppkey, customer_id AS "CustomerID",
         customer_dob AS "CustomerDOB", customer_gender AS "CustGender",
         customer_location AS "CustLocation",
         CAST(customer_account_balance AS DOUBLE) AS "CustAccountBalance",
         CAST(transaction_amount_inr AS DOUBLE) AS amount
  FROM gappy
)"""
)

DATASET_COLUMNS = (
    "transaction_id", "l_partkey", "l_suppkey", "CustomerID", "CustomerDOB", "CustGender",
    "CustLocation", "CustAccountBalance", "amount",
)
NUMBERS = ("CustAccountBalance", "amount")


def _filled(fills: dict[str, str]) -> str:
    return ", ".join(
        f'coalesce("{c}", {fills[c]}) AS "{c}"' if c in fills else f'"{c}"'
        for c in DATASET_COLUMNS
    )


def _mode(column: str) -> str:
    return (
        f'(SELECT "{column}" FROM dataset WHERE "{column}" IS NOT NULL GROUP BY "{column}"'
        f' ORDER BY count(*) DESC, "{column}" LIMIT 1)'
    )


def _null_report(columns=DATASET_COLUMNS, having: str = "TRUE") -> str:
    names = {"amount": "TransactionAmount (INR)"}
    parts = [
        f"SELECT '{names.get(c, c)}' AS column_name, count(*) - count(\"{c}\") AS missing"
        " FROM dataset"
        for c in columns
    ]
    return f"WITH {DATASET} SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE {having}"


def _summary(column: str) -> str:
    return f"""
SELECT '{column}' AS column_name, count(x) AS n, round(avg(x), 4) AS mean,
       round(stddev_samp(x), 4) AS stddev, min(x) AS minimum,
       quantile_cont(x, 0.25) AS q25, quantile_cont(x, 0.5) AS q50,
       quantile_cont(x, 0.75) AS q75, max(x) AS maximum
FROM (SELECT CAST({column} AS DOUBLE) AS x FROM gappy)"""


SIGN = """
  CASE WHEN CAST('0x' || substr(md5(concat_ws(':', 'sign', transaction_id, l_partkey, l_suppkey)),
                 1, 8) AS BIGINT) / 4294967296.0 < 0.6
       THEN -abs(amount) ELSE abs(amount) END"""

# Event JSON put together by hand, in field order.
JSON_TEXT = """
  '{"TransactionID":"' || transaction_id || '","CustomerID":"' || customer_id
  || '","CustomerDOB":"' || customer_dob || '","CustGender":"' || customer_gender
  || '","CustLocation":"' || customer_location
  || '","CustAccountBalance":' || CAST(customer_account_balance AS VARCHAR)
  || ',"TransactionAmountINR":' || CAST(transaction_amount_inr AS VARCHAR)
  || ',"EventTime":"' || strftime(event_time, '%Y-%m-%dT%H:%M:%SZ') || '"}'"""

DAMAGE = """
  CASE WHEN customer_gender = 'A' AND l_linenumber = 1 THEN 'malformed_json'
       WHEN customer_gender = 'B' AND l_linenumber = 2 THEN 'event_time_invalid'
       WHEN customer_gender = 'F' AND l_linenumber = 3 THEN 'event_time_missing' END"""

SUSPECT = (
    GAPPY
    + """,
suspect AS (
  SELECT * EXCLUDE (transaction_amount_inr),
         CASE WHEN customer_location = 'NATION_1'
              THEN CAST(transaction_amount_inr AS DECIMAL(38,2)) * 1000000
              ELSE transaction_amount_inr END AS transaction_amount_inr
  FROM gappy
),
judged AS (
  SELECT *, concat_ws(',',
    CASE WHEN transaction_id IS NULL THEN 'transaction_id_missing' END,
    CASE WHEN customer_id IS NULL THEN 'customer_id_missing' END,
    CASE WHEN transaction_amount_inr IS NULL THEN 'transaction_amount_inr_missing' END,
    CASE WHEN event_time IS NULL THEN 'event_time_missing' END,
    CASE WHEN customer_gender NOT IN ('M', 'F', 'X', 'T') THEN 'customer_gender_not_allowed' END,
    CASE WHEN length(customer_gender) > 1 THEN 'customer_gender_too_long' END,
    CASE WHEN abs(customer_account_balance) >= 10000000000
         THEN 'customer_account_balance_overflow' END,
    CASE WHEN abs(transaction_amount_inr) >= 10000000000
         THEN 'transaction_amount_inr_overflow' END) AS reject_reasons
  FROM suspect
)"""
)


# Events as they are sent: slice, and whether the message is cut off.
SENT = (
    EVENTS
    + """,
numbered AS (
  SELECT *, CAST(transaction_id AS BIGINT) AS number,
         CASE WHEN day(event_time) <= 8 THEN 0 WHEN day(event_time) <= 16 THEN 1
              WHEN day(event_time) <= 24 THEN 2 ELSE 3 END AS slice
  FROM lines),
sent AS (
  SELECT * FROM numbered
  UNION ALL SELECT * REPLACE (2 AS slice) FROM numbered WHERE slice = 1 AND number % 50 = 7
  UNION ALL SELECT * REPLACE (3 AS slice, 'late-' || transaction_id AS transaction_id)
    FROM numbered WHERE slice = 0 AND number % 20 = 3)"""
)


CUT_OFF = "SELECT * FROM sent WHERE slice = 1 AND number % 10 = 3"


def _live_history() -> str:
    """The profile of all that was sent so far, for each slice."""
    parts = []
    for last in range(4):
        so_far = f"{SENT}, so_far AS (SELECT * FROM sent WHERE slice <= {last})"
        parts.append(f"SELECT *, {last} AS batch_id FROM ({_batch_profile(so_far, 'so_far')})")
    return " UNION ALL ".join(parts)


def oracle() -> dict[str, str]:
    event_found = f"{EVENTS}, {_detect('lines', absolute=200, where=COMPLETE)}"
    whole_seconds = EVENTS.replace("ts AS event_time", "date_trunc('second', ts) AS event_time")
    until = f"event_time <= TIMESTAMP '{REPLAY_END}'"
    five = _windows("lines", FIVE_MINUTES, "5 minutes")
    csv_columns = ", ".join(f'"{c}"' for c in DATASET_COLUMNS)
    custom = _filled(
        {
            "CustAccountBalance": "0",
            "CustLocation": "'Unknown'",
            "CustomerDOB": "'1/1/00'",
            "CustGender": "'X'",
        }
    )
    signed = f"WITH {DATASET} SELECT transaction_id, l_partkey, l_suppkey, {SIGN} AS amount FROM dataset"
    profile = _batch_profile(LINES)
    return {
        "anomaly_explode": _anomalies(LINES),
        "anomaly_keep_incomplete": _anomalies(GAPPY, "gappy", "event_time IS NOT NULL"),
        "anomaly_drop_incomplete": _anomalies(GAPPY, "gappy"),
        "anomaly_rule_counts": f"""
WITH {LINES}, {_detect('lines', where=COMPLETE)}
SELECT anomaly_reason, count(*) AS n FROM found GROUP BY anomaly_reason""",
        "alert_rows": f"""
WITH {LINES}, {_detect('lines', where=COMPLETE)}
SELECT {ALERT_ID}, {ANOMALY_COLUMNS}, TIMESTAMP '{RUN_TS}' AS detected_at FROM found""",
        "customer_location_counts": f"""
WITH {LINES} SELECT customer_id, customer_location, count(*) AS n_visits FROM lines
GROUP BY customer_id, customer_location""",
        "top_location": f"SELECT customer_id, top_location FROM ({profile})",
        "customer_segments": f"""
SELECT customer_id, avg_transaction, max_balance, transaction_count, segment FROM ({profile})""",
        "batch_profile": profile,
        "batch_profile_single_pass": profile,
        "batch_profile_with_gaps": _batch_profile(GAPPY, "gappy"),
        "incremental_profile": profile,
        "window_profile_5m": f"WITH {EVENTS}, {five} SELECT * FROM profiles",
        "window_profile_1d": f"""
WITH {EVENTS}, {_windows('lines', ONE_DAY, '1 day')} SELECT * FROM profiles""",
        "window_profile_lines": f"""
WITH {LINES}, {_windows('lines', ONE_DAY, '1 day')} SELECT * FROM profiles""",
        "latest_profile": f"WITH {EVENTS}, {five} SELECT * FROM latest",
        "reprocess_filter": f"""
WITH {EVENTS} SELECT transaction_id, customer_id, event_time FROM lines WHERE {until}""",
        "reprocess_lookback": f"""
WITH {EVENTS} SELECT transaction_id, customer_id, event_time FROM lines
WHERE {until} AND event_time >= TIMESTAMP '{REPLAY_END}' - INTERVAL '1 day'""",
        "reprocess_profile": f"""
WITH {EVENTS}, {_windows('lines', FIVE_MINUTES, '5 minutes', until)}
SELECT {STORED_PROFILE} FROM latest""",
        "insert_ignore_first": f"""
WITH {LINES}, {FIRST_LINES}
SELECT {RAW_COLUMNS}, l_partkey, l_suppkey FROM firsts""",
        "insert_ignore_table": f"""
WITH {LINES}, ordered AS (
  SELECT *, row_number() OVER (PARTITION BY transaction_id
    ORDER BY (transaction_amount_inr < 0), event_time, customer_id, customer_dob,
      customer_gender, customer_location, customer_account_balance, transaction_amount_inr)
    AS place
  FROM lines)
SELECT {RAW_COLUMNS} FROM ordered WHERE place = 1""",
        "upsert_merge": f"WITH {EVENTS}, {five} SELECT * FROM latest",
        "upsert_table": f"WITH {EVENTS}, {five} SELECT {STORED_PROFILE} FROM latest",
        "overwrite_table": profile,
        "duplicate_ids": f"""
WITH {LINES} SELECT transaction_id, count(*) AS n FROM lines
GROUP BY transaction_id HAVING count(*) > 1""",
        "duplicate_total": f"""
WITH {LINES}, repeated AS (
  SELECT count(*) AS n FROM lines GROUP BY transaction_id HAVING count(*) > 1)
SELECT count(*) AS duplicate_keys, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS surplus_rows
FROM repeated""",
        "json_bytes": f"""
WITH {LINES} SELECT transaction_id, l_partkey, l_suppkey,
  CAST(strlen({JSON_TEXT}) AS INTEGER) AS n_bytes FROM lines""",
        "json_messages": f"""
WITH {LINES} SELECT customer_id AS "key", {JSON_TEXT} AS "value" FROM lines""",
        "json_roundtrip": f"WITH {LINES} SELECT {RAW_COLUMNS} FROM lines",
        "decode_events": f"""
WITH {GAPPY}, sent AS (SELECT *, {DAMAGE} AS damage FROM gappy)
SELECT {RAW_COLUMNS} FROM sent WHERE damage IS NULL""",
        "decode_lenient": f"""
WITH {LINES}
SELECT {RAW_COLUMNS} FROM (
  SELECT * REPLACE (
    CASE WHEN customer_gender = 'A' AND l_linenumber = 1 THEN NULL ELSE transaction_amount_inr END
      AS transaction_amount_inr,
    CASE WHEN customer_gender = 'F' AND l_linenumber = 3 THEN NULL ELSE customer_account_balance END
      AS customer_account_balance)
  FROM lines WHERE NOT (customer_gender = 'H' AND l_linenumber = 4))""",
        "decode_quarantine": f"""
WITH {GAPPY}, sent AS (SELECT {DAMAGE} AS decode_error FROM gappy)
SELECT decode_error, count(*) AS n FROM sent WHERE decode_error IS NOT NULL
GROUP BY decode_error""",
        "load_counts": f"""
WITH {LINES}, {FIRST_LINES}
SELECT count(*) AS n_read,
       count(*) FILTER (customer_gender IN ('M', 'F', 'X', 'T')) AS n_stored,
       count(*) FILTER (customer_gender NOT IN ('M', 'F', 'X', 'T')) AS n_rejected,
       count(*) FILTER (customer_gender IN ('M', 'F', 'X', 'T')) AS n_rows
FROM firsts""",
        "validate_rejected": f"""
WITH {SUSPECT} SELECT transaction_id, l_partkey, l_suppkey, reject_reasons FROM judged
WHERE reject_reasons <> ''""",
        "validate_valid": f"""
WITH {SUSPECT} SELECT {RAW_COLUMNS}, l_partkey, l_suppkey FROM judged
WHERE reject_reasons = ''""",
        "validate_counts": f"""
WITH {SUSPECT}, single AS (
  SELECT unnest(string_split(reject_reasons, ',')) AS reject_reason FROM judged
  WHERE reject_reasons <> '')
SELECT reject_reason, count(*) AS n FROM single GROUP BY reject_reason""",
        "null_report": _null_report(),
        "null_report_gaps": _null_report(having="missing > 0"),
        "clean_drop": f"""
WITH {DATASET} SELECT * FROM dataset
WHERE {' AND '.join(f'"{c}" IS NOT NULL' for c in DATASET_COLUMNS)}""",
        "clean_mean": f"""
WITH {DATASET} SELECT {', '.join(
    f'round(coalesce("{c}", (SELECT avg("{c}") FROM dataset)), 4) AS "{c}"'
    if c in NUMBERS else f'"{c}"' for c in DATASET_COLUMNS)} FROM dataset""",
        "clean_median": f"""
WITH {DATASET} SELECT {_filled(
    {c: f'(SELECT quantile_cont("{c}", 0.5) FROM dataset)' for c in NUMBERS})} FROM dataset""",
        "clean_mode": f"""
WITH {DATASET} SELECT {_filled({c: _mode(c) for c in DATASET_COLUMNS})} FROM dataset""",
        "clean_custom": f"WITH {DATASET} SELECT {custom} FROM dataset",
        "column_modes": f"""
WITH {DATASET} SELECT {', '.join(f'{_mode(c)} AS "{c}"' for c in DATASET_COLUMNS)}""",
        "column_summary": f"""
WITH {GAPPY} {_summary('transaction_amount_inr')}
UNION ALL {_summary('customer_account_balance')}""",
        "sign_by_hash": signed,
        "row_counts": f"""
WITH {SUSPECT}
SELECT 'read' AS stage, count(*) AS n_rows FROM judged
UNION ALL SELECT 'valid', count(*) FROM judged WHERE reject_reasons = ''
UNION ALL SELECT 'rejected', count(*) FROM judged WHERE reject_reasons <> ''""",
        "csv_roundtrip": f"WITH {DATASET} SELECT {csv_columns} FROM dataset",
        "csv_inferred": f"""
WITH {DATASET} SELECT * REPLACE (CAST("CustomerID" AS BIGINT) AS "CustomerID") FROM dataset""",
        "csv_reordered": f"""
WITH {DATASET}
SELECT {csv_columns}, 'kept' AS note, CAST(l_partkey + 1 AS VARCHAR) AS next_part FROM dataset""",
        "csv_rejects": f"""
WITH {DATASET}
SELECT CASE l_suppkey % 10 WHEN 0 THEN 'ragged' WHEN 1 THEN 'amount_unfit' ELSE 'fits' END
         AS outcome, count(*) AS n
FROM dataset GROUP BY ALL""",
        "csv_stream": f"""
WITH {DATASET}
SELECT transaction_id AS id, CASE WHEN l_suppkey % 10 <> 1 THEN amount END AS amount,
       CASE WHEN l_suppkey % 10 = 1 THEN 'amount_unfit' ELSE 'fits' END AS outcome
FROM dataset""",
        "csv_clean_job": f"WITH {DATASET} SELECT {custom} FROM dataset",
        "csv_sign_job": signed,
        "bulk_load_events": f"""
WITH {DATASET}
SELECT "CustomerID" AS customer_id, "CustLocation" AS customer_location,
       TIMESTAMP '{RUN_TS}' AS event_time, count(*) AS n, count(amount) AS n_amounts,
       count(DISTINCT (transaction_id, l_partkey, l_suppkey)) AS n_ids
FROM dataset GROUP BY "CustomerID", "CustLocation\"""",
        "stream_anomalies": f"""
WITH {event_found}
SELECT {ALERT_ID}, {ANOMALY_COLUMNS}, TIMESTAMP '{RUN_TS}' AS detected_at FROM found""",
        "stream_window_profile": f"WITH {EVENTS}, {five} SELECT * FROM profiles WHERE {CLOSED}",
        "stream_first_rows": f"WITH {EVENTS} SELECT {RAW_COLUMNS} FROM lines",
        "speed_layer_archive": f"WITH {whole_seconds} SELECT {RAW_COLUMNS} FROM lines",
        "speed_layer_alerts": f"WITH {event_found} SELECT {ALERT_ID}, {ANOMALY_COLUMNS} FROM found",
        "alert_replay": f"WITH {event_found} SELECT {ALERT_ID}, {ANOMALY_COLUMNS} FROM found",
        "single_pipeline_realtime": f"""
WITH {event_found} SELECT {ALERT_ID}, {ANOMALY_COLUMNS} FROM found""",
        "single_pipeline_reprocess": f"""
WITH {EVENTS}, {_windows('lines', FIVE_MINUTES, '5 minutes', until)},
closed AS (
  SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY window_start DESC) AS place
  FROM profiles WHERE {CLOSED})
SELECT {STORED_PROFILE.replace('last_updated,', '')} FROM closed WHERE place = 1""",
        # Late is what lies two minutes behind all that came before the slice before.
        "stream_late_counts": f"""
WITH {SENT},
seen AS (SELECT slice, max(date_trunc('second', event_time)) AS latest FROM sent GROUP BY slice)
SELECT slice AS batch_id, count(*) AS n_read,
       count(*) FILTER (date_trunc('second', event_time) <= (SELECT max(latest) FROM seen
         WHERE seen.slice <= sent.slice - 2) - INTERVAL '2 minutes') AS n_late
FROM sent GROUP BY slice""",
        "stream_balance": f"""
WITH {SENT},
placed AS (
  SELECT slice, row_number() OVER (PARTITION BY transaction_id ORDER BY slice) AS place FROM sent),
cut AS (SELECT 1 AS batch_id, count(*) AS n FROM ({CUT_OFF}))
SELECT slice AS batch_id, count(*) AS n_offered, count(*) FILTER (place = 1) AS n_stored,
       count(*) FILTER (place > 1) AS n_ignored, 0 AS n_rejected,
       coalesce(any_value(cut.n), 0) AS n_unreadable
FROM placed LEFT JOIN cut ON slice = cut.batch_id GROUP BY slice""",
        "stream_recovery": f"""
WITH {SENT}, first_sent AS (
  SELECT * FROM sent
  QUALIFY row_number() OVER (PARTITION BY transaction_id ORDER BY slice) = 1),
{_detect('first_sent', absolute=200, where=COMPLETE)}
SELECT 'alerts' AS stored_in, count(*) AS n_rows, count(*) AS n_keys,
       CAST(sum(transaction_amount_inr) AS DOUBLE) AS amount, 1 AS n_failures FROM found
UNION ALL
SELECT 'archive', count(*), count(*), CAST(sum(transaction_amount_inr) AS DOUBLE), 1 FROM first_sent
UNION ALL
SELECT 'unreadable', count(*), 1, NULL, 1 FROM ({CUT_OFF})""",
        "live_history_profile": _live_history(),
        "live_latency": f"""
WITH {event_found},
delays AS (
  SELECT date_trunc('day', event_time) AS day,
         (CAST(transaction_id AS BIGINT) % 97 + 1) * 1000 AS delay_ms
  FROM found WHERE day(event_time) < 24),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY day ORDER BY delay_ms) AS place,
         count(*) OVER (PARTITION BY day) AS total
  FROM delays)
SELECT day AS interval_start, day + INTERVAL '1 day' AS interval_end, count(*) AS n,
       min(delay_ms) AS min_ms, CAST(sum(delay_ms) AS DOUBLE) / count(*) AS avg_ms,
       min(delay_ms) FILTER (place * 100 >= total * 95) AS p95_ms
FROM placed GROUP BY day""",
        "throughput_1h": f"""
WITH {EVENTS} SELECT date_trunc('hour', event_time) AS interval_start,
  date_trunc('hour', event_time) + INTERVAL '1 hour' AS interval_end, count(*) AS n
FROM lines GROUP BY ALL""",
        "anomalies_by_hour": f"""
WITH {event_found} SELECT date_trunc('hour', event_time) AS interval_start,
  date_trunc('hour', event_time) + INTERVAL '1 hour' AS interval_end, anomaly_reason,
  count(*) AS n FROM found GROUP BY ALL""",
        "anomalies_by_customer": f"""
WITH {LINES}, {_detect('lines', where=COMPLETE)}
SELECT customer_id, anomaly_reason, count(*) AS n FROM found
GROUP BY customer_id, anomaly_reason""",
        "detection_latency": f"""
WITH {LINES}, {FIRST_LINES}, {_detect('firsts', where=COMPLETE)},
delays AS (
  SELECT date_trunc('day', event_time) AS day, (l_partkey % 97 + 1) * 1000 AS delay_ms
  FROM found),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY day ORDER BY delay_ms) AS place,
         count(*) OVER (PARTITION BY day) AS total
  FROM delays)
SELECT day AS interval_start, day + INTERVAL '1 day' AS interval_end, count(*) AS n,
       min(delay_ms) AS min_ms, CAST(sum(delay_ms) AS DOUBLE) / count(*) AS avg_ms,
       min(delay_ms) FILTER (place * 100 >= total * 95) AS p95_ms
FROM placed GROUP BY day""",
        "latency_from_sketches": f"""
WITH {LINES}, {FIRST_LINES}, {_detect('firsts', where=COMPLETE)}
SELECT time_bucket(INTERVAL '28 days', event_time, TIMESTAMP '1970-01-01') AS interval_start,
       interval_start + INTERVAL '28 days' AS interval_end, count(*) AS n, TRUE AS within_bounds
FROM found GROUP BY ALL""",
    }
