"""Values that decide results and therefore must not drift.

Everything in this module is a fixed value: field names, thresholds, labels and
formats that the transaction workload prescribes.
"""

# Fields of the transaction event and the stored column of each.
EVENT_TO_COLUMN = {
    "TransactionID": "transaction_id",
    "CustomerID": "customer_id",
    "CustomerDOB": "customer_dob",
    "CustGender": "customer_gender",
    "CustLocation": "customer_location",
    "CustAccountBalance": "customer_account_balance",
    "TransactionAmountINR": "transaction_amount_inr",
    "EventTime": "event_time",
}

# Columns of the CSV dataset and the event field of each.
CSV_TO_EVENT = {
    "CustomerID": "CustomerID",
    "CustomerDOB": "CustomerDOB",
    "CustGender": "CustGender",
    "CustLocation": "CustLocation",
    "CustAccountBalance": "CustAccountBalance",
    "TransactionAmount (INR)": "TransactionAmountINR",
}
CSV_AMOUNT = "TransactionAmount (INR)"

# Anomaly rules.
RELATIVE_SHARE = 0.5
ABSOLUTE_LIMIT = 50000
REASON_RELATIVE = "high_value_relative"
REASON_ABSOLUTE = "high_value_absolute"
REASON_OVERDRAFT = "overdraft_attempt"

# Customer segments over full history.
BATCH_PREMIUM_AVG = 50000
BATCH_FREQUENT_COUNT = 10

# Customer segments inside one event-time window.
STREAM_PREMIUM_AVG = 15000

# Event time handling.
PROFILE_WINDOW = "5 minutes"
WATERMARK_DELAY = "2 minutes"
EVENT_TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss'Z'"
ID_TIME_FORMAT = "yyyyMMddHHmmss"

# Stored domains, lengths and precisions.
GENDERS = ("M", "F", "X", "T")
ID_LENGTH = 255
REASON_LENGTH = 100
RAW_DECIMAL = "decimal(12,2)"
REPORT_DECIMAL = "decimal(18,2)"

# Replacements used by the custom cleaning strategy.
CUSTOM_FILLS = {
    "CustAccountBalance": 0,
    "CustLocation": "Unknown",
    "TransactionTime": "00:00:00",
    "CustomerDOB": "1/1/00",
    "CustGender": "X",
}

# Share of transactions that become withdrawals.
WITHDRAWAL_SHARE = 0.6

# Cell texts that pandas reads as missing.
MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)

# Rows per JDBC round trip of the bulk load.
JDBC_BATCH_ROWS = 10000
