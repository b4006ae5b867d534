"""The queries of checks.queries as SQL for an independent engine (DuckDB dialect)."""

from __future__ import annotations

NOW = "TIMESTAMP '2001-07-30 12:00:00'"
CUT_DAY = "DATE '2001-05-03'"  # 90 calendar days before 2001-08-01
CUT_TIME = "TIMESTAMP '2001-05-01 12:00:00'"  # 90 x 24 hours before NOW

BASE = f"""
s_users AS (
  SELECT c_custkey AS id, c_name AS name, lower(c_name) AS email, r_name AS region
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
), s_orders AS (
  SELECT o_orderkey AS id, o_custkey AS user_id, o_orderstatus AS status,
         CAST(round(o_totalprice * 100) AS BIGINT) AS total_in_cents, o_orderdate AS created_at
  FROM orders
), s_items AS (
  SELECT l_orderkey AS order_id, l_partkey AS menu_item_id, CAST(l_quantity AS INTEGER) AS quantity,
         CAST(round(l_extendedprice / l_quantity * 100) AS BIGINT) AS price_in_cents
  FROM lineitem
), s_menu AS (
  SELECT p_partkey AS id, p_name AS name, p_type AS category,
         CAST(round(p_retailprice * 100) AS BIGINT) AS price_in_cents, p_size <= 40 AS available
  FROM part
), s_refunds AS (
  SELECT o_custkey AS user_id, l_orderkey AS order_id,
         CASE WHEN l_orderkey % 3 = 0 THEN l_orderkey // 150 END AS support_case_id,
         CAST(round(l_extendedprice * l_discount * 100) AS BIGINT) AS amount_in_cents,
         CASE l_linestatus WHEN 'F' THEN 'approved' ELSE 'pending' END AS status, l_shipdate AS created_at,
         l_orderkey * 10 + l_linenumber AS id, 'returned by ' || l_suppkey AS reason, l_shipdate + to_days(l_linenumber) AS updated_at
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag = 'R'
), s_credits AS (
  SELECT o_custkey AS user_id, CASE WHEN l_orderkey % 4 = 0 THEN l_orderkey // 150 END AS support_case_id,
         CAST(round(l_extendedprice * l_tax * 100) AS BIGINT) AS amount_in_cents, l_shipdate AS created_at,
         l_orderkey * 10 + l_linenumber AS id, 'goodwill for ' || l_partkey AS reason
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag = 'A'
), s_cases AS (
  SELECT DISTINCT conv_id AS id, (conv_id - conv_id % 3) * 7 AS user_id, 'case ' || conv_id AS subject,
         CASE conv_id % 4 WHEN 0 THEN 'open' WHEN 1 THEN 'in_progress' WHEN 2 THEN 'resolved' ELSE 'closed' END AS status,
         TIMESTAMP '2001-04-20 00:00:00' + to_days(CAST(conv_id % 100 AS INTEGER)) AS created_at,
         TIMESTAMP '2001-04-20 00:00:00' + to_days(CAST(conv_id % 100 AS INTEGER)) + to_hours(conv_id % 60) AS updated_at
  FROM conversations
), s_messages AS (
  SELECT conv_id * 100 + turn AS id, conv_id AS case_id,
         CASE role WHEN 'user' THEN (conv_id - conv_id % 3) * 7 END AS user_id,
         CASE WHEN role IS DISTINCT FROM 'user' THEN conv_id % 3 END AS admin_id,
         text AS content,
         TIMESTAMP '2001-04-20 00:00:00' + to_days(CAST(conv_id % 100 AS INTEGER)) + to_minutes(turn * 7 + 3)
           + to_seconds(conv_id % 60) AS created_at
  FROM conversations
), s_drafts AS (
  SELECT id AS message_id, case_id, user_id, 'summary ' || id AS case_summary, 'reply ' || id AS suggested_response,
         CASE id % 5 WHEN 0 THEN 'refund' WHEN 1 THEN 'credit' WHEN 2 THEN 'no_action' WHEN 3 THEN 'escalate' ELSE 'resolve' END
           AS suggested_action,
         CAST(CASE WHEN id % 5 < 2 THEN (case_id % 7) * 100 ELSE 0 END AS INTEGER) AS suggested_amount_cents,
         'because ' || id AS reasoning, 'rules' AS model, created_at AS generated_at
  FROM s_messages WHERE admin_id IS NULL AND id % 3 = 0
), s_promos AS (
  SELECT min(p_partkey) AS id, upper(p_brand) AS code, p_brand AS name, CAST(split_part(p_brand, '#', 2) AS INTEGER) AS n,
         CAST(count(*) AS INTEGER) AS uses
  FROM part GROUP BY p_brand
), s_promotions AS (
  SELECT id, code, name, 'All of ' || name AS description, CASE WHEN n % 2 = 0 THEN 'size ' || n END AS category,
         '{{"type":"percentage_off","percent":' || n || '}}' AS discount_strategy,
         CASE n % 10 WHEN 1 THEN 'AFRICA' WHEN 2 THEN 'AMERICA' WHEN 3 THEN 'ASIA' WHEN 4 THEN 'EUROPE'
           WHEN 5 THEN 'MIDDLE EAST' WHEN 6 THEN 'us_east' WHEN 7 THEN 'us_central' WHEN 8 THEN 'us_west'
           WHEN 9 THEN 'eu_west' END AS region,
         n * 10 + 80 AS traffic_multiplier, CASE WHEN n % 4 <> 0 THEN n * 20 END AS max_redemptions,
         uses AS current_redemptions, {NOW} - to_days(n) AS starts_at, {NOW} + to_days(n % 5 - 1) AS ends_at
  FROM s_promos
), s_running AS (
  SELECT * FROM s_promotions WHERE starts_at <= {NOW} AND {NOW} <= ends_at
), s_offers AS (
  SELECT * FROM s_running WHERE max_redemptions IS NULL OR current_redemptions <= max_redemptions
), s_carts AS (
  SELECT o_orderkey AS id, o_custkey AS user_id, o_orderdate AS created_at, {NOW} - to_minutes(o_orderkey % 240) AS updated_at
  FROM orders
), s_cart_lines AS (
  SELECT l_orderkey AS cart_id, l_partkey AS menu_item_id, CAST(l_quantity AS INTEGER) AS quantity, m.price_in_cents
  FROM lineitem JOIN s_menu m ON m.id = l_partkey
), s_decisions AS (
  SELECT case_id, CASE WHEN message_id % 11 = 0 THEN 'unheard_of' ELSE suggested_action END AS admin_action,
         CASE WHEN message_id % 13 = 0 THEN -1 WHEN suggested_action = 'refund' THEN suggested_amount_cents * 100000
              ELSE suggested_amount_cents END AS admin_amount_cents,
         suggested_response AS admin_response, generated_at AS created_at
  FROM s_drafts
), s_checked AS (
  SELECT *, concat_ws(',', CASE WHEN admin_action NOT IN ('refund', 'credit', 'no_action', 'escalate', 'resolve') THEN 'admin_action' END,
                      CASE WHEN admin_amount_cents < 0 THEN 'admin_amount_cents' END) AS reject_reason
  FROM s_decisions
), s_good AS (
  SELECT k.* EXCLUDE (reject_reason), c.user_id, c.status AS old_status
  FROM s_checked k JOIN s_cases c ON c.id = k.case_id WHERE reject_reason = ''
), s_history AS (
  SELECT user_id AS id, value, props, event_type = 'error' AS gone, event_id AS lsn, ts FROM events
), s_steps AS (
  SELECT user_id AS id, event_id AS lsn,
         CASE WHEN event_type = 'signup' THEN 'pending' WHEN event_type = 'view' THEN 'preparing'
              WHEN event_type = 'click' THEN 'ready' WHEN event_type = 'purchase' AND value < 10 THEN 'delivered'
              WHEN event_type = 'purchase' THEN 'out_for_delivery' ELSE 'cancelled' END AS status
  FROM events
), s_runs AS (
  SELECT event_id AS id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'running' ELSE 'completed' END AS status,
         ts AS started_at, CAST(json_extract(props, '$.k') AS BIGINT) AS k
  FROM events
), s_first_reply AS (
  SELECT case_id, min(created_at) FILTER (admin_id IS NOT NULL) AS replied_at, min(created_at) AS opened_at,
         max(created_at) AS closed_at, count(*) AS n, bool_or(admin_id IS NOT NULL) AS answered
  FROM s_messages GROUP BY ALL
), s_paid AS (
  SELECT c.id AS case_id,
         CAST(coalesce((SELECT sum(amount_in_cents) FROM s_refunds r WHERE r.support_case_id = c.id), 0) AS BIGINT) AS refunded,
         CAST(coalesce((SELECT sum(amount_in_cents) FROM s_credits r WHERE r.support_case_id = c.id), 0) AS BIGINT) AS credited
  FROM s_cases c
), s_spend AS (
  SELECT u.id AS user_id, CAST(coalesce(sum(o.total_in_cents), 0) AS BIGINT) AS spend
  FROM s_users u LEFT JOIN s_orders o ON o.user_id = u.id GROUP BY u.id
), s_newest_order AS (
  SELECT * FROM s_orders QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) = 1
)"""


def _with(more: str, select: str) -> str:
    return f"WITH {BASE.strip()}{', ' + more if more else ''}\n{select}"


def _q(select: str) -> str:
    return _with("", select)


DAILY_REVENUE = _with(
    """d AS (
  SELECT CAST(created_at AS DATE) AS order_date, count(DISTINCT id) AS n, CAST(sum(total_in_cents) AS BIGINT) AS gross
  FROM s_orders GROUP BY ALL
), sold AS (
  SELECT CAST(o.created_at AS DATE) AS order_date, category, sum(quantity) AS q, sum(i.price_in_cents * quantity) AS cents
  FROM s_items i JOIN s_orders o ON o.id = i.order_id LEFT JOIN s_menu m ON m.id = i.menu_item_id GROUP BY ALL
), back AS (
  SELECT CAST(o.created_at AS DATE) AS order_date, sum(r.amount_in_cents) AS cents
  FROM s_refunds r JOIN s_orders o ON o.id = r.order_id WHERE r.status = 'approved' GROUP BY ALL
), given AS (
  SELECT CAST(created_at AS DATE) AS order_date, sum(amount_in_cents) AS cents FROM s_credits GROUP BY ALL
), best AS (
  SELECT order_date, first(category ORDER BY cents DESC, category) AS top_category, sum(q) AS q FROM sold GROUP BY ALL
)""",
    """SELECT d.order_date, n AS total_orders, gross AS gross_revenue_cents,
  CAST(coalesce(b.cents, 0) AS BIGINT) AS total_refunds_cents, CAST(coalesce(g.cents, 0) AS BIGINT) AS total_credits_cents,
  CAST(gross - coalesce(b.cents, 0) - coalesce(g.cents, 0) AS BIGINT) AS net_revenue_cents,
  gross // n AS avg_order_value_cents, CAST(coalesce(best.q, 0) AS BIGINT) AS items_sold, top_category
FROM d LEFT JOIN best USING (order_date) LEFT JOIN back b USING (order_date) LEFT JOIN given g USING (order_date)""",
)

OVERVIEW_CTE = """overview AS (
  SELECT CAST(c.created_at AS DATE) AS case_date, count(*) AS total_cases,
         count(*) FILTER (c.status = 'open') AS open_cases, count(*) FILTER (c.status = 'resolved') AS resolved_cases,
         coalesce(avg(f.n), 0) AS avg_messages_per_case,
         coalesce(avg(date_sub('minute', c.created_at, f.replied_at)), 0) AS avg_first_response_minutes,
         count(*) FILTER (c.id IN (SELECT support_case_id FROM s_refunds WHERE support_case_id IS NOT NULL)) AS cases_with_refund,
         count(*) FILTER (c.id IN (SELECT support_case_id FROM s_credits WHERE support_case_id IS NOT NULL)) AS cases_with_credit,
         CAST(sum(p.refunded) AS BIGINT) AS total_refund_cents, CAST(sum(p.credited) AS BIGINT) AS total_credit_cents
  FROM s_cases c JOIN s_paid p ON p.case_id = c.id LEFT JOIN s_first_reply f ON f.case_id = c.id GROUP BY ALL
)"""

METRICS_SELECT = """SELECT * REPLACE (round(avg_messages_per_case, 1) AS avg_messages_per_case,
  round(avg_first_response_minutes, 0) AS avg_first_response_minutes) FROM overview"""


def _profile(cut: str) -> str:
    return f"""SELECT u.id AS user_id, u.name, u.email, u.region,
  (SELECT count(*) FROM s_orders x WHERE x.user_id = u.id AND x.created_at >= {cut}) AS total_orders_90d,
  CAST(coalesce((SELECT sum(total_in_cents) FROM s_orders x WHERE x.user_id = u.id AND x.created_at >= {cut}), 0) AS BIGINT)
    AS total_spend_90d_cents,
  (SELECT count(*) FROM s_orders x WHERE x.user_id = u.id) AS lifetime_order_count, s.spend AS lifetime_spend_cents,
  (SELECT count(*) FROM s_cases x WHERE x.user_id = u.id AND x.created_at >= {cut}) AS support_cases_90d,
  (SELECT count(*) FROM s_cases x WHERE x.user_id = u.id) AS support_cases_lifetime,
  CAST(coalesce((SELECT sum(amount_in_cents) FROM s_refunds x WHERE x.user_id = u.id AND x.created_at >= {cut}), 0) AS BIGINT)
    AS total_refunds_90d_cents,
  CAST(coalesce((SELECT sum(amount_in_cents) FROM s_credits x WHERE x.user_id = u.id AND x.created_at >= {cut}), 0) AS BIGINT)
    AS total_credits_90d_cents,
  (SELECT max(created_at) FROM s_orders x WHERE x.user_id = u.id) AS last_order_date,
  (SELECT max(created_at) FROM s_cases x WHERE x.user_id = u.id) AS last_support_case_date
FROM s_users u JOIN s_spend s ON s.user_id = u.id"""


PROFILE = _q(_profile(CUT_DAY))

CONTEXT_SELECT = f"""SELECT c.id AS case_id, c.user_id, u.name AS user_name, u.email AS user_email, u.region AS user_region,
  c.subject, c.status, c.created_at AS case_created_at, coalesce(f.n, 0) AS message_count,
  f.opened_at AS first_message_at, f.closed_at AS last_message_at, coalesce(f.answered, false) AS has_admin_reply,
  date_sub('minute', c.created_at, f.replied_at) AS first_response_minutes, p.refunded AS linked_refund_cents,
  p.credited AS linked_credit_cents, s.spend AS user_lifetime_spend_cents,
  (SELECT count(*) FROM s_cases x WHERE x.user_id = c.user_id AND x.created_at >= {CUT_DAY}) AS user_cases_90d
FROM s_cases c JOIN s_users u ON u.id = c.user_id JOIN s_spend s ON s.user_id = u.id JOIN s_paid p ON p.case_id = c.id
LEFT JOIN s_first_reply f ON f.case_id = c.id"""

# --- change histories: current state is arg_max, then deletes go ---
CURRENT = _q(
    """SELECT id, value, props FROM s_history
QUALIFY lsn = max(lsn) OVER (PARTITION BY id) AND NOT gone"""
)
AS_OF_SQL = _q(
    """SELECT id, value, props FROM (SELECT * FROM s_history WHERE lsn <= (SELECT max(lsn) // 2 FROM s_history))
QUALIFY lsn = max(lsn) OVER (PARTITION BY id) AND NOT gone"""
)
SCD2 = _q(
    """SELECT id, lsn, value, ts AS valid_from, next_ts AS valid_to, next_ts IS NULL AS is_current
FROM (SELECT *, lead(ts) OVER (PARTITION BY id ORDER BY lsn) AS next_ts FROM s_history) WHERE NOT gone"""
)
DIFF = _with(
    """old AS (
  SELECT id, value, props FROM (SELECT * FROM s_history WHERE lsn <= (SELECT max(lsn) // 2 FROM s_history)) QUALIFY lsn = max(lsn) OVER (PARTITION BY id) AND NOT gone
), new AS (
  SELECT id, value, props FROM s_history QUALIFY lsn = max(lsn) OVER (PARTITION BY id) AND NOT gone
)""",
    """SELECT n.id, n.value, n.props, 'insert' AS change FROM new n WHERE n.id NOT IN (SELECT id FROM old)
UNION ALL SELECT o.id, o.value, o.props, 'delete' FROM old o WHERE o.id NOT IN (SELECT id FROM new)
UNION ALL SELECT n.id, n.value, n.props, 'update' FROM new n JOIN old o USING (id)
WHERE n.value IS DISTINCT FROM o.value OR n.props IS DISTINCT FROM o.props""",
)


def _silver(rows: str, column: str, k: str = "k") -> str:
    """What is left of a table after its history: rows with k % 7 <> 0, every third one changed."""
    return _q(
        f"""SELECT * EXCLUDE (k) REPLACE ({column} || CASE WHEN {k} % 3 = 0 THEN ' (changed)' ELSE '' END AS {column})
FROM ({rows}) WHERE {k} % 7 <> 0"""
    )


_LINE = """concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y%m%d')) AS id,
  l_orderkey + l_partkey AS k, l_orderkey, l_partkey"""
_LINE_CENTS = "CAST(round(l_extendedprice * 100) AS BIGINT) AS amount_in_cents"
SILVER = {
    "silver_users": _silver("SELECT *, id AS k FROM s_users", "name"),
    "silver_orders": _silver("SELECT *, id AS k FROM s_orders", "status"),
    "silver_menu_items": _silver("SELECT *, id AS k FROM s_menu", "name"),
    "silver_support_cases": _silver("SELECT *, id AS k FROM s_cases", "status"),
    "silver_support_messages": _silver("SELECT *, id AS k FROM s_messages", "content"),
    "silver_admins": _silver("SELECT s_suppkey AS id, s_name AS name, lower(s_name) AS email, s_suppkey AS k FROM supplier", "name"),
    "silver_order_items": _silver(f"SELECT {_LINE}, l_returnflag, {_LINE_CENTS} FROM lineitem", "l_returnflag"),
    "silver_refunds": _silver(
        f"SELECT {_LINE}, l_linestatus, {_LINE_CENTS} FROM lineitem WHERE l_returnflag = 'R'", "l_linestatus"
    ),
    "silver_credits": _silver(
        f"SELECT {_LINE}, l_linestatus, {_LINE_CENTS} FROM lineitem WHERE l_returnflag = 'A'", "l_linestatus"
    ),
}

# --- agent ---
UNANSWERED_CTE = """waiting AS (
  SELECT m.id AS message_id, m.case_id, hex(m.case_id) AS case_id_hex, c.user_id, c.subject, c.status
  FROM s_messages m JOIN s_cases c ON c.id = m.case_id
  WHERE c.status IN ('open', 'in_progress') AND m.admin_id IS NULL AND m.id NOT IN (SELECT message_id FROM s_drafts)
  QUALIFY row_number() OVER (PARTITION BY m.case_id ORDER BY m.created_at DESC, m.id DESC) = 1
)"""
STRICT = _q(
    """SELECT m.id AS message_id, m.case_id, hex(m.case_id) AS case_id_hex, c.user_id, c.subject, c.status
FROM (SELECT * FROM s_messages QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY created_at DESC, id DESC) = 1) m
JOIN s_cases c ON c.id = m.case_id
WHERE c.status IN ('open', 'in_progress') AND m.admin_id IS NULL AND m.id NOT IN (SELECT message_id FROM s_drafts)"""
)
PROMPT_CTE = f"""{UNANSWERED_CTE}, context AS ({CONTEXT_SELECT}), profile AS ({_profile(CUT_DAY)}), newest AS (
  SELECT user_id, string_agg('  [' || strftime(created_at, '%Y-%m-%d %H:%M') || '] $' || printf('%.2f', total_in_cents / 100.0)
           || ' — ' || status, chr(10) ORDER BY created_at DESC, id DESC) AS listed,
         first(total_in_cents ORDER BY created_at DESC, id DESC) AS latest
  FROM (SELECT * FROM s_orders QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) <= 5)
  GROUP BY user_id
), thread AS (
  SELECT case_id, string_agg('  [' || strftime(created_at, '%H:%M') || '] '
           || CASE WHEN admin_id IS NULL THEN 'CUSTOMER' ELSE 'ADMIN' END || ': ' || content, chr(10) ORDER BY created_at, id) AS said
  FROM s_messages GROUP BY case_id
), prompts AS (
  SELECT w.message_id, w.case_id, w.user_id, w.subject, concat_ws(chr(10),
    'Subject: ' || w.subject, 'Status: ' || w.status,
    'Customer: ' || c.user_name || ' (' || c.user_email || '), region: ' || c.user_region,
    'Messages so far: ' || c.message_count,
    'Admin has replied: ' || CASE WHEN c.has_admin_reply THEN 'True' ELSE 'False' END,
    'First response time: ' || c.first_response_minutes || ' minutes',
    'Linked refunds: $' || printf('%.2f', c.linked_refund_cents / 100.0),
    'Linked credits: $' || printf('%.2f', c.linked_credit_cents / 100.0),
    '', 'Customer Profile:',
    '  Lifetime orders: ' || p.lifetime_order_count || ', spend: $' || printf('%.2f', p.lifetime_spend_cents / 100.0),
    '  Last 90 days: ' || p.total_orders_90d || ' orders, $' || printf('%.2f', p.total_spend_90d_cents / 100.0) || ' spent',
    '  Support cases (90d): ' || p.support_cases_90d,
    '  Refunds (90d): $' || printf('%.2f', p.total_refunds_90d_cents / 100.0),
    '  Credits (90d): $' || printf('%.2f', p.total_credits_90d_cents / 100.0),
    CASE WHEN n.user_id IS NULL THEN chr(10) || 'No recent orders found.' ELSE concat_ws(chr(10), '',
      'Recent Orders (newest first):', n.listed, '  Most recent order total: $' || printf('%.2f', n.latest / 100.0)) END,
    '', 'Message Thread:', t.said) AS prompt
  FROM waiting w JOIN context c USING (case_id) JOIN profile p ON p.user_id = w.user_id
  LEFT JOIN newest n ON n.user_id = w.user_id LEFT JOIN thread t ON t.case_id = w.case_id
)"""

REPLY_CTE = """replies AS (
  SELECT id AS message_id, case_id, user_id, id % 12 AS kind FROM s_messages WHERE admin_id IS NULL
), fields AS (
  SELECT message_id, case_id, user_id, kind,
    CASE kind WHEN 0 THEN 'refund' WHEN 1 THEN 'credit' WHEN 2 THEN 'escalate' WHEN 5 THEN 'refund' WHEN 10 THEN 'resolve'
      ELSE 'no_action' END AS suggested_action,
    CASE kind WHEN 0 THEN 1250 WHEN 1 THEN 300 WHEN 3 THEN 5 WHEN 5 THEN 12 WHEN 10 THEN 99 ELSE 0 END AS suggested_amount_cents
  FROM replies
), parsed AS (
  SELECT message_id, case_id, user_id, CASE WHEN kind = 4 THEN '' ELSE 's' || message_id END AS case_summary,
    CASE WHEN kind = 4 THEN '' ELSE 'r' || message_id END AS suggested_response, suggested_action, suggested_amount_cents,
    CASE WHEN kind = 4 THEN '' ELSE 'w' || message_id END AS reasoning, 'sample' AS model,
    TIMESTAMP '2001-07-30 12:00:00' AS generated_at
  FROM fields WHERE kind IN (0, 1, 2, 3, 4, 5, 10)
)"""
_JSON_HEAD = """'{"case_summary":"s' || message_id || '","suggested_response":"r' || message_id || '","suggested_action":"'"""


def _json(action: str, cents: str) -> str:
    return f"""{_JSON_HEAD} || '{action}","suggested_amount_cents":{cents},"reasoning":"w' || message_id || '"}}'"""


QUARANTINE = _with(
    REPLY_CTE,
    f"""SELECT message_id, case_id, user_id, CASE kind WHEN 6 THEN {_json('refund', '"abc"')} WHEN 7 THEN substr({_json('credit', '1')}, 1, 40)
  WHEN 8 THEN '[' || {_json('credit', '1')} || ']' WHEN 9 THEN {_json('credit', '1')} || ' done'
  ELSE {_json('no_action', 'null')} END AS raw_reply,
  CASE kind WHEN 6 THEN 'bad amount' WHEN 8 THEN 'not an object' WHEN 11 THEN 'bad amount' ELSE 'not json' END AS reject_reason,
  NULL::VARCHAR AS responder_error, {NOW} AS generated_at
FROM replies WHERE kind IN (6, 7, 8, 9, 11)""",
)

PUBLISHED = _with(
    REPLY_CTE,
    """SELECT * FROM s_drafts UNION ALL BY NAME
SELECT * FROM parsed p WHERE NOT EXISTS (SELECT 1 FROM s_drafts d WHERE d.message_id = p.message_id)""",
)

POLICY = _with(
    f"""{UNANSWERED_CTE}, context AS ({CONTEXT_SELECT}), facts AS (
  SELECT w.message_id, w.case_id, w.user_id, w.status, coalesce(o.total_in_cents, 0) AS order_cents,
    ['late delivery', 'missing items', 'wrong order received', 'cold food', 'food quality issue', 'delivery never arrived',
     'something else'][w.case_id % 7 + 1] AS subject,
    c.linked_refund_cents + c.linked_credit_cents > 0 AS paid, c.has_admin_reply, c.user_cases_90d AS cases,
    CASE WHEN c.user_lifetime_spend_cents > 20000 THEN 1 ELSE 0 END AS high, w.case_id % 5 = 0 AS thanks
  FROM waiting w JOIN context c USING (case_id) LEFT JOIN s_newest_order o ON o.user_id = w.user_id
), ruled AS (
  SELECT *, CASE WHEN thanks AND (paid OR has_admin_reply) THEN 'resolve' WHEN status = 'resolved' AND paid THEN 'no_action'
      WHEN cases >= 3 THEN 'escalate' WHEN subject IN ('missing items', 'wrong order received', 'delivery never arrived') THEN 'refund'
      WHEN subject IN ('late delivery', 'cold food', 'food quality issue') THEN 'credit' ELSE 'no_action' END AS action,
    CASE subject WHEN 'late delivery' THEN CASE WHEN cases > 1 THEN 30 + 20 * high ELSE 15 + 10 * high END
      WHEN 'missing items' THEN 30 + 30 * high WHEN 'cold food' THEN 20 + 20 * high WHEN 'food quality issue' THEN 20 + 20 * high
      ELSE 100 END AS percent
  FROM facts
)""",
    """SELECT message_id, case_id, user_id, action AS suggested_action,
  CASE WHEN action IN ('refund', 'credit') THEN order_cents * percent // 100 ELSE 0 END AS suggested_amount_cents FROM ruled""",
)

# --- console ---
ROUNDED = "CAST(round(epoch(f.replied_at - f.opened_at) / 60) AS INTEGER)"
QUEUE_CTE = f"""queue AS (
  SELECT c.id AS case_id, c.user_id, u.name AS user_name, u.email AS user_email, c.subject, c.status, c.created_at AS case_created_at,
    CAST(coalesce(f.n, 0) AS INTEGER) AS message_count, coalesce(f.answered, false) AS has_admin_reply,
    {ROUNDED} AS first_response_minutes, d.suggested_action, d.suggested_amount_cents, d.case_summary
  FROM s_cases c JOIN s_users u ON u.id = c.user_id LEFT JOIN s_first_reply f ON f.case_id = c.id
  LEFT JOIN (SELECT * FROM s_drafts QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY generated_at DESC, message_id DESC) = 1) d
    ON d.case_id = c.id
)"""
NUMBERED = """SELECT row_number() OVER (ORDER BY created_at, case_id, admin_action, admin_amount_cents, admin_response) AS id,
  case_id, admin_action, admin_amount_cents, admin_response, created_at FROM s_good"""
AGE = """CASE WHEN m < 60 THEN m || 'm ago'
  WHEN m < 1440 THEN m // 60 || 'h' || CASE WHEN m % 60 > 0 THEN ' ' || m % 60 || 'm' ELSE '' END || ' ago'
  ELSE m // 1440 || 'd' || CASE WHEN m // 60 % 24 > 0 THEN ' ' || m // 60 % 24 || 'h' ELSE '' END || ' ago' END"""
RESPONSE = _with(
    f"""asked AS (
  SELECT case_id, max(created_at) AS last_customer_at FROM s_messages WHERE admin_id IS NULL GROUP BY case_id
), pairs AS (
  SELECT a.*, (SELECT min(created_at) FROM s_messages m WHERE m.case_id = a.case_id AND m.admin_id IS NOT NULL
               AND m.created_at > a.last_customer_at) AS first_reply_at FROM asked a
), spans AS (
  SELECT *, CAST(round(epoch(first_reply_at - last_customer_at)) AS BIGINT) AS r,
    CASE WHEN first_reply_at IS NULL THEN CAST(floor(epoch({NOW} - last_customer_at)) AS BIGINT) END AS w FROM pairs
)""",
    """SELECT case_id, last_customer_at, first_reply_at, first_reply_at IS NULL AS is_waiting, r AS response_seconds,
  CASE WHEN r < 60 THEN r || ' seconds' WHEN r // 60 = 1 THEN '1 minute' WHEN r < 3600 THEN r // 60 || ' minutes'
       WHEN r >= 3600 THEN r // 3600 || 'h ' || r // 60 % 60 || 'm' END AS response_text,
  w AS waiting_seconds,
  CASE WHEN w < 60 THEN w || 's' WHEN w < 3600 THEN w // 60 || 'm ' || w % 60 || 's'
       WHEN w >= 3600 THEN w // 3600 || 'h ' || w // 60 % 60 || 'm' END AS waiting_text
FROM spans""",
)
UUID_OF = "substr({0}, 1, 8) || '-' || substr({0}, 9, 4) || '-' || substr({0}, 13, 4) || '-' || substr({0}, 17, 4) || '-' || substr({0}, 21, 12)"

# --- commerce ---
CART_TOTALS = """totals AS (
  SELECT cart_id, count(*) AS lines, CAST(sum(quantity) AS BIGINT) AS quantity,
    CAST(sum(price_in_cents * quantity) AS BIGINT) AS total_in_cents FROM s_cart_lines GROUP BY cart_id
)"""
MULTIPLIERS = """multipliers AS (
  SELECT coalesce(region, 'global') AS region, greatest(1.0::DOUBLE, max(traffic_multiplier / 100.0)) AS multiplier
  FROM s_running GROUP BY ALL
)"""
LOCAL_TIME = _q(
    """SELECT CAST(hour(here) AS INTEGER) AS local_hour, ['Sun', 'Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat'][dayofweek(here) + 1] AS local_weekday,
  count(*) AS orders
FROM (SELECT timezone(CASE u.region WHEN 'AMERICA' THEN 'America/New_York' WHEN 'EUROPE' THEN 'Europe/London' WHEN 'ASIA' THEN 'Asia/Tokyo'
        ELSE 'UTC' END, timezone('UTC', CAST(o.created_at AS TIMESTAMP))) AS here
      FROM s_orders o LEFT JOIN s_users u ON u.id = o.user_id)
GROUP BY ALL"""
)
AUDIT_CTE = """audit AS (
  SELECT *, CASE WHEN previous_status IS NULL THEN 'start' WHEN previous_status = status THEN 'unchanged'
    WHEN (previous_status || '>' || status) IN ('pending>preparing', 'preparing>ready', 'ready>out_for_delivery',
      'out_for_delivery>delivered', 'pending>cancelled') THEN 'ok'
    WHEN status IN ('out_for_delivery', 'delivered') THEN 'warning' ELSE 'violation' END AS verdict
  FROM (SELECT *, lag(status) OVER (PARTITION BY id ORDER BY lsn) AS previous_status FROM s_steps)
)"""
NEWEST_RUNS = "newest_runs AS (SELECT * FROM s_runs ORDER BY started_at DESC, id DESC LIMIT 10)"
_NO_COUNTERS = ", ".join(
    f'CAST(NULL AS BIGINT) AS "{name}"'
    for name in (
        "signIns cartAdds checkouts cancellations supportCases supportMessages ordersProgressed driversAssigned "
        "deliveriesProgressed adminReplies cleanups"
    ).split()
)

ORACLE: dict[str, str] = {
    "daily_revenue": DAILY_REVENUE,
    "daily_revenue_materialized": DAILY_REVENUE,
    "support_overview": _with(OVERVIEW_CTE, "SELECT * FROM overview"),
    "user_support_profile": PROFILE,
    "snapshot_sync_check": PROFILE,
    "support_case_context": _q(CONTEXT_SELECT),
    **{f"support_overview_{kind}": _with(OVERVIEW_CTE, "SELECT * FROM overview") for kind in ("materialized", "snapshot")},
    **{f"support_case_context_{kind}": _q(CONTEXT_SELECT) for kind in ("materialized", "snapshot")},
    **{f"user_support_profile_{kind}": PROFILE for kind in ("materialized", "snapshot")},
    "cdc_current_state": CURRENT,
    "cdc_current_state_stream": CURRENT,
    "cdc_keyed_state_stream": CURRENT,
    "cdc_scd2": SCD2,
    "cdc_as_of": AS_OF_SQL,
    "cdc_diff": DIFF,
    **SILVER,
    **{f"{name}_stream": sql for name, sql in SILVER.items()},
    **{f"{name}_change_feed": SILVER[name] for name in ("silver_orders", "silver_support_cases")},
    "unanswered_messages": _with(UNANSWERED_CTE, "SELECT * FROM waiting"),
    "unanswered_messages_strict": STRICT,
    "case_prompts": _with(
        PROMPT_CTE.replace(", t.said) AS prompt", ") AS prompt"),
        """SELECT message_id, case_id, user_id, NULL::TIMESTAMP AS sent_at, NULL::BIGINT AS line_id, prompt AS text FROM prompts
UNION ALL SELECT w.message_id, w.case_id, w.user_id, m.created_at, m.id, '  [' || strftime(m.created_at, '%H:%M') || '] '
  || CASE WHEN m.admin_id IS NULL THEN 'CUSTOMER' ELSE 'ADMIN' END || ': ' || m.content
FROM prompts w JOIN s_messages m USING (case_id)""",
    ),
    "agent_responses": _with(
        PROMPT_CTE,
        f"""SELECT message_id, case_id, user_id, subject AS case_summary, 'ok' AS suggested_response, 'credit' AS suggested_action,
  CAST(length(prompt) AS INTEGER) AS suggested_amount_cents, 'length' AS reasoning, 'echo' AS model, {NOW} AS generated_at
FROM prompts WHERE length(prompt) % 7 <> 0""",
    ),
    "agent_responses_quarantine": _with(
        PROMPT_CTE,
        f"""SELECT message_id, case_id, user_id, 'I can not help with that.' AS raw_reply, 'not json' AS reject_reason,
  NULL::VARCHAR AS responder_error, {NOW} AS generated_at
FROM prompts WHERE length(prompt) % 7 = 0""",
    ),
    "agent_responses_validated": _with(REPLY_CTE, "SELECT * FROM parsed"),
    "agent_quarantine": QUARANTINE,
    "agent_publish_insert_only": PUBLISHED,
    "response_feed": PUBLISHED,
    "agent_responses_typed": _with(
        REPLY_CTE,
        """SELECT * REPLACE (md5(CAST(message_id AS VARCHAR)) AS message_id, md5(CAST(case_id AS VARCHAR)) AS case_id,
  CAST(user_id AS VARCHAR) AS user_id) FROM parsed""",
    ),
    "policy_suggestions": POLICY,
    "case_queue": _with(QUEUE_CTE, "SELECT * FROM queue"),
    "case_detail": _q(
        f"""SELECT c.id AS case_id, c.user_id, u.name AS user_name, u.email AS user_email, u.region AS user_region, c.subject, c.status,
  c.created_at AS case_created_at, CAST(coalesce(f.n, 0) AS INTEGER) AS message_count, coalesce(f.answered, false) AS has_admin_reply,
  {ROUNDED} AS first_response_minutes, p.refunded AS linked_refund_cents, p.credited AS linked_credit_cents,
  s.spend AS user_lifetime_spend_cents,
  CAST((SELECT count(*) FROM s_cases x WHERE x.user_id = c.user_id AND x.created_at >= {CUT_TIME}) AS INTEGER) AS user_cases_90d
FROM s_cases c JOIN s_users u ON u.id = c.user_id JOIN s_spend s ON s.user_id = u.id JOIN s_paid p ON p.case_id = c.id
LEFT JOIN s_first_reply f ON f.case_id = c.id"""
    ),
    "message_thread": _q(
        "SELECT case_id, id, CASE WHEN admin_id IS NULL THEN 'customer' ELSE 'admin' END AS role, content, created_at FROM s_messages"
    ),
    "draft_history": _q(
        """SELECT case_id, lower(hex(message_id)) AS message_id, case_summary, suggested_response, suggested_action,
  suggested_amount_cents, reasoning, model, generated_at,
  row_number() OVER (PARTITION BY case_id ORDER BY generated_at DESC, s_drafts.message_id DESC) = 1 AS is_latest FROM s_drafts"""
    ),
    "user_profile_now": _q(
        f"SELECT * EXCLUDE (name, email, region, last_order_date, last_support_case_date) FROM ({_profile(CUT_TIME)})"
    ),
    "decisions_applied": _q(NUMBERED),
    "decision_messages": _q(
        """SELECT case_id, (SELECT min(s_suppkey) FROM supplier) AS admin_id, admin_response AS content, created_at FROM s_good"""
    ),
    "decision_case_updates": _q(
        """SELECT case_id, old_status, CASE WHEN bool_or(admin_action = 'resolve') THEN 'resolved'
  WHEN old_status = 'open' THEN 'in_progress' ELSE old_status END AS status, max(created_at) AS updated_at FROM s_good GROUP BY case_id, old_status"""
    ),
    "decision_refunds": _q(
        """SELECT g.user_id, o.id AS order_id, g.case_id AS support_case_id,
  CAST(least(g.admin_amount_cents, o.total_in_cents) AS BIGINT) AS amount_in_cents, g.admin_response AS reason, 'pending' AS status,
  g.created_at FROM s_good g JOIN s_newest_order o ON o.user_id = g.user_id
WHERE admin_action = 'refund' AND admin_amount_cents > 0"""
    ),
    "decision_credits": _q(
        """SELECT user_id, case_id AS support_case_id, CAST(admin_amount_cents AS BIGINT) AS amount_in_cents, admin_response AS reason,
  created_at FROM s_good WHERE admin_action = 'credit' AND admin_amount_cents > 0"""
    ),
    "decision_rejects": _q("SELECT * FROM s_checked WHERE reject_reason <> ''"),
    "decision_history": _q(NUMBERED.replace("ORDER BY created_at", "ORDER BY admin_action = 'credit', created_at")),
    "support_metrics": _with(OVERVIEW_CTE, METRICS_SELECT),
    "agent_performance": _q(
        """SELECT suggested_action AS action, count(*) AS count, round(avg(suggested_amount_cents), 0) AS avg_amount_cents
FROM s_drafts GROUP BY ALL"""
    ),
    "kpi_latest": _with(
        OVERVIEW_CTE,
        f"""SELECT case_date, CAST(total_cases AS VARCHAR) AS total_cases, open_cases || ' open' AS open_text,
  CAST(avg_first_response_minutes AS BIGINT) || 'm' AS response_text, CAST(cases_with_refund AS VARCHAR) AS refund_cases,
  '$' || printf('%.2f', total_refund_cents / 100.0) || ' total' AS refund_text, regexp_replace(printf('%.1f', avg_messages_per_case), '\\.0$', '') AS avg_messages
FROM ({METRICS_SELECT}) ORDER BY case_date DESC LIMIT 1""",
    ),
    "queue_search": _with(
        QUEUE_CTE,
        f"""SELECT * EXCLUDE (m), CASE WHEN status IN ('resolved', 'closed') THEN 'resolved' ELSE 'needs_attention' END AS section,
  {AGE} AS age FROM (SELECT *, date_sub('minute', case_created_at, {NOW}) AS m FROM queue) WHERE subject LIKE '%case 1%'""",
    ),
    "queue_search_indexed": _with(
        QUEUE_CTE,
        f"""SELECT * EXCLUDE (m), CASE WHEN status IN ('resolved', 'closed') THEN 'resolved' ELSE 'needs_attention' END AS section,
  {AGE} AS age FROM (SELECT *, date_sub('minute', case_created_at, {NOW}) AS m FROM queue) WHERE subject LIKE '%case 1%'""",
    ),
    "queue_sections": _q(
        """SELECT CASE WHEN status IN ('resolved', 'closed') THEN 'resolved' ELSE 'needs_attention' END AS section, count(*) AS cases
FROM s_cases SEMI JOIN s_users u ON u.id = user_id GROUP BY ALL"""
    ),
    "response_time": RESPONSE,
    "case_activity": _q(
        """SELECT *, '$' || printf('%.2f', amount_in_cents / 100.0) || ' ' || kind AS label FROM (
  SELECT support_case_id AS case_id, 'refund' AS kind, * EXCLUDE (support_case_id) FROM s_refunds
  UNION ALL BY NAME SELECT support_case_id AS case_id, 'credit' AS kind, * EXCLUDE (support_case_id) FROM s_credits
) WHERE case_id IS NOT NULL"""
    ),
    "binary_key_join": _q(
        f"""SELECT u AS case_uuid, substr(u, 1, 8) AS short_id, u AS key_text, n AS drafts
FROM (SELECT {UUID_OF.format("md5(CAST(case_id AS VARCHAR))")} AS u, count(*) AS n FROM s_drafts GROUP BY case_id)"""
    ),
    "normalised_ids": _q(
        f"SELECT id, CASE WHEN id % 5 < 4 THEN {UUID_OF.format('md5(CAST(id AS VARCHAR))')} END AS uuid FROM s_users"
    ),
    "order_detail": _q(
        """SELECT o.id AS order_id, o.user_id, o.status, o.total_in_cents, o.created_at AS ordered_at, i.menu_item_id, m.name, i.quantity,
  i.price_in_cents FROM s_items i JOIN s_orders o ON o.id = i.order_id JOIN s_menu m ON m.id = i.menu_item_id"""
    ),
    "user_orders": _q("SELECT user_id, id AS order_id, status, total_in_cents, created_at FROM s_orders"),
    "user_orders_top5": _q(
        """SELECT user_id, id AS order_id, status, total_in_cents, created_at, CAST(rank AS INTEGER) AS order_rank FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS rank FROM s_orders) WHERE rank <= 5"""
    ),
    "cart_pricing": _with(
        CART_TOTALS, "SELECT cart_id, c.user_id, lines, quantity, total_in_cents FROM totals JOIN s_carts c ON c.id = cart_id"
    ),
    "checkout_orders": _with(
        CART_TOTALS,
        f"""SELECT cart_id AS id, c.user_id, 'pending' AS status, total_in_cents, {NOW} AS created_at
FROM totals JOIN s_carts c ON c.id = cart_id""",
    ),
    "checkout_order_items": _q(
        """SELECT cart_id AS order_id, menu_item_id, quantity, price_in_cents FROM s_cart_lines
WHERE cart_id IN (SELECT id FROM s_carts)"""
    ),
    "checkout_carts_left": _q("SELECT * FROM s_carts WHERE id NOT IN (SELECT cart_id FROM s_cart_lines)"),
    "cart_line_merge": """SELECT l_suppkey AS cart_id, l_partkey AS menu_item_id,
  CAST(sum(CASE WHEN l_linenumber <= 3 THEN 1 ELSE CAST(l_quantity AS INTEGER) END) AS BIGINT) AS quantity
FROM lineitem GROUP BY ALL""",
    "delivery_board": """SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS order_id, l_suppkey AS driver_id,
  CASE l_linestatus WHEN 'F' THEN 'delivered' ELSE 'in_transit' END AS status, l_shipdate AS started_at,
  CASE l_linestatus WHEN 'F' THEN l_shipdate + to_hours(2) END AS delivered_at, s_name AS driver_name
FROM lineitem JOIN supplier ON s_suppkey = l_suppkey""",
    "available_menu": _q("SELECT * FROM s_menu WHERE available"),
    "promos_for_users": _q(
        """SELECT u.id AS user_id, u.region, CAST(count(p.code) AS INTEGER) AS promo_count,
  coalesce(string_agg(p.code, ',' ORDER BY p.code), '') AS promo_codes
FROM s_users u LEFT JOIN s_offers p ON p.region = u.region OR p.region IS NULL GROUP BY u.id, u.region"""
    ),
    "promotions_of_users": _q(
        """SELECT u.id AS user_id, p.id, code, p.name, description, discount_strategy, p.region, category, starts_at, ends_at
FROM s_users u JOIN s_offers p ON p.region = u.region OR p.region IS NULL"""
    ),
    "promo_check": _with(
        """entered AS (
  SELECT c_custkey AS user_id, 'brand#' || c_custkey % 30 AS code, c_custkey IN (SELECT o_custkey FROM orders) AS shopping FROM customer
), matched AS (
  SELECT e.user_id, e.code, e.shopping, p.id, p.name, p.discount_strategy
  FROM entered e LEFT JOIN s_offers p ON p.code = upper(e.code) AND e.shopping
)""",
        """SELECT user_id, code, id IS NOT NULL AS valid,
  CASE WHEN NOT shopping THEN 'no active cart' WHEN id IS NULL THEN 'invalid or expired' END AS problem,
  id AS promotion_id, name AS promotion_name, discount_strategy FROM matched""",
    ),
    "promo_region_multipliers": _with(MULTIPLIERS, "SELECT * FROM multipliers"),
    "promo_discounts": _q("SELECT code, 'percentage_off' AS type, CAST(split_part(code, '#', 2) AS DOUBLE) AS percent FROM s_promotions"),
    "stale_carts": _q(f"SELECT * FROM s_carts WHERE updated_at < {NOW} - to_minutes(120)"),
    "stale_carts_kept": _q(f"SELECT * FROM s_carts WHERE updated_at >= {NOW} - to_minutes(120)"),
    "checkout_cart_items_left": """SELECT l_orderkey AS cart_id, l_partkey AS menu_item_id, CAST(l_quantity AS INTEGER) AS quantity
FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey
  WHERE p_size <= 40)""",
    "stale_cart_items_kept": """SELECT l_orderkey AS cart_id, l_partkey AS menu_item_id, CAST(l_quantity AS INTEGER) AS quantity
FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderkey % 240 > 120)""",
    "auto_close": _q(
        f"""SELECT id, user_id, subject, CASE WHEN due THEN 'closed' ELSE status END AS status, created_at,
  CASE WHEN due THEN {NOW} ELSE updated_at END AS updated_at
FROM (SELECT *, status = 'resolved' AND updated_at < {NOW} - to_hours(24) AS due FROM s_cases)"""
    ),
    "orders_by_local_time": LOCAL_TIME,
    "users_by_email_end": _q("SELECT id AS user_id, email FROM s_users WHERE email LIKE '%7'"),
    "order_transition_audit": _with(AUDIT_CTE, 'SELECT id, lsn AS "_lsn", previous_status, status, verdict FROM audit'),
    "order_transition_summary": _with(
        AUDIT_CTE, "SELECT previous_status, status, verdict, count(*) AS steps FROM audit GROUP BY ALL"
    ),
    "recent_runs": _with(NEWEST_RUNS, f"SELECT id, status, started_at, k AS signups, {_NO_COUNTERS} FROM newest_runs"),
    "run_health": _with(
        NEWEST_RUNS,
        """SELECT first(id ORDER BY started_at DESC, id DESC) AS id, first(status ORDER BY started_at DESC, id DESC) AS status,
  count(*) AS runs, count(*) FILTER (status = 'running') AS running, bool_or(status = 'running') AS has_running FROM newest_runs""",
    ),
    "active_config": """SELECT p_partkey AS id, p_partkey * 2 + 1 AS version, CAST(p_size AS DOUBLE) AS signups_per_tick
FROM part WHERE p_partkey % 3 = 0 ORDER BY p_partkey DESC LIMIT 1""",
    "status_domain_split": _q(
        """SELECT reject_reason, count(*) AS rows FROM (
  SELECT concat_ws(',', CASE WHEN lsn % 9 = 0 THEN 'status' END, CASE WHEN id % 10 = 3 THEN 'id' END) AS reject_reason FROM s_steps)
GROUP BY ALL"""
    ),
    "snapshot_key_violations": """SELECT l_orderkey * 10 + l_linenumber AS id, count(*) AS row_count FROM lineitem
GROUP BY ALL HAVING count(*) > 1""",
}
