"""The stand-in tables of ``stand_ins`` as DuckDB views, for the side-by-side checks."""

VIEWS = {
    "posts": """posts AS (
        SELECT doc_id, 'doc-' || doc_id AS obs_id, lang AS ip_slug, source AS account_id,
               CASE WHEN doc_id % 10 = 0 THEN 'canon-' || (doc_id // 20) END AS canonical_content_id,
               doc_id % 3 <> 0 AS is_official, TIMESTAMP '2024-01-01' + to_minutes((doc_id * 37) % 43200) AS published_at,
               sha256(text) AS content_hash, text, n_chars,
               lower(regexp_replace(text, '[^0-9A-Za-z㐀-鿿]+', '', 'g')) AS folded
        FROM documents)""",
    "page_posts": """page_posts AS (
        SELECT page_id, 'page-' || page_id AS obs_id, regexp_extract(url, '^https?://([^/]+)', 1) AS account_id,
               TIMESTAMP '2024-01-01' + to_minutes(page_id) AS published_at, sha256(html) AS content_hash,
               regexp_extract(html, '<title>([^<]*)</title>', 1) AS text, html, url,
               sha256(regexp_extract(url, '([^./]+\\.[^./]+)/', 1)) AS media
        FROM pages)""",
    "campaigns": """campaigns AS (
        SELECT 'camp-' || c_custkey AS campaign_id, 'ip-' || c_nationkey AS ip_slug, 'NATION_' || c_nationkey AS ip_name,
               CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment END AS partner, c_name AS title,
               CASE WHEN c_custkey % 11 = 0 THEN 'cancelled' WHEN c_custkey % 13 = 0 THEN 'ended' ELSE 'announced' END AS status,
               TIMESTAMP '1994-01-01' + to_days(((c_custkey * 7919) % 1000)::INT) AS first_seen_at,
               TIMESTAMP '1994-01-31' + to_days(((c_custkey * 7919) % 1000)::INT) AS updated_at,
               CASE WHEN c_custkey % 17 = 0 AND c_custkey > 0 THEN 'camp-' || (c_custkey // 17) END AS redirected_to,
               c_custkey AS custkey
        FROM customer)""",
    "activities": """activities AS (
        SELECT 'act-' || o_orderkey AS activity_id, 'camp-' || o_custkey AS campaign_id,
               (['product','food','popup','exhibition','online'])[(o_orderkey % 5 + 1)::INT] AS kind,
               'Order ' || o_orderpriority || ' ' || (o_orderkey % 4) AS title,
               CASE WHEN o_orderstatus = 'F' THEN 'ended' WHEN o_orderkey % 29 = 0 THEN 'cancelled' ELSE 'upcoming' END AS status,
               CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate + to_hours(o_orderkey % 24) END AS start_at,
               CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate + to_hours(o_orderkey % 24) + INTERVAL 20 DAY END AS end_at,
               CASE WHEN o_orderkey % 3 = 1 THEN o_orderdate::DATE END AS start_date,
               CASE WHEN o_orderkey % 3 = 1 THEN o_orderdate::DATE + 30 END AS end_date,
               CASE WHEN o_orderkey % 4 = 0 THEN o_orderpriority END AS rules, o_orderkey % 50 = 7 AS excluded, o_orderkey AS orderkey
        FROM orders)""",
    "actions": """actions AS (
        SELECT 'actn-' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS action_id,
               'act-' || l_orderkey AS activity_id,
               CASE l_returnflag || l_linestatus WHEN 'AO' THEN 'sale_open' WHEN 'AF' THEN 'gift' WHEN 'RO' THEN 'reservation_open'
                    WHEN 'NO' THEN 'event_start' WHEN 'NF' THEN 'sale_close' WHEN 'RF' THEN 'announcement' END AS kind,
               'Part ' || l_partkey AS title,
               CASE WHEN l_linenumber % 2 = 0 THEN l_shipdate + to_hours(l_suppkey % 24) END AS at_,
               CASE WHEN l_linenumber % 2 = 0 AND l_quantity > 40 THEN l_shipdate + to_hours(l_suppkey % 24) + INTERVAL 5 DAY END AS end_at,
               CASE WHEN l_linenumber % 2 <> 0 THEN l_shipdate::DATE END AS start_date,
               CASE WHEN l_linenumber % 2 <> 0 AND l_quantity > 40 THEN l_shipdate::DATE + 5 END AS end_date,
               CASE WHEN l_tax > 0.06 THEN 'tax ' || l_tax END AS rules,
               CASE WHEN l_discount > 0.08 THEN 'limit ' || l_quantity::INT END AS quantity_limit,
               l_discount = 0 AS cancelled, l_tax = 0 AS ended,
               CASE WHEN l_linenumber = 1 THEN true END AS requires_reservation,
               CASE WHEN l_linenumber = 2 THEN false END AS requires_rush, l_orderkey, l_suppkey
        FROM lineitem)""",
    "venues": """venues AS (
        SELECT 'ven-' || l_orderkey || '-' || l_suppkey AS venue_id, 'act-' || l_orderkey AS activity_id, s_name AS name,
               'CITY_' || s_nationkey AS city, CASE WHEN s_suppkey % 19 = 0 THEN 'webshop' END AS online_platform,
               s_suppkey % 23 = 0 AS nationwide
        FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) JOIN supplier ON l_suppkey = s_suppkey)""",
    "feed": """feed AS (
        SELECT 'website' AS kind, 'acc-' || (user_id % 50) AS account_id, lpad(event_id::VARCHAR, 12, '0') AS post_id,
               ts AS published_at, event_type, value FROM events)""",
    "proposals": """proposals AS (
        SELECT 'camp-' || user_id AS campaign_id, event_type AS field_path, floor(value)::BIGINT::VARCHAR AS value,
               date_trunc('day', ts) AS published_at, event_id FROM events)""",
    "receipts": """receipts AS (
        SELECT 'r-' || lpad(event_id::VARCHAR, 12, '0') AS job_id, 'camp-' || user_id AS campaign_id, event_type AS label,
               printf('%.2f', value) AS value, ts AS sent_at, (ts + INTERVAL 8 HOUR)::DATE AS delivery_day FROM events)""",
    # dated points, from activities and actions
    "points": """usable AS (
        SELECT * FROM actions WHERE NOT cancelled AND NOT ended AND kind <> 'announcement'),
      own_points AS (
        SELECT activity_id, action_id, kind, title, coalesce(at_, start_date::TIMESTAMP - INTERVAL 8 HOUR) AS at_, start_date FROM usable
        UNION ALL
        SELECT activity_id, action_id || '--end', CASE kind WHEN 'reservation_open' THEN 'reservation_close' WHEN 'sale_open' THEN 'sale_close'
               ELSE 'event_end' END, title || '截止', coalesce(end_at, end_date::TIMESTAMP - INTERVAL 8 HOUR), end_date FROM usable),
      side_points AS (
        SELECT activity_id, activity_id || '--start' AS action_id, 'event_start' AS kind, title || '开始' AS title,
               coalesce(start_at, start_date::TIMESTAMP - INTERVAL 8 HOUR) AS at_, start_date FROM activities
        UNION ALL
        SELECT activity_id, activity_id || '--end', 'event_end', title || '结束', coalesce(end_at, end_date::TIMESTAMP - INTERVAL 8 HOUR), end_date FROM activities),
      marked AS (SELECT *, kind IN ('reservation_close','sale_close','event_end') AS is_deadline FROM own_points WHERE at_ IS NOT NULL),
      points AS (
        SELECT * FROM marked
        UNION ALL
        SELECT s.*, s.kind = 'event_end' FROM side_points s WHERE s.at_ IS NOT NULL AND NOT EXISTS (
          SELECT 1 FROM marked m WHERE m.activity_id = s.activity_id AND m.at_ = s.at_ AND m.is_deadline = (s.kind = 'event_end')))""",
    "owners": """owners AS (
        SELECT a.activity_id, a.campaign_id FROM activities a JOIN campaigns c USING (campaign_id)
        WHERE a.status NOT IN ('ended','cancelled') AND c.status NOT IN ('ended','cancelled'))""",
    "jobs": """jobs AS (
        SELECT 'job-' || sha256(semantic_key)[1:20] AS job_id, * FROM (
          SELECT campaign_id, activity_id, action_id, CASE WHEN is_deadline THEN 'deadline' ELSE 'day_before' END AS kind,
                 (at_ + INTERVAL 8 HOUR)::DATE - 1 AS due_date, at_ AS expected_at, start_date AS expected_date,
                 'schedule:' || activity_id || ':' || action_id || ':' || CASE WHEN is_deadline THEN 'deadline' ELSE 'day_before' END || ':' ||
                   strftime(at_ + INTERVAL 8 HOUR, '%Y-%m-%dT%H:%M:%S+08:00') AS semantic_key,
                 CASE WHEN kind = 'event_start' THEN '明天开始：' WHEN kind = 'sale_open' THEN '明天开售：' WHEN kind = 'reservation_open' THEN '明天开放预约：'
                      WHEN is_deadline THEN '明天截止：' ELSE '明天需要关注：' END || title AS summary
          FROM points JOIN owners USING (activity_id)
          WHERE CASE WHEN start_date IS NOT NULL THEN start_date >= DATE '1998-06-01' ELSE at_ > TIMESTAMP '1998-06-01' END))""",
}


def sql(*names: str, body: str, recursive: bool = False) -> str:
    """A statement over the named views. ``body`` may start with further views, each followed by a comma or SELECT."""
    head = "WITH RECURSIVE " if recursive else "WITH "
    views = ",\n".join(VIEWS[n] for n in names)
    body = body.strip()
    if not names:
        return (head + body) if recursive or not body.upper().startswith(("SELECT", "WITH")) else body
    joiner = "\n" if body.upper().startswith("SELECT") else ",\n"
    return head + views + joiner + body
