"""DuckDB text for the oracle: the five tables as CTEs over the driver tables and the
ownership of notes from one row of facts per note (FILTER aggregates, EXISTS)."""

from __future__ import annotations

import datetime as dt

from presswork.params import Settings


def lit(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, dt.date):
        return f"DATE '{value.isoformat()}'"
    if isinstance(value, (int, float)):
        return repr(value)
    return "'" + str(value).replace("'", "''") + "'"


def views_sql(settings: Settings = Settings()) -> str:
    agency = lit(settings.agency_editor)
    return f"""
editorial_activity AS (
 SELECT note_id,
  CASE WHEN note_id % 11 = 0 THEN NULL ELSE concat('/n/', CAST(note_id AS VARCHAR)) END AS story_url,
  CASE WHEN user_id % 50 = 7 THEN {agency} WHEN user_id % 50 = 9 THEN '' ELSE concat('customer#', lpad(CAST(user_id AS VARCHAR), 9, '0')) END AS email_editor,
  CASE event_type WHEN 'signup' THEN 'CREATE' WHEN 'click' THEN 'SAVE' WHEN 'purchase' THEN 'FIRST_PUBLISH' ELSE 'UPDATE' END AS action_type,
  ts AS event_timestamp,
  CASE WHEN note_id % 17 = 0 THEN NULL WHEN note_id % 13 = 0 THEN '' ELSE concat('section_', CAST(note_id % 7 AS VARCHAR)) END AS segment,
  CASE note_id % 4 WHEN 0 THEN 'Editor-one v2' WHEN 1 THEN 'editor-two-bot' WHEN 2 THEN 'wire' ELSE NULL END AS source,
  concat('Title ', CAST(note_id AS VARCHAR)) AS title, CAST(3 + note_id % 12 AS BIGINT) AS title_word_count, CAST(100 + note_id % 900 AS BIGINT) AS body_word_count
 FROM (SELECT CAST(FLOOR(event_id / 4) AS BIGINT) AS note_id, user_id, event_type, ts FROM events) e
 WHERE note_id IS NOT NULL
),
li_x AS (
 SELECT CAST(FLOOR(l_orderkey / 6) AS BIGINT) AS note_id, make_date(2024, 1, CAST(day(l_shipdate) AS INT)) AS date, l_linenumber,
  CAST(l_quantity AS BIGINT) AS q, CAST(ROUND(l_discount * 100) AS BIGINT) AS d, CAST(FLOOR(l_extendedprice / 10) AS BIGINT) AS t
 FROM lineitem
),
traffic_daily AS (
 SELECT date, concat('/n/', CAST(note_id AS VARCHAR)) AS article_url,
  make_date(2024, 1, CAST(1 + note_id % 28 AS INT)) AS publish_date,
  concat('Title ', CAST(note_id AS VARCHAR)) AS article_title,
  CASE WHEN note_id % 17 = 0 THEN NULL WHEN note_id % 13 = 0 THEN '' ELSE concat('section_', CAST(note_id % 7 AS VARCHAR)) END AS section,
  concat('customer#', lpad(CAST(note_id % 15 AS VARCHAR), 9, '0')) AS creator_email,
  CASE note_id % 4 WHEN 0 THEN 'Editor-one v2' WHEN 1 THEN 'editor-two-bot' WHEN 2 THEN 'wire' ELSE NULL END AS production_source,
  CAST(SUM(q) AS BIGINT) AS visits, CAST(SUM(q + l_linenumber) AS BIGINT) AS pageviews,
  CAST(SUM(LEAST(q, d)) AS BIGINT) AS scrolls, CAST(SUM(t) AS BIGINT) AS total_time_seconds
 FROM li_x GROUP BY date, note_id
),
traffic_clean AS (
 SELECT date AS event_date, concat('/n/', CAST(note_id AS VARCHAR)) AS article_url,
  CAST(SUM(q) AS BIGINT) AS daily_sessions, CAST(SUM(q + l_linenumber) AS BIGINT) AS daily_pageviews,
  CAST(SUM(CASE WHEN q > 1 THEN q - 1 ELSE q END) AS BIGINT) AS daily_users,
  CAST(SUM(LEAST(q, d)) AS BIGINT) AS sessions_with_scroll, CAST(SUM(t) AS BIGINT) AS total_engagement_seconds
 FROM li_x GROUP BY date, note_id
),
traffic_dimensions AS (
 SELECT make_date(2024, 1, CAST(day(l.l_shipdate) AS INT)) AS event_date,
  concat('/n/', CAST(CAST(FLOOR(l.l_orderkey / 6) AS BIGINT) AS VARCHAR)) AS article_url,
  CASE l.l_returnflag WHEN 'A' THEN 'geo' WHEN 'N' THEN 'source' ELSE 'device' END AS dimension_type,
  CASE l.l_returnflag WHEN 'A' THEN n.n_name WHEN 'N' THEN concat('src_', CAST(l.l_partkey % 20 AS VARCHAR)) ELSE concat('dev_', CAST(l.l_linenumber % 3 AS VARCHAR)) END AS dimension_value,
  CAST(l.l_quantity AS BIGINT) - 1 AS visits
 FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation n ON s.s_nationkey = n.n_nationkey
),
authors AS (
 SELECT c.c_name AS email, concat('Author ', CAST(c.c_custkey AS VARCHAR)) AS complete_name,
  CASE WHEN c.c_custkey % 10 = 5 THEN NULL ELSE r.r_name END AS country
 FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
 WHERE c.c_custkey % 10 <> 3
)"""


def in_period(col: str, start, end) -> str:
    return f"CAST({col} AS DATE) BETWEEN {lit(start)} AND {lit(end)}"


def _first_save(condition: str) -> str:
    """The earliest SAVE of a note under a condition; missing values order last."""
    keys = ("event_timestamp", "email_editor", "story_url")
    fields = ", ".join(f"'no_{k}': {k} IS NULL, '{k}': {k}" for k in keys)
    return f"min({{{fields}}}) FILTER (WHERE action_type = 'SAVE' AND {condition})"


def ownership_sql(author: str | None, start, end, px: str = "") -> str:
    """Ownership for one author and period from one row of facts per note: who did what, and which save came first."""
    a, per = lit(author), in_period("event_timestamp", start, end)
    mine = f"email_editor = {a} AND {per}"
    saved_first = f"NOT has_create AND first_save.email_editor = {a}"
    owned = f"created OR published_by_author OR ({saved_first})"

    def pairs(save: str, keep: str) -> str:
        return (f"SELECT note_id, story_url FROM {px}url_facts WHERE mine AND {keep} UNION "
                f"SELECT note_id, {save}.story_url FROM {px}note_facts WHERE NOT has_create AND {save}.email_editor = {a}")

    def published(of: str) -> str:
        return f"EXISTS (SELECT 1 FROM {px}note_facts f WHERE f.note_id = {of}.note_id AND f.published)"

    return f"""
{px}note_facts AS (
 SELECT note_id, bool_or(action_type = 'CREATE') AS has_create,
  coalesce(bool_or(action_type = 'FIRST_PUBLISH' AND {per}), false) AS published,
  coalesce(bool_or(action_type = 'CREATE' AND {mine}), false) AS created,
  coalesce(bool_or(action_type = 'FIRST_PUBLISH' AND {mine}), false) AS published_by_author,
  {_first_save(per)} AS first_save, {_first_save(per + " AND story_url IS NOT NULL")} AS first_url_save,
  {_first_save("true")} AS first_save_ever
 FROM editorial_activity GROUP BY note_id),
{px}url_facts AS (
 SELECT note_id, story_url, coalesce(bool_or(action_type IN ('CREATE', 'FIRST_PUBLISH') AND {mine}), false) AS mine
 FROM editorial_activity GROUP BY note_id, story_url),
{px}o_with_create AS (SELECT note_id FROM {px}note_facts WHERE has_create),
{px}o_published AS (SELECT note_id FROM {px}note_facts WHERE published),
{px}o_create AS (SELECT note_id FROM {px}note_facts WHERE created),
{px}o_publish AS (SELECT note_id FROM {px}note_facts WHERE published_by_author),
{px}o_first_saved AS (SELECT note_id FROM {px}note_facts WHERE {saved_first}),
{px}o_author_notes AS (SELECT note_id FROM {px}note_facts WHERE {owned}),
{px}o_author_published AS (SELECT note_id FROM {px}note_facts WHERE published AND ({owned})),
{px}u_author_pairs AS ({pairs("first_url_save", "story_url IS NOT NULL")}),
{px}u_author_urls AS (SELECT DISTINCT story_url FROM {px}u_author_pairs u WHERE {published("u")}),
{px}s_author_pairs AS ({pairs("first_save", "true")}),
{px}s_author_published_pairs AS (SELECT note_id, story_url FROM {px}s_author_pairs s WHERE {published("s")}),
{px}real_creators AS (
 SELECT note_id, email_editor AS creator_email FROM editorial_activity WHERE action_type = 'CREATE' UNION ALL
 SELECT note_id, first_save_ever.email_editor FROM {px}note_facts WHERE NOT has_create AND first_save_ever IS NOT NULL),
{px}o_author_urls_any AS (
 SELECT note_id, story_url FROM {px}url_facts WHERE story_url IS NOT NULL
 AND EXISTS (SELECT 1 FROM {px}o_author_published p WHERE p.note_id = {px}url_facts.note_id))"""


def with_ctes(settings: Settings, author, start, end, *extra: str, previous=None) -> str:
    """WITH prefix: tables, ownership for the period (and for ``previous`` with prefix ``prev_``)."""
    parts = [views_sql(settings), ownership_sql(author, start, end)]
    if previous is not None:
        parts.append(ownership_sql(author, previous[0], previous[1], px="prev_"))
    parts += [x for x in extra if x]
    return "WITH " + ",\n".join(p.strip() for p in parts)
