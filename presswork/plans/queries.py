"""Every registered query: the Spark plan and the DuckDB oracle body.

Oracle bodies refer to the CTEs of :mod:`presswork.plans.sqltext`; ``oracle()``
adds the WITH prefix. All queries read the whole tables; limits appear only
where the operator is a top-k report.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import functions as F

from presswork.operators import kpis as K
from presswork.operators import ownership as O
from presswork.params import Filters
from presswork.plans.catalog import QueryParams, register
from presswork.plans.sqltext import lit, with_ctes


# ---------------------------------------------------------------- SQL helpers
def per(p: QueryParams, col: str, period=None) -> str:
    pr = period or p.period
    return f"CAST({col} AS DATE) BETWEEN {lit(pr.start)} AND {lit(pr.end)}"


def isum(x: str) -> str:
    return f"CAST(SUM({x}) AS BIGINT)"


def sdiv(a: str, b: str) -> str:
    return f"(CAST({a} AS DOUBLE) / NULLIF(CAST({b} AS DOUBLE), 0))"


def author_join(email_col: str, country: str | None, alias: str = "a") -> str:
    if country is None:
        return ""
    return f"LEFT JOIN authors {alias} ON LOWER({email_col}) = LOWER({alias}.email)"


def sec_cty(section_col: str, section, country, alias: str = "a") -> str:
    out = ""
    if section is not None:
        out += f" AND {section_col} = {lit(section)}"
    if country is not None:
        out += f" AND UPPER({alias}.country) = UPPER({lit(country)})"
    return out


def oracle(p: QueryParams, body: str, *extra_ctes: str, previous=None) -> str:
    prev = (previous.start, previous.end) if previous is not None else None
    return with_ctes(p.settings, p.author, p.period.start, p.period.end, *extra_ctes, previous=prev) + "\n" + body


def _sqlq(body_fn):
    """Wrap a body builder ``(p) -> str`` into a full oracle ``(p) -> str``."""
    return lambda p: oracle(p, body_fn(p))


# ---------------------------------------------------------------- O1-O12
@register("notes_created_by", _sqlq(lambda p: "SELECT note_id FROM o_create"))
def _o1(t, p):
    return O.notes_created_by(t.editorial, p.period, p.author)


@register("notes_published_by", _sqlq(lambda p: "SELECT note_id FROM o_publish"))
def _o2(t, p):
    return O.notes_published_by(t.editorial, p.period, p.author)


@register("first_saves_in_period", _sqlq(lambda p: "SELECT note_id, first_save.email_editor AS email_editor FROM note_facts WHERE first_save IS NOT NULL"))
def _o3(t, p):
    return O.first_saves_in_period(t.editorial, p.period)


@register("first_saves_in_period_with_url",
          _sqlq(lambda p: "SELECT note_id, first_url_save.email_editor AS email_editor, "
                          "first_url_save.story_url AS story_url FROM note_facts WHERE first_url_save IS NOT NULL"))
def _o3u(t, p):
    return O.first_saves_in_period(t.editorial, p.period, require_url=True)


@register("notes_with_create", _sqlq(lambda p: "SELECT note_id FROM o_with_create"))
def _o4(t, p):
    return O.notes_with_create(t.editorial)


@register("notes_first_saved_by", _sqlq(lambda p: "SELECT note_id FROM o_first_saved"))
def _o5(t, p):
    return O.notes_first_saved_by(t.editorial, p.period, p.author)


@register("author_notes", _sqlq(lambda p: "SELECT note_id FROM o_author_notes"))
def _o6(t, p):
    return O.author_notes(t.editorial, p.period, p.author)


@register("author_note_urls", _sqlq(lambda p: "SELECT note_id, story_url FROM u_author_pairs"))
def _o7(t, p):
    return O.author_note_urls(t.editorial, p.period, p.author)


@register("author_note_urls_with_null", _sqlq(lambda p: "SELECT note_id, story_url FROM s_author_pairs"))
def _o7s(t, p):
    return O.author_note_urls(t.editorial, p.period, p.author, require_url=False)


@register("notes_published_in_period", _sqlq(lambda p: "SELECT note_id FROM o_published"))
def _o8(t, p):
    return O.notes_published_in_period(t.editorial, p.period)


@register("author_published_notes", _sqlq(lambda p: "SELECT note_id FROM o_author_published"))
def _o9(t, p):
    return O.author_published_notes(t.editorial, p.period, p.author)


@register("author_published_urls", _sqlq(lambda p: "SELECT story_url FROM u_author_urls"))
def _o10(t, p):
    return O.author_published_urls(t.editorial, p.period, p.author)


@register("real_creators", _sqlq(lambda p: "SELECT note_id, creator_email FROM real_creators"))
def _o11(t, p):
    return O.real_creators(t.editorial)


@register("urls_of_author_notes", _sqlq(lambda p: "SELECT note_id, story_url FROM o_author_urls_any"))
def _o12(t, p):
    return O.urls_of_author_notes(t.editorial, p.period, p.author)


# ---------------------------------------------------------------- B1-B12
def _b_count(p, expr, alias, action, section, country, period=None):
    return (f"SELECT COUNT(DISTINCT {expr}) AS {alias} FROM editorial_activity e {author_join('e.email_editor', country)} "
            f"WHERE e.action_type = '{action}' AND {per(p, 'e.event_timestamp', period)}"
            f"{sec_cty('e.segment', section, country)}")


def b1_sql(p, section=None, country=None, period=None):
    return _b_count(p, "e.email_editor", "active_creators", "CREATE", section, country, period)


def b2_sql(p, section=None, country=None, period=None):
    return _b_count(p, "e.email_editor", "active_publishers", "FIRST_PUBLISH", section, country, period)


def b3_sql(p, section=None, country=None, period=None):
    return _b_count(p, "e.note_id", "published_notes", "FIRST_PUBLISH", section, country, period)


def b4_sql(p, px="", period=None):
    return (
        f"SELECT (SELECT COUNT(*) FROM (SELECT DISTINCT cr.creator_email FROM {px}real_creators cr "
        f"WHERE cr.note_id IN (SELECT note_id FROM {px}o_author_notes)) x) AS total_creators, "
        f"(SELECT COUNT(*) FROM (SELECT DISTINCT e.email_editor FROM editorial_activity e WHERE e.action_type = 'FIRST_PUBLISH' "
        f"AND {per(p, 'e.event_timestamp', period)} AND e.note_id IN (SELECT note_id FROM {px}o_author_notes)) y) AS total_publishers"
    )


def b5_sql(p, section=None, country=None, px=""):
    return (
        f"SELECT COUNT(DISTINCT t.note_id) AS published_notes FROM {px}o_author_notes t "
        f"JOIN {px}o_published pp ON t.note_id = pp.note_id "
        f"JOIN editorial_activity e ON t.note_id = e.note_id AND e.action_type = 'FIRST_PUBLISH' "
        f"{author_join('e.email_editor', country)} WHERE 1 = 1{sec_cty('e.segment', section, country)}"
    )


TRAFFIC_SUMS = (
    f"{isum('g.visits')} AS total_visits, {isum('g.pageviews')} AS total_pageviews, "
    f"{sdiv('SUM(g.total_time_seconds)', 'SUM(g.visits)')} AS avg_time_seconds, "
    f"{sdiv('SUM(g.scrolls)', 'SUM(g.visits)')} AS scroll_rate, {isum('g.scrolls')} AS total_scrolls"
)


def b6_sql(p, section=None, country=None, period=None):
    return (f"SELECT {TRAFFIC_SUMS} FROM traffic_daily g {author_join('g.creator_email', country)} "
            f"WHERE {per(p, 'g.date', period)} AND {per(p, 'g.publish_date', period)}{sec_cty('g.section', section, country)}")


def b7_sql(p, section=None, country=None, px="", period=None):
    return (f"SELECT {TRAFFIC_SUMS} FROM traffic_daily g {author_join('g.creator_email', country)} "
            f"WHERE {per(p, 'g.date', period)} AND g.article_url IN (SELECT story_url FROM {px}u_author_urls)"
            f"{sec_cty('g.section', section, country)}")


def b8_sql(p, section=None, country=None, period=None):
    return (f"SELECT {isum('s.daily_users')} AS daily_user_sum FROM traffic_clean s "
            f"JOIN traffic_daily g ON s.article_url = g.article_url AND s.event_date = g.date "
            f"{author_join('g.creator_email', country)} WHERE {per(p, 's.event_date', period)} "
            f"AND {per(p, 'g.publish_date', period)}{sec_cty('g.section', section, country)}")


def b9_sql(p, px="", period=None):
    return (f"SELECT {isum('s.daily_users')} AS daily_user_sum FROM traffic_clean s WHERE {per(p, 's.event_date', period)} "
            f"AND s.article_url IN (SELECT story_url FROM {px}u_author_urls)")


def b10_sql(p, author=False, section=None, country=None, px="", period=None):
    if author:
        prod = (f"(SELECT total_creators AS active_creators, total_publishers AS active_publishers FROM ({b4_sql(p, px, period)}) q4) pc, "
                f"({b5_sql(p, section, country, px)}) pn")
        traffic = f"({b7_sql(p, section, country, px, period)}) tr, ({b9_sql(p, px, period)}) us"
    else:
        prod = (f"({b1_sql(p, section, country, period)}) c1, ({b2_sql(p, section, country, period)}) c2, "
                f"({b3_sql(p, section, country, period)}) pn")
        traffic = f"({b6_sql(p, section, country, period)}) tr, ({b8_sql(p, section, country, period)}) us"
    return (
        "SELECT COALESCE(active_creators, 0) AS active_creators, COALESCE(active_publishers, 0) AS active_publishers, "
        "COALESCE(published_notes, 0) AS published_notes, COALESCE(total_visits, 0) AS total_visits, "
        "COALESCE(daily_user_sum, 0) AS daily_user_sum, COALESCE(total_pageviews, 0) AS total_pageviews, "
        "COALESCE(avg_time_seconds, 0.0) / CAST(60 AS DOUBLE) AS avg_time_minutes, COALESCE(scroll_rate, 0.0) AS scroll_rate, "
        "COALESCE(total_scrolls, 0) AS total_scrolls, "
        "CAST(COALESCE(total_visits, 0) AS DOUBLE) / CAST(GREATEST(COALESCE(published_notes, 0), 1) AS DOUBLE) AS visits_per_note "
        f"FROM {prod}, {traffic}"
    )


def b12_sql(p, author=False, section=None, country=None):
    prev = p.period.previous()
    cur = b10_sql(p, author, section, country)
    old = b10_sql(p, author, section, country, px="prev_", period=prev)
    rows = " UNION ALL ".join(
        f"SELECT '{k}' AS kpi, CAST(cur.{k} AS DOUBLE) AS current_value, CAST(old.{k} AS DOUBLE) AS previous_value FROM cur, old"
        for k in K.KPI_COLUMNS
    )
    body = (
        f", cur AS ({cur}), old AS ({old}) "
        "SELECT kpi, current_value, previous_value, "
        "CASE WHEN previous_value IS NULL OR previous_value = 0 THEN 0.0 "
        "ELSE (current_value - previous_value) / previous_value * CAST(100 AS DOUBLE) END AS change_pct, "
        "CASE WHEN previous_value IS NULL OR previous_value = 0 THEN 'neutral' "
        "WHEN (current_value - previous_value) / previous_value * CAST(100 AS DOUBLE) >= 0 THEN 'positive' ELSE 'negative' END AS direction "
        f"FROM ({rows}) k"
    )
    return oracle(p, body, previous=prev).replace("\n, cur AS", ",\ncur AS")


@register("active_creators", _sqlq(lambda p: b1_sql(p)))
def _b1(t, p):
    return K.active_creators(t, p.period, p.filters(), p.settings)


@register("active_creators_filtered", _sqlq(lambda p: b1_sql(p, p.section, p.country)))
def _b1f(t, p):
    return K.active_creators(t, p.period, p.filters(section=True, country=True), p.settings)


@register("active_publishers", _sqlq(lambda p: b2_sql(p)))
def _b2(t, p):
    return K.active_publishers(t, p.period, p.filters(), p.settings)


@register("active_publishers_filtered", _sqlq(lambda p: b2_sql(p, p.section, p.country)))
def _b2f(t, p):
    return K.active_publishers(t, p.period, p.filters(section=True, country=True), p.settings)


@register("published_notes", _sqlq(lambda p: b3_sql(p)))
def _b3(t, p):
    return K.published_notes(t, p.period, p.filters(), p.settings)


@register("published_notes_filtered", _sqlq(lambda p: b3_sql(p, p.section, p.country)))
def _b3f(t, p):
    return K.published_notes(t, p.period, p.filters(section=True, country=True), p.settings)


@register("author_creator_publisher_counts", _sqlq(lambda p: b4_sql(p)))
def _b4(t, p):
    return K.author_creator_publisher_counts(t, p.period, p.filters(author=True), p.settings)


@register("author_published_note_count", _sqlq(lambda p: b5_sql(p)))
def _b5(t, p):
    return K.author_published_note_count(t, p.period, p.filters(author=True), p.settings)


@register("author_published_note_count_filtered", _sqlq(lambda p: b5_sql(p, p.section, p.country)))
def _b5f(t, p):
    return K.author_published_note_count(t, p.period, p.filters(True, True, True), p.settings)


@register("traffic_totals", _sqlq(lambda p: b6_sql(p)))
def _b6(t, p):
    return K.traffic_totals(t, p.period, p.filters(), p.settings)


@register("traffic_totals_filtered", _sqlq(lambda p: b6_sql(p, p.section, p.country)))
def _b6f(t, p):
    return K.traffic_totals(t, p.period, p.filters(section=True, country=True), p.settings)


@register("author_traffic_totals", _sqlq(lambda p: b7_sql(p)))
def _b7(t, p):
    return K.author_traffic_totals(t, p.period, p.filters(author=True), p.settings)


@register("author_traffic_totals_filtered", _sqlq(lambda p: b7_sql(p, p.section, p.country)))
def _b7f(t, p):
    return K.author_traffic_totals(t, p.period, p.filters(True, True, True), p.settings)


@register("daily_user_sum", _sqlq(lambda p: b8_sql(p)))
def _b8(t, p):
    return K.daily_user_sum(t, p.period, p.filters(), p.settings)


@register("daily_user_sum_filtered", _sqlq(lambda p: b8_sql(p, p.section, p.country)))
def _b8f(t, p):
    return K.daily_user_sum(t, p.period, p.filters(section=True, country=True), p.settings)


@register("author_daily_user_sum", _sqlq(lambda p: b9_sql(p)))
def _b9(t, p):
    return K.author_daily_user_sum(t, p.period, p.filters(author=True), p.settings)


@register("kpis", _sqlq(lambda p: b10_sql(p)))
def _b10(t, p):
    return K.kpis(t, p.period, p.filters(), p.settings)


@register("kpis_filtered", _sqlq(lambda p: b10_sql(p, False, p.section, p.country)))
def _b10f(t, p):
    return K.kpis(t, p.period, p.filters(section=True, country=True), p.settings)


@register("author_kpis", _sqlq(lambda p: b10_sql(p, True)))
def _b10a(t, p):
    return K.kpis(t, p.period, p.filters(author=True), p.settings)


@register("kpis_previous_period",
          lambda p: oracle(p, b10_sql(p, period=p.period.previous())))
def _b11(t, p):
    return K.kpis_previous_period(t, p.period, p.filters(), p.settings)


@register("author_kpis_previous_period",
          lambda p: oracle(p, b10_sql(p, True, px="prev_", period=p.period.previous()), previous=p.period.previous()))
def _b11a(t, p):
    return K.kpis_previous_period(t, p.period, p.filters(author=True), p.settings)


@register("kpi_change", lambda p: b12_sql(p))
def _b12(t, p):
    return K.kpi_change_for(t, p.period, p.filters(), p.settings)


@register("author_kpi_change", lambda p: b12_sql(p, True))
def _b12a(t, p):
    return K.kpi_change_for(t, p.period, p.filters(author=True), p.settings)


# ---------------------------------------------------------------- B13-B16
from presswork.operators import rankings as R  # noqa: E402
from presswork.operators import series as S  # noqa: E402


def disp(p: QueryParams, email: str, name: str = "a.complete_name", agency=True) -> str:
    base = f"COALESCE({name}, {email})"
    if not agency:
        return base
    st = p.settings
    return f"CASE WHEN LOWER({email}) = LOWER({lit(st.agency_editor)}) THEN {lit(st.agency_label)} ELSE {base} END"


def present_sql(c: str) -> str:
    return f"{c} IS NOT NULL AND {c} != ''"


def _rank_sql(label, measure, limit):
    return f" GROUP BY 1, 2 ORDER BY {measure} DESC, {label} ASC NULLS FIRST, country ASC NULLS FIRST LIMIT {limit}"


def b13_sql(p, action="FIRST_PUBLISH", label="publisher", measure="published_notes", section=None, country=None):
    return (f"SELECT {disp(p, 'e.email_editor')} AS {label}, a.country AS country, COUNT(*) AS {measure} "
            f"FROM editorial_activity e LEFT JOIN authors a ON LOWER(e.email_editor) = LOWER(a.email) "
            f"WHERE e.action_type = '{action}' AND {per(p, 'e.event_timestamp')} AND {present_sql('e.email_editor')}"
            f"{sec_cty('e.segment', section, country)}" + _rank_sql(label, measure, p.settings.top_k))


def b14_sql(p):
    return (f"SELECT {disp(p, 'e.email_editor')} AS publisher, a.country AS country, COUNT(DISTINCT e.note_id) AS published_notes "
            f"FROM editorial_activity e LEFT JOIN authors a ON LOWER(e.email_editor) = LOWER(a.email) "
            f"WHERE e.action_type = 'FIRST_PUBLISH' AND {per(p, 'e.event_timestamp')} "
            f"AND e.note_id IN (SELECT note_id FROM o_author_notes) AND {present_sql('e.email_editor')}"
            + _rank_sql("publisher", "published_notes", p.settings.top_k))


def b16_sql(p):
    return (f"SELECT {disp(p, 'cr.creator_email')} AS creator, a.country AS country, COUNT(DISTINCT cr.note_id) AS created_notes "
            f"FROM real_creators cr LEFT JOIN authors a ON LOWER(cr.creator_email) = LOWER(a.email) "
            f"WHERE cr.note_id IN (SELECT note_id FROM o_author_notes) AND {present_sql('cr.creator_email')}"
            + _rank_sql("creator", "created_notes", p.settings.top_k))


@register("top_publishers", _sqlq(lambda p: b13_sql(p)))
def _b13(t, p):
    return R.top_publishers(t, p.period, p.filters(), p.settings)


@register("top_publishers_filtered", _sqlq(lambda p: b13_sql(p, section=p.section, country=p.country)))
def _b13f(t, p):
    return R.top_publishers(t, p.period, p.filters(section=True, country=True), p.settings)


@register("author_top_publishers", _sqlq(b14_sql))
def _b14(t, p):
    return R.author_top_publishers(t, p.period, p.filters(author=True), p.settings)


@register("top_creators", _sqlq(lambda p: b13_sql(p, "CREATE", "creator", "created_notes")))
def _b15(t, p):
    return R.top_creators(t, p.period, p.filters(), p.settings)


@register("top_creators_filtered",
          _sqlq(lambda p: b13_sql(p, "CREATE", "creator", "created_notes", p.section, p.country)))
def _b15f(t, p):
    return R.top_creators(t, p.period, p.filters(section=True, country=True), p.settings)


@register("author_top_creators", _sqlq(b16_sql))
def _b16(t, p):
    return R.author_top_creators(t, p.period, p.filters(author=True), p.settings)


# ---------------------------------------------------------------- B17-B22, C1-C2
def b17_sql(p, section=None, country=None):
    return (f"SELECT CAST(e.event_timestamp AS DATE) AS day, COUNT(*) AS value FROM editorial_activity e "
            f"{author_join('e.email_editor', country)} WHERE e.action_type = 'FIRST_PUBLISH' AND {per(p, 'e.event_timestamp')}"
            f"{sec_cty('e.segment', section, country)} GROUP BY 1")


def b18_sql(p, section=None):
    return (f"SELECT CAST(e.event_timestamp AS DATE) AS day, COUNT(DISTINCT e.note_id) AS value FROM editorial_activity e "
            f"WHERE e.action_type = 'FIRST_PUBLISH' AND {per(p, 'e.event_timestamp')} "
            f"AND e.note_id IN (SELECT note_id FROM o_author_notes){sec_cty('e.segment', section, None)} GROUP BY 1")


def b19_sql(p, section=None, country=None):
    return (f"SELECT s.event_date AS day, {isum('s.daily_users')} AS value FROM traffic_clean s "
            f"JOIN traffic_daily g ON s.article_url = g.article_url AND s.event_date = g.date "
            f"{author_join('g.creator_email', country)} WHERE {per(p, 's.event_date')} AND {per(p, 'g.publish_date')}"
            f"{sec_cty('g.section', section, country)} GROUP BY 1")


def b20_sql(p):
    return (f"SELECT s.event_date AS day, {isum('s.daily_users')} AS value FROM traffic_clean s "
            f"WHERE {per(p, 's.event_date')} AND s.article_url IN (SELECT story_url FROM u_author_urls) GROUP BY 1")


def b21_sql(p, metric="visits", section=None, country=None):
    return (f"SELECT g.date AS day, {isum('g.' + metric)} AS value FROM traffic_daily g "
            f"{author_join('g.creator_email', country)} WHERE {per(p, 'g.date')} AND {per(p, 'g.publish_date')}"
            f"{sec_cty('g.section', section, country)} GROUP BY 1")


def b22_sql(p, metric="visits", section=None):
    return (f"SELECT g.date AS day, {isum('g.' + metric)} AS value FROM traffic_daily g "
            f"WHERE {per(p, 'g.date')} AND g.article_url IN (SELECT story_url FROM u_author_urls)"
            f"{sec_cty('g.section', section, None)} GROUP BY 1")


def fit_ctes(p, series_sql):
    """Least squares by DuckDB's own regression aggregates over the days that have a value."""
    x, y = f"CAST(datediff('day', {lit(p.period.start)}, day) AS DOUBLE)", "CAST(value AS DOUBLE)"
    return (f"ser AS ({series_sql}),\n"
            f"coef AS (SELECT COUNT(value) AS points, CASE WHEN COUNT(value) > 1 THEN ROUND(regr_slope({y}, {x}), 6) END AS slope, "
            f"CASE WHEN COUNT(value) > 1 THEN ROUND(regr_intercept({y}, {x}), 6) END AS intercept FROM ser)")


def c1_sql(p, series_sql):
    body = (f"SELECT ser.day, ser.value, ROUND(coef.intercept + coef.slope * CAST(datediff('day', {lit(p.period.start)}, ser.day) AS DOUBLE), 3) "
            f"AS trend FROM ser, coef")
    return oracle(p, body, fit_ctes(p, series_sql))


def c2_sql(p, series_sql):
    body = ("SELECT points, slope, intercept, CASE WHEN slope IS NULL THEN NULL WHEN slope > 0 THEN 'up' ELSE 'down' END "
            "AS direction FROM coef")
    return oracle(p, body, fit_ctes(p, series_sql))


@register("daily_published", _sqlq(lambda p: b17_sql(p)))
def _b17(t, p):
    return S.daily_published(t, p.period, p.filters(), p.settings)


@register("daily_published_filtered", _sqlq(lambda p: b17_sql(p, p.section, p.country)))
def _b17f(t, p):
    return S.daily_published(t, p.period, p.filters(section=True, country=True), p.settings)


@register("author_daily_published", _sqlq(lambda p: b18_sql(p)))
def _b18(t, p):
    return S.author_daily_published(t, p.period, p.filters(author=True), p.settings)


@register("author_daily_published_section", _sqlq(lambda p: b18_sql(p, p.section)))
def _b18s(t, p):
    return S.author_daily_published(t, p.period, p.filters(True, True, True), p.settings)


@register("daily_users", _sqlq(lambda p: b19_sql(p)))
def _b19(t, p):
    return S.daily_users(t, p.period, p.filters(), p.settings)


@register("daily_users_filtered", _sqlq(lambda p: b19_sql(p, p.section, p.country)))
def _b19f(t, p):
    return S.daily_users(t, p.period, p.filters(section=True, country=True), p.settings)


@register("author_daily_users", _sqlq(lambda p: b20_sql(p)))
def _b20(t, p):
    return S.author_daily_users(t, p.period, p.filters(author=True), p.settings)


@register("daily_traffic", _sqlq(lambda p: b21_sql(p)))
def _b21(t, p):
    return S.daily_traffic(t, p.period, p.filters(), p.settings, "visits")


@register("daily_traffic_pageviews", _sqlq(lambda p: b21_sql(p, "pageviews")))
def _b21p(t, p):
    return S.daily_traffic(t, p.period, p.filters(), p.settings, "pageviews")


@register("daily_traffic_scrolls_filtered", _sqlq(lambda p: b21_sql(p, "scrolls", p.section, p.country)))
def _b21f(t, p):
    return S.daily_traffic(t, p.period, p.filters(section=True, country=True), p.settings, "scrolls")


@register("author_daily_traffic", _sqlq(lambda p: b22_sql(p)))
def _b22(t, p):
    return S.author_daily_traffic(t, p.period, p.filters(author=True), p.settings, "visits")


@register("author_daily_traffic_section", _sqlq(lambda p: b22_sql(p, "pageviews", p.section)))
def _b22s(t, p):
    return S.author_daily_traffic(t, p.period, p.filters(True, True, True), p.settings, "pageviews")


@register("trend_line", lambda p: c1_sql(p, b21_sql(p)))
def _c1(t, p):
    return S.trend_line(S.daily_traffic(t, p.period, p.filters(), p.settings), p.period.start)


@register("author_trend_line", lambda p: c1_sql(p, b18_sql(p)))
def _c1a(t, p):
    return S.trend_line(S.author_daily_published(t, p.period, p.filters(author=True), p.settings), p.period.start)


@register("trend_direction", lambda p: c2_sql(p, b21_sql(p)))
def _c2(t, p):
    return S.trend_direction(S.daily_traffic(t, p.period, p.filters(), p.settings), p.period.start)


@register("trend_direction_users", lambda p: c2_sql(p, b19_sql(p)))
def _c2u(t, p):
    return S.trend_direction(S.daily_users(t, p.period, p.filters(), p.settings), p.period.start)


# ---------------------------------------------------------------- B23-B24
from presswork.functions import formatting as FMT  # noqa: E402
from presswork.operators import articles as A  # noqa: E402
from presswork.operators import dimensions as D  # noqa: E402
from presswork.operators import options as OPT  # noqa: E402
from presswork.operators import production as PR  # noqa: E402
from presswork.operators import productivity as PV  # noqa: E402
from presswork.operators import reports as REP  # noqa: E402
from presswork.operators import sections as SEC  # noqa: E402
from presswork.functions.lookups import COUNTRY_CODES, COUNTRY_TRANSLATIONS  # noqa: E402


def _like(p_col: str, pattern: str) -> str:
    return f"LOWER({p_col}) LIKE {lit('%' + pattern.lower() + '%')}"


def _section_final(ed, tr):
    return (f"SELECT e.section, e.notes, e.tool1_notes, e.tool2_notes, COALESCE(t.sessions, 0) AS sessions, "
            f"COALESCE(t.pageviews, 0) AS pageviews, COALESCE(t.scroll_rate, 0.0) AS scroll_rate, "
            f"{sdiv('COALESCE(t.sessions, 0)', 'e.notes')} AS sessions_per_note FROM ({ed}) e LEFT JOIN ({tr}) t ON e.section = t.section")


def _section_ed(p, extra, join=""):
    st = p.settings
    return (f"SELECT ed.segment AS section, COUNT(DISTINCT ed.note_id) AS notes, "
            f"COUNT(DISTINCT CASE WHEN {_like('ed.source', st.tool1_pattern)} THEN ed.note_id END) AS tool1_notes, "
            f"COUNT(DISTINCT CASE WHEN {_like('ed.source', st.tool2_pattern)} THEN ed.note_id END) AS tool2_notes "
            f"FROM editorial_activity ed {join} WHERE ed.action_type = 'FIRST_PUBLISH' AND {per(p, 'ed.event_timestamp')} "
            f"AND {present_sql('ed.segment')}{extra} GROUP BY ed.segment")


def b23_sql(p, section=None, country=None):
    ed = _section_ed(p, sec_cty("ed.segment", section, country, "a1"), author_join("ed.email_editor", country, "a1"))
    tr = (f"SELECT g.section AS section, {isum('g.visits')} AS sessions, {isum('g.pageviews')} AS pageviews, "
          f"{sdiv('SUM(g.scrolls)', 'SUM(g.visits)')} AS scroll_rate FROM traffic_daily g {author_join('g.creator_email', country, 'a2')} "
          f"WHERE {per(p, 'g.date')} AND {per(p, 'g.publish_date')} AND {present_sql('g.section')}"
          f"{sec_cty('g.section', section, country, 'a2')} GROUP BY g.section")
    return _section_final(ed, tr)


def b24_sql(p, section=None):
    own = " AND EXISTS (SELECT 1 FROM s_author_published_pairs o WHERE o.note_id = ed.note_id)" + sec_cty("ed.segment", section, None)
    tr = (f"SELECT section, {isum('daily_sessions')} AS sessions, {isum('daily_pageviews')} AS pageviews, "
          f"{sdiv('SUM(sessions_with_scroll)', 'SUM(daily_sessions)')} AS scroll_rate FROM traffic_clean g JOIN ("
          f"SELECT segment AS section, story_url FROM editorial_activity ed WHERE action_type = 'FIRST_PUBLISH' "
          f"AND {per(p, 'event_timestamp')} AND {present_sql('segment')}{own} GROUP BY ALL) u ON g.article_url = u.story_url "
          f"WHERE {per(p, 'g.event_date')} GROUP BY section")
    return _section_final(_section_ed(p, own), tr)


@register("section_stats", _sqlq(lambda p: b23_sql(p)))
def _b23(t, p):
    return SEC.section_stats(t, p.period, p.filters(), p.settings)


@register("section_stats_filtered", _sqlq(lambda p: b23_sql(p, p.section, p.country)))
def _b23f(t, p):
    return SEC.section_stats(t, p.period, p.filters(section=True, country=True), p.settings)


@register("author_section_stats", _sqlq(lambda p: b24_sql(p)))
def _b24(t, p):
    return SEC.author_section_stats(t, p.period, p.filters(author=True), p.settings)


@register("author_section_stats_section", _sqlq(lambda p: b24_sql(p, p.section)))
def _b24s(t, p):
    return SEC.author_section_stats(t, p.period, p.filters(True, True, True), p.settings)


# ---------------------------------------------------------------- B25-B27, C3-C6
def _dim_tail(p):
    return (" GROUP BY 1, 2 HAVING SUM(g.visits) > 0 ORDER BY total_visits DESC, dimension_type ASC NULLS FIRST, "
            f"dimension_value ASC NULLS FIRST LIMIT {p.settings.dimension_limit}")


DIM_SELECT = ("SELECT g.dimension_type AS dimension_type, g.dimension_value AS dimension_value, "
              f"{isum('g.visits')} AS total_visits, COUNT(DISTINCT g.article_url) AS article_count FROM traffic_dimensions g ")


def b25_sql(p):
    return DIM_SELECT + f"WHERE {per(p, 'g.event_date')}" + _dim_tail(p)


def b26_sql(p, section=None, country=None, author=False):
    extra = " AND e.story_url IN (SELECT story_url FROM u_author_urls)" if author else ""
    urls = (f"SELECT DISTINCT e.story_url FROM editorial_activity e {author_join('e.email_editor', None if author else country)} "
            f"WHERE e.action_type = 'FIRST_PUBLISH' AND {per(p, 'e.event_timestamp')} AND {present_sql('e.story_url')}"
            f"{extra}{sec_cty('e.segment', section, None if author else country)}")
    return DIM_SELECT + f"JOIN ({urls}) u ON g.article_url = u.story_url WHERE {per(p, 'g.event_date')}" + _dim_tail(p)


def values_table(mapping: dict, k="k", v="v") -> str:
    rows = ", ".join(f"({lit(a)}, {lit(b)})" for a, b in mapping.items())
    return f"(VALUES {rows}) AS m({k}, {v})"


@register("traffic_by_dimension", _sqlq(b25_sql))
def _b25(t, p):
    return D.traffic_by_dimension(t, p.period, p.settings)


@register("traffic_by_dimension_filtered", _sqlq(lambda p: b26_sql(p, p.section, p.country)))
def _b26(t, p):
    return D.traffic_by_dimension_filtered(t, p.period, p.filters(section=True, country=True), p.settings)


@register("traffic_by_dimension_country", _sqlq(lambda p: b26_sql(p, None, p.country)))
def _b26c(t, p):
    return D.traffic_by_dimension_filtered(t, p.period, p.filters(country=True), p.settings)


@register("author_traffic_by_dimension", _sqlq(lambda p: b26_sql(p, author=True)))
def _b27(t, p):
    return D.author_traffic_by_dimension(t, p.period, p.filters(author=True), p.settings)


@register("author_traffic_by_dimension_section", _sqlq(lambda p: b26_sql(p, p.section, author=True)))
def _b27s(t, p):
    return D.author_traffic_by_dimension(t, p.period, p.filters(True, True, True), p.settings)


@register("top_values_per_dimension", _sqlq(lambda p: (
    f"SELECT * FROM (SELECT b.*, ROW_NUMBER() OVER (PARTITION BY dimension_type ORDER BY total_visits DESC, "
    f"dimension_value ASC NULLS FIRST) AS rank FROM ({b25_sql(p)}) b) r WHERE rank <= {p.settings.per_dimension_top}")))
def _c3(t, p):
    out = D.top_values_per_dimension(D.traffic_by_dimension(t, p.period, p.settings), p.settings)
    return out.withColumn("rank", out["rank"].cast("bigint"))


@register("dimension_types", _sqlq(lambda p: f"SELECT DISTINCT dimension_type FROM ({b25_sql(p)}) b WHERE dimension_type IS NOT NULL"))
def _c4(t, p):
    return D.dimension_types(D.traffic_by_dimension(t, p.period, p.settings))


@register("translate_values", _sqlq(lambda p: (
    f"SELECT b.dimension_type, CASE WHEN b.dimension_type = 'geo' THEN COALESCE(m.v, b.dimension_value) "
    f"ELSE b.dimension_value END AS dimension_value, b.total_visits, b.article_count "
    f"FROM ({b26_sql(p, p.section, p.country)}) b LEFT JOIN {values_table(COUNTRY_TRANSLATIONS)} ON b.dimension_value = m.k")))
def _c5(t, p):
    return D.translate_values(D.traffic_by_dimension_filtered(t, p.period, p.filters(section=True, country=True), p.settings))


# the checked data number their countries; with the names of the fixed table in that order they have display names
def numbered_country_sql():
    names = "[" + ", ".join(lit(k) for k in COUNTRY_TRANSLATIONS) + "]"
    return (f"CASE WHEN b.dimension_type = 'geo' THEN {names}[CAST(regexp_extract(b.dimension_value, '[0-9]+') AS INTEGER) + 1] "
            f"ELSE b.dimension_value END")


@register("translate_country_names", _sqlq(lambda p: (
    f"SELECT c.dimension_type, COALESCE(m.v, c.name) AS dimension_value, c.total_visits, c.article_count "
    f"FROM (SELECT b.*, {numbered_country_sql()} AS name FROM ({b25_sql(p)}) b) c "
    f"LEFT JOIN {values_table(COUNTRY_TRANSLATIONS)} ON c.dimension_type = 'geo' AND c.name = m.k")))
def _c5n(t, p):
    b = D.traffic_by_dimension(t, p.period, p.settings)
    number = F.regexp_extract("dimension_value", "[0-9]+", 0).cast("int")
    name = F.try_element_at(F.array(*map(F.lit, COUNTRY_TRANSLATIONS)), number + 1)
    return D.translate_values(b.withColumn("dimension_value", F.when(F.col("dimension_type") == "geo", name).otherwise(F.col("dimension_value"))))


@register("country_code", _sqlq(lambda p: (
    f"SELECT b.*, COALESCE(m.v, '') AS country_code FROM ({b13_sql(p)}) b "
    f"LEFT JOIN {values_table(COUNTRY_CODES)} ON UPPER(b.country) = m.k")))
def _c6(t, p):
    return D.with_country_code(R.top_publishers(t, p.period, p.filters(), p.settings))


# ---------------------------------------------------------------- B28-B29
def rr_sql(n, d, digits=2):
    scale = 10 ** digits
    return (f"CASE WHEN {d} <> 0 THEN CAST((CAST({n} AS BIGINT) * {2 * scale} + CAST({d} AS BIGINT)) // "
            f"(CAST({d} AS BIGINT) * 2) AS DOUBLE) / CAST({scale} AS DOUBLE) END")


def tool_label_sql(p, c):
    st = p.settings
    cc = f"COALESCE({c}, '')"
    return (f"CASE WHEN {_like(cc, st.tool2_pattern)} THEN {lit(st.tool2_label)} WHEN {_like(cc, st.tool1_pattern)} "
            f"THEN {lit(st.tool1_label)} ELSE COALESCE({c}, {lit(st.missing_text)}) END")


def _article_cols(p, meta, traffic, pub, coalesce_traffic):
    vis = f"COALESCE({traffic}.visits, 0)" if coalesce_traffic else f"{traffic}.visits"
    pv = f"COALESCE({traffic}.pageviews, 0)" if coalesce_traffic else f"{traffic}.pageviews"
    miss = lit(p.settings.missing_text)
    return (f"{meta}.url AS url, {meta}.title AS title, {meta}.section AS section, "
            f"COALESCE({meta}.creator, {miss}) AS creator, COALESCE({pub}.publisher, {miss}) AS publisher, "
            f"{tool_label_sql(p, meta + '.production_source')} AS source, {vis} AS visits, {pv} AS pageviews, "
            f"COALESCE({rr_sql(traffic + '.scrolls_sum', traffic + '.visits_sum')}, 0.0) AS scroll_rate, "
            f"COALESCE({pub}.title_words, 0) AS title_words, COALESCE({pub}.body_words, 0) AS body_words")


def b28_sql(p, section=None, country=None):
    st = p.settings
    dropped = [f"NOT {_like('title', x)}" for x in st.exclude_title_patterns] + [f"NOT {_like('url', x)}" for x in st.exclude_url_patterns]
    article = ("max(g.article_title) AS title, max(g.section) AS section, max(g.creator_email) AS creator, "
               "max(g.production_source) AS production_source")
    sums = f"{isum('g.visits')} AS visits, {isum('g.pageviews')} AS pageviews, SUM(g.scrolls) AS scrolls_sum, SUM(g.visits) AS visits_sum"
    words = " ".join(
        f"(SELECT max({c}) FROM editorial_activity x WHERE x.story_url = t.url AND x.action_type = 'FIRST_PUBLISH' "
        f"AND {per(p, 'x.event_timestamp')}) AS {n}{sep}" for c, n, sep in (
            ("email_editor", "publisher", ","), ("title_word_count", "title_words", ","), ("body_word_count", "body_words", "")))
    per_url = (f"SELECT g.article_url AS url, {article}, {sums} FROM traffic_daily g {author_join('g.creator_email', country)} "
               f"WHERE {per(p, 'g.date')} AND {per(p, 'g.publish_date')}{sec_cty('g.section', section, country)} GROUP BY url "
               f"HAVING {' AND '.join([present_sql('title'), 'max(g.section) IS NOT NULL', *dropped])}")
    return (f"SELECT {_article_cols(p, 'a', 'a', 'a', False)} FROM (SELECT t.*, {words} FROM ({per_url}) t) a "
            f"ORDER BY a.visits DESC, a.url ASC NULLS FIRST LIMIT {st.article_limit}")


def excluding(p):
    """Parameters whose boilerplate patterns, matched in any case, drop titles and urls of the checked data."""
    return dataclasses.replace(p, settings=dataclasses.replace(
        p.settings, exclude_title_patterns=("TITLE 1", "0"), exclude_url_patterns=("/homepage", "/N/2")))


@register("top_articles_excluded", _sqlq(lambda p: b28_sql(excluding(p))))
def _b28x(t, p):
    return A.top_articles(t, p.period, p.filters(), excluding(p).settings)


def b29_sql(p):
    of_note = " ".join(
        f"(SELECT max({c}) FROM editorial_activity x WHERE x.note_id = u.note_id{more}) AS {n}," for c, n, more in (
            ("title", "title", ""), ("segment", "section", ""), ("source", "production_source", ""),
            ("email_editor", "publisher", " AND x.action_type = 'FIRST_PUBLISH'"), ("title_word_count", "title_words", ""),
            ("body_word_count", "body_words", "")))
    m = (f"SELECT u.note_id, u.story_url AS url, {of_note} "
         f"(SELECT max(creator_email) FROM real_creators c WHERE c.note_id = u.note_id) AS creator FROM o_author_urls_any u")
    t = (f"SELECT article_url AS url, {isum('visits')} AS visits, {isum('pageviews')} AS pageviews, SUM(scrolls) AS scrolls_sum, "
         f"SUM(visits) AS visits_sum FROM traffic_daily WHERE {per(p, 'date')} GROUP BY article_url")
    return (f"SELECT {_article_cols(p, 'm', 't', 'm', True)} FROM ({m}) m LEFT JOIN ({t}) t USING (url) WHERE {present_sql('m.title')} "
            f"ORDER BY COALESCE(t.visits, 0) DESC, m.url ASC NULLS FIRST, m.note_id LIMIT {p.settings.article_limit}")


@register("top_articles", _sqlq(lambda p: b28_sql(p)))
def _b28(t, p):
    return A.top_articles(t, p.period, p.filters(), p.settings)


@register("top_articles_filtered", _sqlq(lambda p: b28_sql(p, p.section, p.country)))
def _b28f(t, p):
    return A.top_articles(t, p.period, p.filters(section=True, country=True), p.settings)


@register("author_top_articles", _sqlq(b29_sql))
def _b29(t, p):
    return A.author_top_articles(t, p.period, p.filters(author=True), p.settings)


# ---------------------------------------------------------------- B36-B37, C8
def tool_class_sql(p, email, source):
    st = p.settings
    cc = f"COALESCE({source}, '')"
    return (f"CASE WHEN LOWER({email}) = LOWER({lit(st.agency_editor)}) THEN {lit(st.agency_class)} "
            f"WHEN {_like(cc, st.tool2_pattern)} THEN {lit(st.tool2_label)} WHEN {_like(cc, st.tool1_pattern)} "
            f"THEN {lit(st.tool1_label)} ELSE {lit(st.other_class)} END")


def b36_sql(p, section=None, country=None, author=False):
    nf = " AND EXISTS (SELECT 1 FROM o_author_published o WHERE o.note_id = e.note_id)" if author else ""
    cty = None if author else country
    n = (f"SELECT e.note_id, e.story_url, {tool_class_sql(p, 'e.email_editor', 'e.source')} AS source_class "
         f"FROM editorial_activity e {author_join('e.email_editor', cty)} WHERE e.action_type = 'FIRST_PUBLISH' "
         f"AND {per(p, 'e.event_timestamp')}{nf}{sec_cty('e.segment', section, cty)}")
    if author:
        tbl, dcol, v, pv, sc, tm = "traffic_clean", "event_date", "daily_sessions", "daily_pageviews", "sessions_with_scroll", "total_engagement_seconds"
    else:
        tbl, dcol, v, pv, sc, tm = "traffic_daily", "date", "visits", "pageviews", "scrolls", "total_time_seconds"
    m = (f"SELECT n.source_class, COUNT(DISTINCT n.note_id) AS notes, {isum('g.' + v)} AS sessions, {isum('g.' + pv)} AS pageviews, "
         f"{sdiv(f'SUM(g.{sc})', f'SUM(g.{v})')} AS scroll_rate, {sdiv(f'SUM(g.{tm})', f'SUM(g.{v})')} / CAST(60 AS DOUBLE) AS avg_time_minutes "
         f"FROM ({n}) n LEFT JOIN {tbl} g ON n.story_url = g.article_url AND {per(p, 'g.' + dcol)} GROUP BY n.source_class")
    return (f"SELECT source_class, notes, COALESCE(sessions, 0) AS sessions, COALESCE(pageviews, 0) AS pageviews, "
            f"{sdiv('COALESCE(sessions, 0)', 'notes')} AS sessions_per_note, COALESCE(scroll_rate, 0.0) AS scroll_rate, "
            f"COALESCE(avg_time_minutes, 0.0) AS avg_time_minutes FROM ({m}) mm WHERE source_class != {lit(p.settings.other_class)}")


@register("source_efficiency", _sqlq(lambda p: b36_sql(p)))
def _b36(t, p):
    return PR.source_efficiency(t, p.period, p.filters(), p.settings)


@register("source_efficiency_filtered", _sqlq(lambda p: b36_sql(p, p.section, p.country)))
def _b36f(t, p):
    return PR.source_efficiency(t, p.period, p.filters(section=True, country=True), p.settings)


@register("author_source_efficiency", _sqlq(lambda p: b36_sql(p, author=True)))
def _b37(t, p):
    return PR.author_source_efficiency(t, p.period, p.filters(author=True), p.settings)


@register("author_source_efficiency_section", _sqlq(lambda p: b36_sql(p, p.section, author=True)))
def _b37s(t, p):
    return PR.author_source_efficiency(t, p.period, p.filters(True, True, True), p.settings)


#: A section of which the author has published notes in the checked data.
OWN_SECTION = "section_4"


@register("author_source_efficiency_own_section", _sqlq(lambda p: b36_sql(p, OWN_SECTION, author=True)))
def _b37o(t, p):
    return PR.author_source_efficiency(t, p.period, Filters(author=p.author, section=OWN_SECTION), p.settings)


@register("rank_sources", _sqlq(lambda p: f"SELECT * FROM ({b36_sql(p)}) b ORDER BY sessions_per_note ASC NULLS FIRST, source_class"))
def _c8(t, p):
    return PR.rank_sources(PR.source_efficiency(t, p.period, p.filters(), p.settings))


# ---------------------------------------------------------------- B38-B42, C7
def _prod_final(a, tr, require_sessions, limit):
    where = " WHERE COALESCE(t.sessions_total, 0) > 0" if require_sessions else ""
    return (f"SELECT a.author, a.country, a.notes, COALESCE(t.sessions_total, 0) AS sessions, COALESCE(t.scroll, 0.0) AS scroll_rate, "
            f"{sdiv('COALESCE(t.sessions_total, 0)', 'a.notes')} AS efficiency FROM ({a}) a LEFT JOIN ({tr}) t "
            f"ON a.email_editor = t.email_editor{where} ORDER BY sessions DESC, author ASC NULLS FIRST, country ASC NULLS FIRST, "
            f"notes DESC LIMIT {limit}")


def _per_author_sql(p, where, having=""):
    st = p.settings
    return (f"SELECT e.email_editor, COALESCE(a.complete_name, e.email_editor) AS author, "
            f"COALESCE(a.country, {lit(st.unknown_country)}) AS country, COUNT(DISTINCT e.note_id) AS notes "
            f"FROM editorial_activity e LEFT JOIN authors a ON LOWER(e.email_editor) = LOWER(a.email) WHERE {where} "
            f"AND {present_sql('e.email_editor')} AND LOWER(e.email_editor) != LOWER({lit(st.agency_editor)}) GROUP BY 1, 2, 3{having}")


def b38_sql(p, metric_type="created", section=None, country=None):
    acts = ", ".join(lit(a) for a in PV.ACTIONS_BY_METRIC[metric_type])
    base = f"e.action_type IN ({acts}) AND {per(p, 'e.event_timestamp')}"
    a = _per_author_sql(p, base + sec_cty("e.segment", section, country),
                        f" HAVING COUNT(DISTINCT e.note_id) >= {p.settings.min_notes}")
    tr = (f"SELECT email_editor, {isum('visits')} AS sessions_total, {sdiv('SUM(scrolls)', 'SUM(visits)')} AS scroll "
          f"FROM traffic_daily g JOIN (SELECT email_editor, story_url FROM editorial_activity e WHERE {base} GROUP BY ALL) u "
          f"ON u.story_url = g.article_url WHERE {per(p, 'g.date')} GROUP BY email_editor")
    return _prod_final(a, tr, True, p.settings.productivity_limit)


def b41_sql(p):
    a, st = lit(p.author), p.settings
    who = f"SELECT min({{'n': COALESCE(complete_name, {a}), 'c': COALESCE(country, {lit(st.unknown_country)})}}) AS r FROM authors WHERE LOWER(email) = LOWER({a})"
    traffic = (f"SELECT {isum('g.daily_sessions')} AS s, {sdiv('SUM(g.sessions_with_scroll)', 'SUM(g.daily_sessions)')} AS sc FROM traffic_clean g "
               f"WHERE {per(p, 'g.event_date')} AND EXISTS (SELECT 1 FROM o_author_urls_any u WHERE u.story_url = g.article_url)")
    return (f"SELECT COALESCE(w.r.n, {a}) AS author, COALESCE(w.r.c, {lit(st.unknown_country)}) AS country, k.n AS notes, "
            f"COALESCE(t.s, 0) AS sessions, COALESCE(t.sc, 0.0) AS scroll_rate, {sdiv('COALESCE(t.s, 0)', 'k.n')} AS efficiency "
            f"FROM ({who}) w, ({traffic}) t, (SELECT COUNT(*) AS n FROM o_author_published) k")


def b42_sql(p):
    where = (f"e.action_type = 'FIRST_PUBLISH' AND {per(p, 'e.event_timestamp')} "
             "AND EXISTS (SELECT 1 FROM o_author_notes o WHERE o.note_id = e.note_id)")
    tr = (f"SELECT email_editor, {isum('daily_sessions')} AS sessions_total, {sdiv('SUM(sessions_with_scroll)', 'SUM(daily_sessions)')} AS scroll "
          f"FROM traffic_clean g JOIN (SELECT email_editor, story_url FROM editorial_activity e WHERE {where} GROUP BY ALL) u "
          f"ON u.story_url = g.article_url WHERE {per(p, 'g.event_date')} GROUP BY email_editor")
    return _prod_final(_per_author_sql(p, where), tr, False, p.settings.productivity_limit)


def c7_sql(p, prod_sql):
    parts = []
    for name, col in PV.INSIGHTS:
        parts.append(f"SELECT * FROM (SELECT {lit(name)} AS insight, author, CAST({col} AS DOUBLE) AS value FROM prod "
                     f"ORDER BY {col} DESC, sessions DESC, author ASC LIMIT 1) x_{name}")
    body = f"SELECT * FROM ({' UNION ALL '.join(parts)}) u WHERE (SELECT COUNT(*) FROM prod) >= 3"
    return oracle(p, body, f"prod AS ({prod_sql})")


@register("author_productivity_created", _sqlq(lambda p: b38_sql(p, "created")))
def _b38(t, p):
    return PV.author_productivity(t, p.period, p.filters(), p.settings, "created")


@register("author_productivity_published", _sqlq(lambda p: b38_sql(p, "published")))
def _b39(t, p):
    return PV.author_productivity(t, p.period, p.filters(), p.settings, "published")


@register("author_productivity_participated", _sqlq(lambda p: b38_sql(p, "participated")))
def _b40(t, p):
    return PV.author_productivity(t, p.period, p.filters(), p.settings, "participated")


@register("author_productivity_participated_filtered", _sqlq(lambda p: b38_sql(p, "participated", p.section, p.country)))
def _b40f(t, p):
    return PV.author_productivity(t, p.period, p.filters(section=True, country=True), p.settings, "participated")


@register("author_own_productivity", _sqlq(b41_sql))
def _b41(t, p):
    return PV.author_own_productivity(t, p.period, p.filters(author=True), p.settings)


@register("author_publishers_productivity", _sqlq(b42_sql))
def _b42(t, p):
    return PV.author_publishers_productivity(t, p.period, p.filters(author=True), p.settings)


@register("author_insights", lambda p: c7_sql(p, b38_sql(p, "participated")))
def _c7(t, p):
    return PV.author_insights(PV.author_productivity(t, p.period, p.filters(), p.settings, "participated"))


# ---------------------------------------------------------------- B30-B35, C14
B30_SQL = "SELECT MAX(date) AS last_date FROM traffic_daily"


def b32_sql(p):
    return (f"SELECT DISTINCT e.email_editor, COALESCE(a.complete_name, e.email_editor) AS display_name, a.country AS country "
            f"FROM editorial_activity e LEFT JOIN authors a ON LOWER(e.email_editor) = LOWER(a.email) "
            f"WHERE e.action_type IN ('CREATE', 'FIRST_PUBLISH') AND {per(p, 'e.event_timestamp')} AND {present_sql('e.email_editor')}")


@register("last_data_date", _sqlq(lambda p: B30_SQL))
def _b30(t, p):
    return OPT.last_data_date(t)


@register("default_period", _sqlq(lambda p: (
    f"SELECT CAST(COALESCE(last_date, current_date) - INTERVAL 6 DAY AS DATE) AS start_date, "
    f"COALESCE(last_date, current_date) AS end_date FROM ({B30_SQL}) b")))
def _b31(t, p):
    return OPT.default_period(t)


@register("date_label", _sqlq(lambda p: f"SELECT strftime(last_date, '%d/%m/%Y') AS last_date_label FROM ({B30_SQL}) b"))
def _c14(t, p):
    return OPT.last_data_date(t).select(FMT.date_label("last_date").alias("last_date_label"))


@register("filter_authors", _sqlq(b32_sql))
def _b32(t, p):
    return OPT.filter_authors(t, p.period, p.settings)


@register("filter_sections", _sqlq(lambda p: (
    f"SELECT DISTINCT segment AS section FROM editorial_activity WHERE action_type = 'FIRST_PUBLISH' "
    f"AND {per(p, 'event_timestamp')} AND {present_sql('segment')} AND TRIM(segment) != ''")))
def _b33(t, p):
    return OPT.filter_sections(t, p.period)


@register("filter_countries", _sqlq(lambda p: (
    f"SELECT DISTINCT a.country FROM authors a JOIN (SELECT DISTINCT email_editor FROM editorial_activity "
    f"WHERE action_type IN ('CREATE', 'FIRST_PUBLISH') AND {per(p, 'event_timestamp')} AND {present_sql('email_editor')}) e "
    f"ON LOWER(a.email) = LOWER(e.email_editor) WHERE {present_sql('a.country')} AND TRIM(a.country) != ''")))
def _b34(t, p):
    return OPT.filter_countries(t, p.period)


@register("author_lookup", _sqlq(lambda p: f"SELECT display_name, MAX(email_editor) AS email FROM ({b32_sql(p)}) b WHERE {present_sql('display_name')} GROUP BY display_name"))
def _b35(t, p):
    return OPT.author_lookup(t, p.period, p.settings)


# ---------------------------------------------------------------- C9-C13
def compact_sql(x):
    v = f"CAST({x} AS DECIMAL(38,6))"
    return (f"CASE WHEN {v} IS NULL THEN '0' "
            f"WHEN {v} >= 1000000 THEN CAST(CAST(ROUND({v} * CAST(0.000001 AS DECIMAL(10,6)), 1) AS DECIMAL(38,1)) AS VARCHAR) || 'M' "
            f"WHEN {v} >= 1000 THEN CAST(CAST(ROUND({v} * CAST(0.001 AS DECIMAL(10,3)), 1) AS DECIMAL(38,1)) AS VARCHAR) || 'K' "
            f"ELSE format('{{:,}}', CAST(ROUND({v}, 0) AS BIGINT)) END")


def dotted_sql(x, positive_only=False):
    text = f"replace(format('{{:,}}', CAST(TRUNC({x}) AS BIGINT)), ',', '.')"
    if positive_only:
        return f"CASE WHEN {x} IS NOT NULL AND {x} > 0 THEN {text} ELSE '-' END"
    return f"CASE WHEN {x} IS NULL THEN '0' ELSE {text} END"


def percent_sql(x):
    return (f"CASE WHEN {x} IS NULL THEN '0.00%' ELSE "
            f"CAST(CAST(ROUND(CAST({x} AS DECIMAL(38,10)) * 100, 2) AS DECIMAL(38,2)) AS VARCHAR) || '%' END")


def minutes_sql(x):
    return f"CAST(CAST(ROUND(CAST(COALESCE({x}, 0) AS DECIMAL(38,6)), 1) AS DECIMAL(38,1)) AS VARCHAR) || ' min'"


@register("kpi_cards", _sqlq(lambda p: (
    "SELECT " + ", ".join(f"{compact_sql('k.' + c)} AS {name}" for c, name in REP.CARD_TEXTS)
    + ", " + ", ".join(f"format('{{:,}}', k.{c}) AS {name}" for c, name in REP.CARD_COUNTS)
    + f", {minutes_sql('k.avg_time_minutes')} AS avg_time_text"
    + f", {percent_sql('k.scroll_rate')} AS scroll_rate_text FROM ({b10_sql(p)}) k")))
def _c9(t, p):
    return REP.kpi_cards(K.kpis(t, p.period, p.filters(), p.settings))


@register("section_report", _sqlq(lambda p: (
    f"SELECT s.section AS \"Section\", {dotted_sql('s.notes')} AS \"Notes\", {dotted_sql('s.tool1_notes')} AS \"Tool 1\", "
    f"{dotted_sql('s.tool2_notes')} AS \"Tool 2\", {dotted_sql('s.sessions')} AS \"Sessions\", "
    f"{dotted_sql('s.pageviews')} AS \"Pageviews\", {percent_sql('s.scroll_rate')} AS \"Scroll\", "
    f"{dotted_sql('s.sessions_per_note', True)} AS \"Sessions per note\" FROM ({b23_sql(p)}) s")))
def _c13(t, p):
    return REP.section_report(SEC.section_stats(t, p.period, p.filters(), p.settings))


def _export_sql(p, inner):
    fmt = {"visits": dotted_sql("b.visits"), "pageviews": dotted_sql("b.pageviews"), "scroll_rate": percent_sql("b.scroll_rate"),
           "title_words": dotted_sql("b.title_words", True), "body_words": dotted_sql("b.body_words", True)}
    cols = ", ".join(f"{fmt.get(c, 'b.' + c)} AS \"{label}\"" for c, label in REP.ARTICLE_COLUMNS)
    return f"SELECT {cols} FROM ({inner}) b"


@register("article_export", _sqlq(lambda p: _export_sql(p, b28_sql(p))))
def _c12(t, p):
    return REP.article_export(A.top_articles(t, p.period, p.filters(), p.settings))


@register("author_article_export", _sqlq(lambda p: _export_sql(p, b29_sql(p))))
def _c12a(t, p):
    return REP.article_export(A.author_top_articles(t, p.period, p.filters(author=True), p.settings))


# ---------------------------------------------------------------- filter variants (one filter at a time)
@register("active_creators_country", _sqlq(lambda p: b1_sql(p, None, p.country)))
def _v1(t, p):
    return K.active_creators(t, p.period, p.filters(country=True), p.settings)


@register("published_notes_section", _sqlq(lambda p: b3_sql(p, p.section)))
def _v2(t, p):
    return K.published_notes(t, p.period, p.filters(section=True), p.settings)


@register("traffic_totals_country", _sqlq(lambda p: b6_sql(p, None, p.country)))
def _v3(t, p):
    return K.traffic_totals(t, p.period, p.filters(country=True), p.settings)


@register("author_kpis_filtered", _sqlq(lambda p: b10_sql(p, True, p.section, p.country)))
def _v4(t, p):
    return K.kpis(t, p.period, p.filters(True, True, True), p.settings)


@register("kpi_change_filtered", lambda p: b12_sql(p, False, p.section, p.country))
def _v5(t, p):
    return K.kpi_change_for(t, p.period, p.filters(section=True, country=True), p.settings)


@register("daily_published_section", _sqlq(lambda p: b17_sql(p, p.section)))
def _v6(t, p):
    return S.daily_published(t, p.period, p.filters(section=True), p.settings)


@register("top_creators_country",
          _sqlq(lambda p: b13_sql(p, "CREATE", "creator", "created_notes", None, p.country)))
def _v7(t, p):
    return R.top_creators(t, p.period, p.filters(country=True), p.settings)


@register("section_stats_country", _sqlq(lambda p: b23_sql(p, None, p.country)))
def _v8(t, p):
    return SEC.section_stats(t, p.period, p.filters(country=True), p.settings)


@register("source_efficiency_country", _sqlq(lambda p: b36_sql(p, None, p.country)))
def _v9(t, p):
    return PR.source_efficiency(t, p.period, p.filters(country=True), p.settings)


@register("author_productivity_created_section", _sqlq(lambda p: b38_sql(p, "created", p.section)))
def _v10(t, p):
    return PV.author_productivity(t, p.period, p.filters(section=True), p.settings, "created")


@register("top_articles_country", _sqlq(lambda p: b28_sql(p, None, p.country)))
def _v11(t, p):
    return A.top_articles(t, p.period, p.filters(country=True), p.settings)


@register("traffic_by_dimension_section", _sqlq(lambda p: b26_sql(p, p.section)))
def _v12(t, p):
    return D.traffic_by_dimension_filtered(t, p.period, p.filters(section=True), p.settings)


@register("daily_users_country", _sqlq(lambda p: b19_sql(p, None, p.country)))
def _v13(t, p):
    return S.daily_users(t, p.period, p.filters(country=True), p.settings)


@register("author_daily_published_trend_direction", lambda p: c2_sql(p, b18_sql(p)))
def _v14(t, p):
    return S.trend_direction(S.author_daily_published(t, p.period, p.filters(author=True), p.settings), p.period.start)


# ---------------------------------------------------------------- data quality
from presswork.sources import quality as Q  # noqa: E402


@register("author_email_duplicates", _sqlq(lambda p: (
    "SELECT LOWER(email) AS email_key, COUNT(*) AS rows, COUNT(DISTINCT email) AS spellings FROM authors "
    "WHERE email IS NOT NULL GROUP BY LOWER(email) HAVING COUNT(*) > 1")))
def _q1(t, p):
    return Q.author_email_duplicates(t)


# ---------------------------------------------------------------- C9-C11 on their own
@register("compact_number", _sqlq(lambda p: (
    f"SELECT source_class, {compact_sql('b.sessions')} AS sessions_text, {compact_sql('b.sessions_per_note')} "
    f"AS sessions_per_note_text FROM ({b36_sql(p)}) b")))
def _c9b(t, p):
    b = PR.source_efficiency(t, p.period, p.filters(), p.settings)
    return b.select("source_class", FMT.compact_number("sessions").alias("sessions_text"),
                    FMT.compact_number("sessions_per_note").alias("sessions_per_note_text"))


@register("dotted_thousands", _sqlq(lambda p: (
    f"SELECT b.author, b.country, {dotted_sql('b.notes')} AS notes_text, {dotted_sql('b.sessions')} AS sessions_text, "
    f"{dotted_sql('b.efficiency', True)} AS efficiency_text FROM ({b38_sql(p, 'participated')}) b")))
def _c10(t, p):
    b = PV.author_productivity(t, p.period, p.filters(), p.settings, "participated")
    return b.select("author", "country", FMT.dotted_thousands("notes").alias("notes_text"),
                    FMT.dotted_thousands("sessions").alias("sessions_text"),
                    FMT.dotted_thousands("efficiency", positive_only=True).alias("efficiency_text"))


@register("percent_text", _sqlq(lambda p: (
    f"SELECT b.url, {percent_sql('b.scroll_rate')} AS scroll_text FROM ({b28_sql(p)}) b")))
def _c11(t, p):
    b = A.top_articles(t, p.period, p.filters(), p.settings)
    return b.select("url", FMT.percent_text("scroll_rate").alias("scroll_text"))


@register("kpis_previous_period_filtered",
          lambda p: oracle(p, b10_sql(p, False, p.section, p.country, period=p.period.previous())))
def _v15(t, p):
    return K.kpis_previous_period(t, p.period, p.filters(section=True, country=True), p.settings)


@register("author_kpi_change_filtered", lambda p: b12_sql(p, True, p.section, p.country))
def _v16(t, p):
    return K.kpi_change_for(t, p.period, p.filters(True, True, True), p.settings)
