"""Hand-made tables of a few rows, one per semantic trap."""

import datetime as dt

from presswork.sources.tables import SCHEMAS, Tables


def ts(day, hour=12, minute=0, second=0):
    return dt.datetime(2024, 1, day, hour, minute, second)


def d(day):
    return dt.date(2024, 1, day)


def ed(note, url, editor, action, when, segment="politics", source="Editor-one v2", title=None, tw=5, bw=200):
    return (note, url, editor, action, when, segment, source, title if title is not None else f"Title {note}", tw, bw)


def gold(day, url, visits, publish=None, section="politics", creator="a@x", source="Editor-one v2", title=None,
         pageviews=None, scrolls=None, seconds=None):
    return (d(day), url, publish or d(day), title if title is not None else f"Title {url}", section, creator, source,
            visits, pageviews if pageviews is not None else visits + 1, scrolls if scrolls is not None else visits // 2,
            seconds if seconds is not None else visits * 30)


def clean(day, url, sessions, users=None, pageviews=None, scroll=None, seconds=None):
    return (d(day), url, sessions, pageviews if pageviews is not None else sessions + 1,
            users if users is not None else max(sessions - 1, 0), scroll if scroll is not None else sessions // 2,
            seconds if seconds is not None else sessions * 30)


def make_tables(spark, editorial=(), daily=(), clean_rows=(), dims=(), authors=()):
    def df(name, rows):
        return spark.createDataFrame(list(rows), SCHEMAS[name])

    return Tables(
        editorial=df("editorial_activity", editorial),
        traffic_daily=df("traffic_daily", daily),
        traffic_clean=df("traffic_clean", clean_rows),
        traffic_dimensions=df("traffic_dimensions", dims),
        authors=df("authors", authors),
    )
