"""Column naming and text formats of the article and section tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswork.functions.formatting import (compact_number, dotted_thousands, grouped_integer, minutes_text,
                                           percent_text)
from presswork.sources.sinks import write_csv

# Column order of the article export.
ARTICLE_COLUMNS = (
    ("title", "Title"), ("section", "Section"), ("creator", "Creator"), ("publisher", "Publisher"),
    ("source", "Source"), ("title_words", "Title words"), ("body_words", "Body words"),
    ("visits", "Sessions"), ("pageviews", "Pageviews"), ("scroll_rate", "Scroll"), ("url", "URL"),
)


# KPI cards: the columns of a KPI row and their texts.
CARD_TEXTS = (("total_visits", "visits_text"), ("daily_user_sum", "users_text"), ("total_pageviews", "pageviews_text"),
              ("total_scrolls", "scrolls_text"), ("visits_per_note", "visits_per_note_text"))
CARD_COUNTS = (("active_creators", "creators_text"), ("active_publishers", "publishers_text"), ("published_notes", "notes_text"))


def kpi_cards(kpis: DataFrame) -> DataFrame:
    """The KPI row as the texts on its cards."""
    return kpis.select(
        [compact_number(c).alias(name) for c, name in CARD_TEXTS]
        + [grouped_integer(c).alias(name) for c, name in CARD_COUNTS]
        + [minutes_text("avg_time_minutes").alias("avg_time_text"), percent_text("scroll_rate").alias("scroll_rate_text")])


# C12
def article_export(articles: DataFrame) -> DataFrame:
    fmt = {
        "visits": dotted_thousands("visits"),
        "pageviews": dotted_thousands("pageviews"),
        "scroll_rate": percent_text("scroll_rate"),
        "title_words": dotted_thousands("title_words", positive_only=True),
        "body_words": dotted_thousands("body_words", positive_only=True),
    }
    return articles.select([fmt.get(c, F.col(c)).alias(label) for c, label in ARTICLE_COLUMNS])


def export_articles_csv(articles: DataFrame, path: str) -> None:
    write_csv(article_export(articles), path)


# C13
def section_report(sections: DataFrame) -> DataFrame:
    return sections.select(
        F.col("section").alias("Section"),
        dotted_thousands("notes").alias("Notes"),
        dotted_thousands("tool1_notes").alias("Tool 1"),
        dotted_thousands("tool2_notes").alias("Tool 2"),
        dotted_thousands("sessions").alias("Sessions"),
        dotted_thousands("pageviews").alias("Pageviews"),
        percent_text("scroll_rate").alias("Scroll"),
        dotted_thousands("sessions_per_note", positive_only=True).alias("Sessions per note"),
    )
