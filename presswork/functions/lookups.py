"""Fixed lookup values of the dashboard (display-language country names and short
country labels) and the JVM-side map expressions that apply them."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Country name (as the traffic source reports it) -> display name.
COUNTRY_TRANSLATIONS = {
    "Argentina": "Argentina", "Mexico": "México", "Colombia": "Colombia", "Spain": "España",
    "United States": "Estados Unidos", "Peru": "Perú", "Chile": "Chile", "Ecuador": "Ecuador",
    "Venezuela": "Venezuela", "Bolivia": "Bolivia", "Uruguay": "Uruguay", "Paraguay": "Paraguay",
    "Guatemala": "Guatemala", "Cuba": "Cuba", "Dominican Republic": "República Dominicana",
    "Honduras": "Honduras", "El Salvador": "El Salvador", "Nicaragua": "Nicaragua",
    "Costa Rica": "Costa Rica", "Panama": "Panamá", "Puerto Rico": "Puerto Rico",
    "Brazil": "Brasil", "Germany": "Alemania", "France": "Francia", "Italy": "Italia",
    "United Kingdom": "Reino Unido", "Canada": "Canadá", "Australia": "Australia",
    "Japan": "Japón", "China": "China", "India": "India", "Russia": "Rusia",
    "Portugal": "Portugal", "Netherlands": "Países Bajos", "Belgium": "Bélgica",
    "Switzerland": "Suiza", "Sweden": "Suecia", "Norway": "Noruega", "Denmark": "Dinamarca",
    "Poland": "Polonia", "Austria": "Austria", "Ireland": "Irlanda", "Israel": "Israel",
    "(not set)": "No especificado",
}

# Upper-case author country -> short label.
COUNTRY_CODES = {
    "ARGENTINA": "🇦🇷", "COLOMBIA": "🇨🇴", "PERU": "🇵🇪", "ESPAÑA": "🇪🇸", "MEXICO": "🇲🇽", "AMERICA": "AM",
}

def literal_map(mapping: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])


def translate_country(value) -> Column:
    """Display name of a country, unknown names unchanged."""
    v = F.col(value) if isinstance(value, str) else value
    return F.coalesce(F.try_element_at(literal_map(COUNTRY_TRANSLATIONS), v), v)


def country_code(country) -> Column:
    """Short label of an author country (matched upper-case), '' when unknown or NULL."""
    c = F.col(country) if isinstance(country, str) else country
    return F.coalesce(F.try_element_at(literal_map(COUNTRY_CODES), F.upper(c)), F.lit(""))
