"""Classifications shared by the models and the reports."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, functions as F

# The data model's code lists.
ALERT_NAMES = {1: "verde", 2: "amarelo", 3: "laranja", 4: "vermelho"}
ALERT_TITLES = {1: "Verde", 2: "Amarelo", 3: "Laranja", 4: "Vermelho"}
DISEASE_CODES = {"A90": "dengue", "A92": "chikungunya", "A92.8": "zika"}
SEX_NAMES = {"M": "Masculino", "F": "Feminino", "I": "Ignorado"}
MONTH_NAMES = {
    1: "Jan", 2: "Fev", 3: "Mar", 4: "Abr", 5: "Mai", 6: "Jun",
    7: "Jul", 8: "Ago", 9: "Set", 10: "Out", 11: "Nov", 12: "Dez",
}
AGE_BANDS = {"0-4": 5, "5-14": 15, "15-29": 30, "30-59": 60}
LAST_AGE_BAND = "60+"


def lookup(c: Column, mapping: dict, default: Column) -> Column:
    """Translate a code through ``mapping``; anything else becomes ``default``."""
    pairs = F.create_map(*[F.lit(v) for v in chain.from_iterable(mapping.items())])
    return F.coalesce(F.try_element_at(pairs, c), default)


def alert_name(level: Column) -> Column:
    return lookup(level.cast("int"), ALERT_NAMES, F.lit("desconhecido"))


def alert_title(level: Column, default: Column | None = None) -> Column:
    return lookup(level.cast("int"), ALERT_TITLES, F.lit(ALERT_TITLES[1]) if default is None else default)


def disease_name(code: Column) -> Column:
    return lookup(code, DISEASE_CODES, code)


def sex_or_unknown(c: Column) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit("I"))


def age_band(days: Column) -> Column:
    """Band of an age in days. An unknown age lands in the open last band, as in the model's definition."""
    years = F.floor(days / F.lit(365.25))
    bands = [F.when(years < limit, F.lit(name)) for name, limit in AGE_BANDS.items()]
    return F.coalesce(*bands, F.lit(LAST_AGE_BAND))


def size_class(population: Column) -> Column:
    return (F.when(population < 20_000, "Pequeno").when(population < 100_000, "Médio").otherwise("Grande"))


def rt_status(rt: Column) -> Column:
    return F.when(rt > 1.2, "Crescendo").when(rt >= 1.0, "Atenção").otherwise("Controlado")


def epidemic_flag(rt: Column, transmission: Column) -> Column:
    """1 when transmission is active and growing; unknown values count as 0."""
    return F.when((rt > 1.0) & (transmission == 1), 1).otherwise(0).cast("int")
