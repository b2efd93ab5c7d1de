"""Nested and semi-structured input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DataType, StringType, StructType

from sentinela.functions.dates import epoch_millis_to_date
from sentinela.functions.text import strip_parenthesis_suffix

QUALITY_TESTS = "array<struct<column_tested:string,test_applied:string,status:string>>"


def _type_at(schema: StructType, path: str) -> DataType | None:
    found: DataType = schema
    for part in path.split("."):
        if not isinstance(found, StructType) or part not in found.fieldNames():
            return None
        found = found[part].dataType
    return found


def field_or_null(df: DataFrame, path: str, type_name: str = "string") -> Column:
    """Nested field, or NULL when the documents that were read never had it."""
    if _type_at(df.schema, path) is None:
        return F.lit(None).cast(type_name)
    return F.col(path)


def flatten_municipalities(df: DataFrame) -> DataFrame:
    """Registry documents to code, name and the two regional names."""
    return df.select(
        field_or_null(df, "id", "bigint").alias("cd_geocode"),
        field_or_null(df, "nome").alias("nm_municipio"),
        field_or_null(df, "microrregiao.nome").alias("nm_microrregiao"),
        field_or_null(df, "microrregiao.mesorregiao.nome").alias("nm_mesorregiao"),
    )


def parse_population(df: DataFrame) -> DataFrame:
    """Statistical-service records to population per municipality and year.

    The service puts a record of column titles first; it is the one whose code is no number.
    """
    code = F.col("D1C").try_cast("bigint")
    return df.filter(code.isNotNull()).select(
        code.alias("cd_geocode"),
        strip_parenthesis_suffix(F.col("D1N")).alias("nm_municipio"),
        F.col("V").try_cast("bigint").alias("vl_populacao"),
        F.col("D3C").try_cast("int").alias("dt_ano_referencia"),
    )


# Source field and type -> table column.
ALERT_FIELDS = {
    "nr_nivel_alerta": ("nivel", "int"),
    "vl_casos_estimados": ("casos_est", "double"),
    "vl_casos_estimados_min": ("casos_est_min", "double"),
    "vl_casos_estimados_max": ("casos_est_max", "double"),
    "vl_casos": ("casos", "bigint"),
    "vl_rt": ("Rt", "double"),
    "vl_incidencia": ("p_inc100k", "double"),
    "vl_temp_min": ("tempmin", "double"),
    "vl_temp_max": ("tempmax", "double"),
    "vl_umid_min": ("umidmin", "double"),
    "vl_umid_max": ("umidmax", "double"),
    "vl_receptividade": ("receptivo", "int"),
    "vl_transmissao": ("transmissao", "int"),
    "nm_municipio": ("municipio_nome", "string"),
}


def flatten_alerts(df: DataFrame, disease: Column | None = None, geocode: Column | None = None) -> DataFrame:
    """Alert documents to the alert table's columns.

    The week code ``yyyyww`` splits into year and week; a missing code counts as 0. Disease
    and municipality come from the caller, or from fields of those names.
    """
    week_code = F.coalesce(field_or_null(df, "SE", "bigint").cast("bigint"), F.lit(0))
    fields = [
        field_or_null(df, source, type_name).try_cast(type_name).alias(name)
        for name, (source, type_name) in ALERT_FIELDS.items()
    ]
    return df.select(
        (geocode if geocode is not None else F.col("geocode")).alias("cd_geocode"),
        (disease if disease is not None else F.col("disease")).alias("ds_doenca"),
        epoch_millis_to_date(field_or_null(df, "data_iniSE", "bigint")).alias("dt_semana_epidemiologica"),
        (week_code % 100).cast("int").alias("nr_semana_epi"),
        F.floor(week_code / 100).cast("int").alias("nr_ano_epi"),
        *fields,
    )


def parse_json_field(c: Column, schema: str) -> Column:
    """Typed struct from JSON text; NULL and text that does not parse give a struct of NULLs."""
    return F.coalesce(F.from_json(c, schema), F.from_json(F.lit("{}"), schema))


def legacy_info_json(c: Column) -> Column:
    """JSON from a record kept as the text of a Python dictionary; JSON text passes through."""
    quoted = F.regexp_replace(c, "'", '"')
    nulls = F.regexp_replace(quoted, r"\bNone\b", "null")
    truths = F.regexp_replace(F.regexp_replace(nulls, r"\bTrue\b", "true"), r"\bFalse\b", "false")
    return F.when(F.contains(c, F.lit("'")) & ~F.contains(c, F.lit('"')), truths).otherwise(c)


def explode_quality_tests(runs: DataFrame, info: str = "info", tests: str = "quality_tests") -> DataFrame:
    """One row per quality test of each run, from the typed column or from ``info`` text."""
    if tests in runs.columns and isinstance(runs.schema[tests].dataType, ArrayType):
        listed = F.col(tests)
    elif isinstance(runs.schema[info].dataType, StringType):
        listed = F.from_json(legacy_info_json(F.col(info)), f"{tests} {QUALITY_TESTS}")[tests]
    else:
        raise ValueError(f"neither a {tests} array nor {info} text to read the tests from")
    return runs.select("start_execution", "table_name", "job_name", F.explode(listed).alias("t")).select(
        "start_execution", "table_name", "job_name",
        F.coalesce("t.column_tested", F.lit("")).alias("column_tested"),
        F.coalesce("t.test_applied", F.lit("")).alias("test_applied"),
        F.coalesce("t.status", F.lit("")).alias("status"),
    )


def normalize_quality_info(df: DataFrame, info: str = "info") -> DataFrame:
    """Append one test's details, looked up under their alternative names."""
    def pick(*keys: str) -> Column:
        return F.coalesce(*[F.get_json_object(F.col(info), f"$.{k}") for k in keys])

    unknown = F.lit("unknown")
    return df.withColumns({
        "column_tested": F.coalesce(pick("column", "column_name"), unknown),
        "test_applied": F.coalesce(pick("test_type", "test"), unknown),
        "test_status": F.upper(F.coalesce(pick("status", "result"), unknown)),
        "execution_timestamp": pick("timestamp", "executed_at"),
        "value_found": pick("value"),
        "value_expected": pick("expected"),
        "threshold": pick("threshold"),
    })
