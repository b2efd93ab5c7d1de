"""Table definitions, quality suites and gold targets of the surveillance data model."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Columns and types, partition columns last.
_NAMES = {"nm_municipio": "string", "nm_microrregiao": "string", "nm_mesorregiao": "string"}

TABLES: dict[str, tuple[dict[str, str], list[str]]] = {
    "tb_municipios": ({"cd_geocode": "int", **_NAMES}, []),
    "tb_populacao": (
        {"cd_geocode": "int", "nm_municipio": "string", "vl_populacao": "int", "dt_ano_referencia": "int"},
        ["dt_ano_referencia"]),
    "tb_alertas": (
        {"cd_geocode": "int", "ds_doenca": "string", "nr_semana_epi": "int", "nr_nivel_alerta": "int",
         "vl_casos_estimados": "double", "vl_casos_estimados_min": "double", "vl_casos_estimados_max": "double",
         "vl_casos": "int", "vl_rt": "double", "vl_incidencia": "double", "vl_temp_min": "double",
         "vl_temp_max": "double", "vl_umid_min": "double", "vl_umid_max": "double", "vl_receptividade": "int",
         "vl_transmissao": "int", "nm_municipio": "string", "nr_ano_epi": "int", "dt_semana_epidemiologica": "date"},
        ["nr_ano_epi", "dt_semana_epidemiologica"]),
    "tb_notificacoes": (
        {"id_agravo": "string", "dt_sin_pri": "date", "id_municip": "int", "sg_uf": "int", "nu_idade_n": "int",
         "cs_sexo": "string", "classi_fin": "string", "evolucao": "string", "dt_notific": "date"},
        ["dt_notific"]),
    "tb_ft_alerta_semanal": (
        {"cd_geocode": "int", **_NAMES, "vl_populacao": "int", "nr_semana_epi": "int", "nr_nivel_alerta": "int",
         "ds_nivel_alerta": "string", "vl_casos": "int", "vl_casos_estimados": "double", "vl_incidencia": "double",
         "vl_rt": "double", "fl_epidemia": "int", "fl_transmissao": "int", "fl_receptividade": "int",
         "vl_temp_min": "double", "vl_temp_max": "double", "vl_umid_min": "double", "vl_umid_max": "double",
         "nr_ano_epi": "int", "ds_doenca": "string", "dt_semana_epidemiologica": "date"},
        ["nr_ano_epi", "ds_doenca", "dt_semana_epidemiologica"]),
    "tb_ft_ranking_anual": (
        {"cd_geocode": "int", **_NAMES, "vl_populacao": "int", "vl_total_casos": "int",
         "vl_incidencia_acumulada": "double", "nr_max_alerta": "int", "nr_semanas_alerta_vermelho": "int",
         "nr_semanas_alerta_alto": "int", "nr_semanas_transmissao_ativa": "int", "nr_semanas_rt_acima_1": "int",
         "vl_rt_medio": "double", "nr_rank_estado": "int", "nr_rank_mesorregiao": "int", "nr_ano_epi": "int",
         "ds_doenca": "string"},
        ["nr_ano_epi", "ds_doenca"]),
    "tb_ft_perfil_demografico": (
        {"cd_geocode_ibge": "int", **_NAMES, "id_agravo": "string", "ds_doenca": "string",
         "ds_faixa_etaria": "string", "cs_sexo": "string", "nr_notificacoes": "int", "nr_casos_confirmados": "int",
         "nr_obitos": "int", "nr_curas": "int", "nr_ano_notificacao": "int", "nr_mes_notificacao": "int"},
        ["nr_ano_notificacao", "nr_mes_notificacao"]),
}

# Checks per silver table.
SUITES: dict[str, dict] = {
    "tb_municipios": {
        "not_null": {"column": "cd_geocode,nm_municipio"},
        "unique_vals": {"column": "cd_geocode"},
        "df_count_between": {"min": 640, "max": 660},
    },
    "tb_populacao": {
        "not_null": {"column": "cd_geocode,vl_populacao"},
        "unique_vals": {"column": "cd_geocode"},
        "df_count_between": {"min": 640, "max": 660},
        "values_between": {"column": "vl_populacao", "min": "100", "max": "15000000"},
    },
    "tb_alertas": {
        "not_null": {"column": "cd_geocode,ds_doenca,nr_semana_epi,nr_nivel_alerta,vl_casos"},
        "values_to_be_in_set": {
            "column": "ds_doenca,nr_nivel_alerta,vl_receptividade,vl_transmissao", "type": "str,int,int,int",
            "set_values": [["dengue", "chikungunya", "zika"], [1, 2, 3, 4], [0, 1, 2, 3, 4], [0, 1, 2, 3, 4]]},
        "values_between": {"column": "nr_semana_epi,vl_casos", "min": "1,0", "max": "53,1000000"},
        "df_count_between": {"min": 1, "max": 200000},
    },
    "tb_notificacoes": {
        "not_null": {"column": "ID_AGRAVO,DT_NOTIFIC,ID_MUNICIP"},
        "df_count_between": {"min": 1000, "max": 50000000},
    },
}

# Partition column the ingestion of each silver table names.
INGEST_PARTITION = {"tb_municipios": None, "tb_populacao": "dt_ano_referencia", "tb_alertas": "nr_ano_epi",
                    "tb_notificacoes": "dt_notific"}
DATE_MASK = "yyyy-MM-dd"


def columns(table: str, wide: bool = False) -> dict[str, str]:
    """Column types of a table; ``wide`` makes codes and counts 64-bit, for more data than a state's."""
    declared = TABLES[table][0]
    return {name: "bigint" if wide and kind == "int" else kind for name, kind in declared.items()}


def ingest_schema(table: str, wide: bool = False) -> dict:
    """The schema an ingestion declares: dates are read with their mask."""
    return {name: ["date", DATE_MASK] if kind == "date" else kind for name, kind in columns(table, wide).items()}


def create_table(spark: SparkSession, name: str, table: str, location: str, wide: bool = False,
                 partitions: list[str] | None = None) -> None:
    """Create catalog table ``name`` with the layout of ``table`` at ``location``.

    ``partitions`` replaces the model's partition columns; a first load of many years of daily
    partitions writes a file per day, so a coarser layout may suit it better.
    """
    listed = ", ".join(f"{c} {kind}" for c, kind in columns(table, wide).items())
    partitions = TABLES[table][1] if partitions is None else partitions
    by = f"PARTITIONED BY ({', '.join(partitions)})" if partitions else ""
    spark.sql(f"CREATE TABLE {name} ({listed}) USING parquet {by} LOCATION '{location}'")
