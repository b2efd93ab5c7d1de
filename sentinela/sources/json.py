"""JSON documents."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

# Accepted parameter name, reader option, default.
JSON_OPTIONS = {
    "primitive_as_string": ("primitivesAsString", "false"),
    "prefers_decimal": ("prefersDecimal", "false"),
    "allow_comments": ("allowComments", "false"),
    "allow_unquoted_field_names": ("allowUnquotedFieldNames", "false"),
    "allow_single_quotes": ("allowSingleQuotes", "true"),
    "allow_numeric_leading_zeros": ("allowNumericLeadingZeros", "false"),
    "allow_backslash_escaping_any_character": ("allowBackslashEscapingAnyCharacter", "false"),
    "column_name_of_corrupt_record": ("columnNameOfCorruptRecord", "_corrupt_record"),
    "enable_datetime_parsing_fallback": ("enableDateTimeParsingFallback", "true"),
    "multiline": ("multiLine", "true"),
    "allow_unquoted_control_chars": ("allowUnquotedControlChars", "false"),
    "encoding": ("encoding", "UTF-8"),
    "drop_field_if_all_null": ("dropFieldIfAllNull", "false"),
    "locale": ("locale", "en-US"),
    "allow_non_numeric_numbers": ("allowNonNumericNumbers", "true"),
    "line_sep": ("lineSep", None),
}


def json_reader_options(params: dict[str, Any] | None = None) -> dict[str, str]:
    """Reader options from snake_case parameters; an unknown name is an error."""
    # A setting of the format only, without a meaning for the reader.
    params = {k: v for k, v in (params or {}).items() if k != "use_unsafe_row"}
    unknown = sorted(set(params) - set(JSON_OPTIONS))
    if unknown:
        raise ValueError(f"unknown JSON options: {unknown}")
    options = {}
    for name, (option, default) in JSON_OPTIONS.items():
        value = params.get(name, default)
        if value is not None:
            options[option] = str(value).lower() if isinstance(value, bool) else str(value)
    return options


def explode_rows(df: DataFrame, column: str) -> DataFrame:
    """One row per array element, with only the element's fields."""
    return df.select(F.explode(column).alias(column)).select(f"{column}.*")


def read_json(spark: SparkSession, path: str | list[str], explode_column: str | None = None,
              schema: StructType | str | None = None, **params: Any) -> DataFrame:
    """Read JSON documents. A given ``schema`` saves the inference pass over the data;
    ``multiline=False`` reads one document per line, which also splits large files."""
    reader = spark.read.options(**json_reader_options(params))
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.json(path)
    return explode_rows(df, explode_column) if explode_column else df
