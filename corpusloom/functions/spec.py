"""Profile of a module specification held as JSON text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from corpusloom import constants as K
from corpusloom.schemas import MODULE_SPEC


def spec_profile(json_text: Column) -> Column:
    """Struct of names, counts and defaults; absent parts take the default. NULL for text that is no JSON object."""
    spec = F.from_json(json_text, MODULE_SPEC)
    d = K.SPEC_DEFAULTS

    def size(c: Column) -> Column:
        return F.coalesce(F.array_size(c), F.lit(0))

    def default(c: Column, key: str) -> Column:
        return F.coalesce(c, F.lit(d[key]))

    entities = F.transform(
        F.coalesce(spec["entities"], F.array()),
        lambda e: F.concat(
            default(e["name"], "entity_name"), F.lit(" with "),
            size(e["fields"]).cast("string"), F.lit(" fields"),
        ),
    )
    profile = F.struct(
        default(spec["module"]["name"], "module_name").alias("module_name"),
        entities.alias("entities"),
        default(spec["api"]["style"], "api_style").alias("api_style"),
        default(spec["api"]["base_path"], "base_path").alias("base_path"),
        size(spec["api"]["endpoints"]).alias("endpoints_count"),
        default(spec["ui"]["framework"], "ui_framework").alias("ui_framework"),
        size(spec["ui"]["routes"]).alias("routes_count"),
        default(spec["persistence"]["driver"], "persistence").alias("persistence"),
    )
    parsed = F.try_parse_json(json_text)
    return F.when(F.startswith(F.schema_of_variant(parsed), F.lit("OBJECT")), profile)
