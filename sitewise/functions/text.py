"""Text columns: POI context sentences, prompts, cache keys and the strict reading of model replies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitewise.functions import let

# Labels of facility kinds and the sentences about a cell, as the inputs of the model have them.
AMENITY_LABELS = {
    "clinic": "клиники",
    "hospital": "больницы",
    "doctors": "кабинеты врачей",
    "dentist": "стоматологии",
}
OTHER_LABEL = "прочее"
CONTEXT_HEAD = "Рядом медучреждений: "
CONTEXT_NONE = "Медучреждений рядом не обнаружено."
AREA_CHARACTERS = ("residential", "commercial", "industrial", "mixed")

PROMPT_HEAD = (
    "Перед тобой короткая справка о квартале города. Опиши общее впечатление о нём.\n"
    "Никаких расчётов: численность жителей, спрос и расстояния берутся из других данных.\n"
    "Справка: «"
)
PROMPT_TAIL = (
    "»\n"
    "Ответ: только объект JSON с тремя полями: wealth_score (целое от 0 до 10, достаток), "
    "area_character (residential, commercial, industrial или mixed, характер застройки) и "
    "confidence (от 0 до 1, уверенность)."
)


def label(amenity: Column) -> Column:
    """The label of a facility kind: unknown kinds stand for themselves, the empty one for others."""
    known = F.create_map(*[F.lit(x) for pair in AMENITY_LABELS.items() for x in pair])
    return F.coalesce(known[amenity], F.nullif(amenity, F.lit("")), F.lit(OTHER_LABEL))


def prompt(context: Column) -> Column:
    return F.concat(F.lit(PROMPT_HEAD), context, F.lit(PROMPT_TAIL))


def cache_key(model: Column | str, text: Column) -> Column:
    """SHA-256 of the model's name and the prompt."""
    name = F.lit(model) if isinstance(model, str) else model
    return F.sha2(F.concat_ws("\n", name, text), 256)


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def json_part(raw: Column) -> Column:
    """What stands from a reply's first brace to its last; only an object is an answer."""
    return F.regexp_extract(raw, r"(?s)\{.*\}", 0)


def reply(raw: Column) -> Column:
    """struct<wealth_score, area_character, confidence, error>: error is null for a valid reply, whose fields are then set.

    Numbers are read as leniently as constructors of a scripting language do: 7.9
    is 7, "7" is 7, true is 1, "7.5" is no whole number. Null, missing, not
    finite and out-of-range values are errors, as is text that isn't JSON.
    """

    def read(v: Column) -> Column:
        wealth = F.try_variant_get(v, "$.wealth_score", "int")
        confidence = F.try_variant_get(v, "$.confidence", "double")
        area = F.lower(_stripped(F.try_variant_get(v, "$.area_character", "string")))
        error = (
            F.when(v.isNull(), "not json")
            .when(wealth.isNull(), "no wealth_score")
            .when(confidence.isNull(), "no confidence")
            .when(area.isNull(), "no area_character")
            .when(~wealth.between(0, 10), "wealth_score out of range")
            .when(F.isnan(confidence) | ~confidence.between(0, 1), "confidence out of range")
            .when(~area.isin(*AREA_CHARACTERS), "unknown area_character")
        )
        ok = error.isNull()
        return F.struct(
            F.when(ok, wealth).alias("wealth_score"), F.when(ok, area).alias("area_character"),
            F.when(ok, confidence).alias("confidence"), error.alias("error"),
        )

    return let(F.try_parse_json(json_part(raw)), read)
