"""Nutrition-label text functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed_values import MAJOR_NUTRIENTS, SERVING_UNITS, SERVINGS_PHRASE, SIZE_PHRASE, SKIPPED_FACT
from .text import BLANK, col, trim_ws

_PY = BLANK["python"]
_FACT = rf"^([^\n]+?){_PY}+([0-9.]+[a-zA-Z]*|NA)\z"


def nutrient_parts(left: Column | str) -> Column:
    """``struct<text, name, quantity>``: the pattern groups, empty for a text of another shape."""
    left = trim_ws(left, "python")
    return F.struct(
        left.alias("text"),
        F.regexp_extract(left, _FACT, 1).alias("name"),
        F.regexp_extract(left, _FACT, 2).alias("quantity"),
    )


def nutrient_of(parts: Column) -> Column:
    quantity = parts["quantity"]
    matched = quantity != ""
    number = F.regexp_extract(quantity, r"^[0-9.]+", 0)
    unit = F.nullif(F.regexp_replace(quantity, r"^[0-9.]+", ""), F.lit(""))
    return F.struct(
        F.when(matched, trim_ws(parts["name"], "python")).otherwise(parts["text"]).alias("name"),
        number.try_cast("double").alias("amount"),
        F.when(quantity != "NA", unit).alias("unit"),
        matched.alias("matched"),
    )


def parse_nutrient(left: Column | str) -> Column:
    """``struct<name, amount, unit, matched>`` of a text such as ``Total Fat 25g``.

    ``NA`` gives null amount and unit. A text of another shape becomes the name as it is.
    """
    return nutrient_of(nutrient_parts(left))


def parse_dv(right: Column | str) -> Column:
    return trim_ws(F.replace(col(right), F.lit("%"), F.lit("")), "python").try_cast("double")


def skip_include_na(left: Column | str) -> Column:
    """True for rows to keep."""
    return ~F.contains(col(left), F.lit(SKIPPED_FACT))


def major_nutrient_flag(name: Column | str, names: tuple[str, ...] = MAJOR_NUTRIENTS) -> Column:
    return col(name).isin(*names)


def servings_per_container(text: Column | str) -> Column:
    """Number before the phrase, read from the first line that has the phrase."""
    lines = F.filter(F.split(col(text), "\n"), lambda line: F.contains(line, F.lit(SERVINGS_PHRASE)))
    return F.regexp_extract(F.get(lines, 0), rf"(\d+){_PY}*{SERVINGS_PHRASE}", 1).try_cast("int")


def serving_size(text: Column | str, units: tuple[str, ...] = SERVING_UNITS) -> Column:
    """The last labelled line wins; without one, the first line that looks like a size."""
    lines = F.split(col(text), "\n")
    labelled = F.flatten(
        F.transform(lines, lambda line: F.regexp_extract_all(line, F.lit(rf"{SIZE_PHRASE}{_PY}*(.+)"), F.lit(1)))
    )
    looks = rf"(?i)\b\d+.*(?:{'|'.join(units)})\b"
    unlabelled = F.filter(
        lines,
        lambda line: ~F.contains(line, F.lit(SERVINGS_PHRASE)) & ~F.contains(line, F.lit(SIZE_PHRASE)) & line.rlike(looks),
    )
    found = F.coalesce(F.try_element_at(labelled, F.lit(-1)), F.get(unlabelled, 0))
    return trim_ws(found, "python")
