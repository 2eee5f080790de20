"""Codes, dates and raw numbers of sale and census records."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_decimal(text: Column) -> Column:
    """Decimal comma to double; null where it isn't a number (P-01)."""
    return F.replace(text, F.lit(","), F.lit(".")).try_cast("double")


def _padded(code: Column, width: int) -> Column:
    return F.when(F.length(code) < width, F.lpad(code, width, "0")).otherwise(code)  # lpad alone would cut longer codes


def commune_code(department: Column, commune: Column) -> Column:
    """Department and number within it, padded to three digits (P-02)."""
    return F.concat(department, _padded(commune.cast("string"), 3))


def canonical_code(code: Column) -> Column:
    """Trimmed, padded to five characters (P-03)."""
    return _padded(F.trim(code), 5)


#: Cities whose districts are recorded apart: first and last district, city (fixed values).
DISTRICTS = ((75101, 75120, "75056"), (69381, 69389, "69123"), (13201, 13216, "13055"))


def fold_code(code: Column, districts: tuple[tuple[int, int, str], ...] = DISTRICTS) -> Column:
    """District codes to the city's own code (J-01)."""
    number = code.try_cast("int")
    out = code
    for first, last, city in districts:
        out = F.when(number.between(first, last), F.lit(city)).otherwise(out)
    return out


def quarter_start(day: Column) -> Column:
    return F.trunc(day, "quarter")


def quarter_label(day: Column) -> Column:
    """2024-Q1 (F-04)."""
    return F.concat(F.year(day).cast("string"), F.lit("-Q"), F.quarter(day).cast("string"))


def typology(rooms: Column) -> Column:
    """Room count to size class 1 to 4; null stays null (P-08)."""
    return F.when(rooms <= 1, 1).when(rooms >= 4, 4).otherwise(rooms.cast("int"))
