"""Column helpers shared by the operators. All stay inside the JVM."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fixed_values import SKY_BY_WEATHER_CODE


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lookup(mapping: Mapping, key: Column | str) -> Column:
    """Value of a small constant mapping, null for other keys."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), col(key))


def finite(value: Column | str) -> Column:
    """Number or null: text that is no number, NaN and infinities become null."""
    number = col(value).try_cast("double")
    return F.when(F.abs(number) < F.lit(float("inf")), number)


def half_up(value: Column | str, places: int) -> Column:
    """`F.round` of a double, to the last bit, by way of its decimal text only where that can matter.

    Scaled numbers below 2^33 are off by 3e-6 at most, so those 1e-4 away from a
    tie go to the integer next to them; dividing that gives the nearest double.
    """
    value, by = col(value), F.lit(float(10**places))
    scaled = value * by
    whole = F.rint(scaled)
    plain = (F.abs(scaled) < F.lit(2.0**33)) & (F.abs(scaled - whole) < F.lit(0.4999))
    # Adding 0.0 leaves no negative zero, as the decimal text would not.
    return F.when(plain, whole / by + F.lit(0.0)).otherwise(F.round(value, places))


def blank_to_null(value: Column | str) -> Column:
    return F.nullif(F.trim(col(value)), F.lit(""))


def zero_to_null(value: Column | str) -> Column:
    value = col(value)
    return F.when(value != 0, value)


def ine_code(province: Column | str, municipality: Column | str) -> Column:
    """Five digits: province padded to two, municipality to three; missing parts count as 0."""
    return F.concat(_padded(province, 2), _padded(municipality, 3))


def _padded(part: Column | str, width: int) -> Column:
    digits = F.coalesce(col(part).cast("int"), F.lit(0)).cast("string")
    return F.lpad(digits, F.greatest(F.length(digits), F.lit(width)), F.lit("0"))


def parcel_key(*parts: Column | str) -> Column:
    """Cadastral key; a missing part prints as None."""
    return F.concat_ws("-", *[F.coalesce(col(p).cast("string"), F.lit("None")) for p in parts])


def sky_state(text: Column | str, code: Column | str) -> Column:
    """Official text if there is any, else the text of the weather code, else null."""
    return F.coalesce(F.nullif(col(text), F.lit("")), lookup(SKY_BY_WEATHER_CODE, col(code).cast("int")))


def pick_period(items: Column | str, key: str = "value", period: str = "00-24") -> Column:
    """Field of the first item if items carry no period, else of the item for `period`."""
    items = col(items)
    whole = F.get(F.filter(items, lambda item: item["periodo"] == period), F.lit(0))
    first = F.get(items, F.lit(0))
    value = F.when(first["periodo"].isNull(), first[key]).otherwise(whole[key])
    return F.nullif(value, F.lit(""))


def first_number(*values: Column | str) -> Column:
    """First present value, as a number if it is one."""
    return F.coalesce(*[col(v).cast("string") for v in values]).try_cast("double")


def lat_lon_text(text: Column | str) -> Column:
    """Coordinates given as "lat,lon" or as a JSON list, as "lat,lon"."""
    parts = F.split(F.btrim(col(text), F.lit("[] \t\n\r")), ",")
    pair = [F.btrim(F.get(parts, F.lit(i)), F.lit('" \t\n\r')) for i in (0, 1)]
    return F.when(F.ltrim(col(text)).startswith("["), F.concat_ws(",", *pair)).otherwise(col(text))


def nth_number(text: Column | str, n: int) -> Column:
    return F.trim(F.get(F.split(col(text), ","), F.lit(n))).try_cast("double")


def since(df: DataFrame, time_col: str, lower: Column, day_col: str = "fecha") -> DataFrame:
    """Rows at or after `lower`; also prunes day partitions where the table has them."""
    if day_col in df.columns and day_col != time_col:
        df = df.filter(F.col(day_col) >= F.to_date(lower))
    return df.filter(F.col(time_col) >= lower)


def ntz(as_of) -> Column:
    """A zone-less timestamp literal from text, a datetime or a column."""
    if isinstance(as_of, Column):
        return as_of
    return F.lit(str(as_of)).cast("timestamp_ntz")
