"""Personal data: masking, detection, birth dates and ages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archivolt.functions import fixed

BIRTH = next(p for k, p, _ in fixed.PII if k == "fecha_nacimiento")


def mask(c: Column) -> Column:
    """Text with all personal data replaced by labels, kind after kind."""
    for _, pattern, label in fixed.PII:
        c = F.regexp_replace(c, "(?U)" + pattern, label)
    return c


def masked_count(c: Column) -> Column:
    """How many places masking replaces; each kind counts on the text masked so far."""
    total = F.lit(0)
    for _, pattern, label in fixed.PII:
        total = total + F.regexp_count(c, F.lit("(?U)" + pattern))
        c = F.regexp_replace(c, "(?U)" + pattern, label)
    return total


def found(df: DataFrame, text: str) -> DataFrame:
    """A row per finding on the raw text: the columns of df, kind, label and match, in order."""
    kinds = F.array(
        *[
            F.struct(F.lit(n).alias("kind_order"), F.lit(k).alias("kind"), F.lit(label).alias("label"), F.regexp_extract_all(F.col(text), F.lit("(?U)" + p), F.lit(0)).alias("matches"))
            for n, (k, p, label) in enumerate(fixed.PII)
        ]
    )
    each = df.withColumn("_k", F.explode(kinds))
    return each.select(*df.columns, "_k.kind_order", "_k.kind", "_k.label", F.posexplode("_k.matches").alias("position", "match"))


def birth_date(c: Column) -> Column:
    """The first birth date in a text, null if there is none or it is no date."""
    hit = F.regexp_extract(c, "(?U)" + BIRTH, 0)
    part = [F.regexp_extract(hit, fixed.DATE_PARTS, n) for n in (1, 2, 3)]
    year = part[2].try_cast("int")
    full = F.when(year < 100, F.when(year > 30, year + 1900).otherwise(year + 2000)).otherwise(year)
    iso = F.concat_ws("-", F.lpad(full.cast("string"), 4, "0"), F.lpad(part[1], 2, "0"), F.lpad(part[0], 2, "0"))
    return F.when(hit != "", F.try_to_date(iso, "yyyy-MM-dd"))


def age(born: Column, today: Column) -> Column:
    """Full years from a birth date to a day; null if negative."""
    before = (F.month(today) < F.month(born)) | ((F.month(today) == F.month(born)) & (F.dayofmonth(today) < F.dayofmonth(born)))
    years = F.year(today) - F.year(born) - F.when(before, 1).otherwise(0)
    return F.when(years >= 0, years)
