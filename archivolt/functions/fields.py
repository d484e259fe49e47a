"""Validators of patient fields: a clean value, or null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from archivolt.functions import fixed


def _trimmed(c: Column) -> Column:
    t = F.trim(c.cast("string"))
    return F.when(t != "", t)


def age(c: Column) -> Column:
    digits = F.regexp_replace(c.cast("string"), r"\D", "")
    n = digits.try_cast("int")
    return F.when(n.between(0, 120), n.cast("string"))


def national_id(c: Column) -> Column:
    s = F.regexp_replace(c.cast("string"), "[^0-9A-Za-z]", "")
    return F.when(F.length(s).between(6, 12), s)


def date(c: Column) -> Column:
    """A date in one of four formats as dd/MM/yyyy."""
    s = F.trim(c)
    day = F.coalesce(*[F.try_to_date(F.when(s.rlike(shape), s), f) for f, shape in (("d/M/yyyy", "^[0-9/]+$"), ("d-M-yyyy", r"^\d{1,2}-"), ("yyyy-M-d", r"^\d{4}-"), ("d.M.yyyy", "^[0-9.]+$"))])
    return F.date_format(day, "dd/MM/yyyy")


def sex(c: Column) -> Column:
    s = F.regexp_replace(F.lower(c), "[^a-z]", "")
    female = s.startswith("f") | s.contains("femenin") | s.contains("mujer")
    male = s.startswith("m") | s.startswith("h") | s.contains("masculin") | s.contains("hombre")
    return F.when(female, "F").when(male, "M")


def name(c: Column) -> Column:
    s = _trimmed(c)
    ok = F.length(s).between(3, 80) & ~F.lower(s).rlike(fixed.FORM_LABELS) & s.rlike("[A-Za-zÁÉÍÓÚÑáéíóúñ]")
    return F.when(ok, s)


def record_number(c: Column) -> Column:
    s = _trimmed(c)
    ok = F.length(s).between(4, 40) & ~F.lower(s).rlike(fixed.FORM_LABELS) & ~s.rlike(r"^[\d\s\-]+$")
    return F.when(ok, s)


def short_list(items: Column, cap: int = 8) -> Column:
    """Trimmed items, without empty ones and repeats whatever their case, the first cap."""
    clean = F.filter(F.transform(F.coalesce(items, F.array().cast("array<string>")), lambda s: F.trim(s)), lambda s: s.isNotNull() & (s != ""))
    low = F.transform(clean, lambda s: F.lower(s))
    first = F.filter(F.transform(clean, lambda s, i: F.struct(s.alias("s"), i.alias("i"))), lambda p: F.array_position(low, F.lower(p["s"])) == p["i"] + 1)
    return F.slice(F.transform(first, lambda p: p["s"]), 1, cap)
