"""Generalization of postal codes and dates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspark.functions import catalog as C


def truncate_zip(value: Column) -> Column:
    """The first three digits of the first run of three or more; 000 without any and for small populations."""
    text = value.cast("string")
    prefix = F.substring(F.regexp_extract(text, r"(?U)\d{3,}", 0), 1, 3)
    return F.when(value.isNotNull(), F.when((prefix == "") | prefix.isin(*C.RESTRICTED_ZIP3), "000").otherwise(prefix))


def generalize_date(value: Column) -> Column:
    """The year of a date, or a redaction where no year can be told."""
    text = value.cast("string")
    alone = F.regexp_extract(text, r"(?U)(?<!\d)((?:19|20)\d{2})(?!\d)", 1)
    digits = F.regexp_replace(text, r"(?U)\D", "")
    head, tail = F.substring(digits, 1, 4), F.substring(digits, 5, 4)
    compact = F.when(head.rlike("^(19|20)"), head).when(tail.rlike("^(19|20)"), tail)
    return F.when(value.isNotNull(), F.coalesce(F.when(alone != "", alone), F.when(F.length(digits) == 8, compact), F.lit("[REDACTED]")))


@dataclass(frozen=True)
class Profile:
    """What a framework adds to the policy."""

    name: str
    columns: tuple[str, ...] = ()
    tables: tuple[str, ...] = ()
    dates: bool = False
    zips: bool = False
    all_content: bool = False
    browsing: bool = False


def profile(mode: str) -> Profile:
    hipaa = Profile("HIPAA Safe Harbor", C.HIPAA_COLUMNS, dates=True, zips=True)
    gdpr = Profile("GDPR Article 4/9", C.GDPR_COLUMNS, all_content=True)
    ccpa = Profile("CCPA", C.CCPA_COLUMNS, C.CCPA_TABLES, browsing=True)
    if mode == "all":
        return Profile("ALL (HIPAA + GDPR + CCPA)", tuple(dict.fromkeys(hipaa.columns + gdpr.columns + ccpa.columns)), ccpa.tables, True, True, True, True)
    return {"hipaa": hipaa, "gdpr": gdpr, "ccpa": ccpa}.get(mode, Profile("default"))


def transform_value(name: str, value: Column, by: Profile) -> Column:
    """value as the profile generalizes a column of that name."""
    if by.zips and name.lower() in C.ZIP_COLUMNS:
        return truncate_zip(value)
    if by.dates and name.lower() in C.DATE_COLUMNS:
        return generalize_date(value)
    return value
