"""Findings that are known to be false, as one boolean column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspark.functions import catalog as C


def suppressed(path: Column, name: Column, found: Column) -> Column:
    """True where a finding of detector `name` with the text `found` at `path` does not count."""
    column = F.when(F.contains(path, F.lit(".")), F.substring_index(path, ".", -1)).otherwise("")
    lower = F.lower(column)
    plist = F.endswith(path, F.lit(".plist"))
    digits = F.regexp_replace(found, r"(?U)\D", "")
    distinct = lambda text: F.size(F.array_distinct(F.split(text, "")))
    value = F.abs(found.try_cast("double"))
    whole = F.coalesce(value >= 1.0, F.lit(True))
    octets = F.split(found, r"\.")
    first, second = (F.get(octets, i).try_cast("int") for i in (0, 1))
    most = F.array_max(F.transform(F.split(F.lit("0123456789"), ""), lambda c: F.length(digits) - F.length(F.replace(digits, c, F.lit("")))))
    rules = {
        ("gps_coord",): F.coalesce((value > 180) | (value == 0), F.lit(False)) | found.rlike(r"^-*0(?!\.)") | (whole & plist & found.rlike(r"\.(?:\d{4}|\d{8,})$")) | (lower == "external_mod_tag"),
        ("ssn",): lower.isin(*C.COUNTER_COLUMNS),
        ("ip_v4",): (F.size(octets) == 4) & (first.isin(17, 10) | ((first == 172) & second.between(16, 31)) | ((first == 192) & (second == 168)) | (F.length(found) == 7)),
        ("phone_us",): (F.length(digits) >= 10) & (most >= 7),
        ("credit_card",): digits.isin(*C.TEST_CARDS) | (distinct(digits) == 1),
        ("password_kv",): lower.isin(*C.EMBEDDING_COLUMNS),
        C.NOISY_DETECTORS: column.isin(*C.NOISY_COLUMNS),
        ("vin",): found.rlike(r"[0-9A-Fa-f]{17,}"),
        ("swift_bic",): found.rlike(r"^[A-Z]{8}$") | (distinct(F.replace(found, F.lit(" "), F.lit(""))) <= 2) | plist,
        ("ethereum_address",): F.startswith(F.substring(found, 3, 100), F.lit("0" * 24)),
        ("bitcoin_address",): (F.length(found) < 26) | F.substring(found, 2, 200).rlike(r"^[0-9a-fA-F]+$") | lower.isin(*C.IDENTIFIER_COLUMNS),
        ("us_routing", "us_routing_number", "cusip", "south_korean_rrn"): (F.length(digits) > 0) & ((distinct(digits) <= 2) | plist),
        ("ripple", "litecoin"): distinct(found) <= 2,
        ("dea_number",): plist,
        ("url_credentials",): F.contains(found, F.lit("apple.com")),
    }
    out = F.contains(found, F.lit("[REDACTED")) | F.contains(found, F.lit("REDACTED_"))
    for part in C.SYSTEM_PATHS:
        out = out | F.contains(path, F.lit(part))
    for names, rule in rules.items():
        out = out | (name.isin(*names) & rule)
    return F.coalesce(out, F.lit(False))
