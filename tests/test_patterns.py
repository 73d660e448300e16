"""Each detector: what it has to find, and near misses. Built from parts, so that no real-looking secret stands here."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from veilspark.functions import catalog as C
from veilspark.functions.policy import listing, select
from veilspark.operators.detection import count_matches

A = "A1b2C3d4E5f6G7h8I9j0K1l2M3n4O5p6Q7r8S9t0"
HEX = "0123456789abcdef" * 4
BASE58 = "abcdefghijkmnopqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ123456789abcdefghijkmnopqrstuvwxyzABCDEFGHJKLMNPQ"
CASES = [
    ("email", "to jo.doe+x@mail.example.org now", "to jo.doe@localhost now"),
    ("phone_us", "call (415) 555-2671 x", "call 115-555-2671"),
    ("phone_intl", "+44 20 7946 0958", "+999 20 7946 0958"),
    ("ssn", "id 123-45-6789.", "id 000-45-6789, 666-45-6789, 923-45-6789"),
    ("uk_nin", "AB 12 34 56 C", "GB 12 34 56 C"),
    ("indian_pan", "ABCDE1234F", "ABCD1234F"),
    ("indian_aadhaar", "1234 5678 9012", "123456789012"),
    ("us_itin", "912-78-1234", "912-68-1234"),
    ("brazilian_cpf", "123.456.789-09", "123.456.789.09"),
    ("mexican_curp", "ABCD010203HDFXYZ09", "ABCD010203XDFXYZ09"),
    ("south_korean_rrn", "900101-1234567", "900101-5234567"),
    ("sin_tfn", "123-456-789", "123456789"),
    ("imei", "35-209900-176148-1", "35-2099-176148-1"),
    ("imsi", "310150123456789", "3101501234567"),
    ("device_name", "Lars's iPhone", "Lars iPhone"),
    ("apple_id", "me.x@icloud.com", "me.x@cloud.com"),
    ("gps_coord", "at 37.7749 deg", "at 37.774 deg"),
    ("ip_v4", "from 8.8.4.4 x", "from 127.0.0.1 and 0.1.2.3"),
    ("ip_v6", "at 2001:db8::1 x", "at 12:34 x"),
    ("mac_addr", "aa:bb:cc:dd:ee:ff", "aa:bb:cc:dd:ee"),
    ("credit_card", "4012 8888 8888 1881", "9012 8888 8888 1881"),
    ("iban", "DE89370400440532013000", "D189370400440532013000"),
    ("swift_bic", "DEUTDEFF500", "DEUTDEF"),
    ("us_ein", "12-3456789", "12-345678"),
    ("us_routing", "021000021", "991000021"),
    ("cusip", "037833100", "03783310"),
    ("isin", "US0378331005", "US037833100"),
    ("jwt_token", "eyJ" + A[:12] + ".eyJ" + A[:12] + "." + A[:12], "eyJ" + A[:5] + ".eyJ" + A[:12]),
    ("aws_access_key", "AKIA" + "ABCDEFGH12345678", "AKIB" + "ABCDEFGH12345678"),
    ("github_token", "ghp_" + A[:36], "ghp_" + A[:30]),
    ("gitlab_token", "glpat-" + A[:20], "glpat-" + A[:10]),
    ("slack_token", "xoxb-" + "1234567890", "xoxz-" + "1234567890"),
    ("stripe_key", "sk_live_" + A[:24], "sk_dev_" + A[:24]),
    ("openai_key", "sk-" + A[:24], "sk-" + A[:10]),
    ("twilio_sid", "AC" + HEX[:32], "AC" + HEX[:30]),
    ("sendgrid_key", "SG." + A[:22] + "." + (A + A)[:43], "SG." + A[:22]),
    ("npm_token", "npm_" + A[:36], "npm_" + A[:20]),
    ("pypi_token", "pypi-" + (A + A)[:50], "pypi-" + A[:30]),
    ("docker_token", "dckr_pat_" + A[:20], "dckr_pat_" + A[:10]),
    ("digitalocean_token", "dop_v1_" + HEX, "dop_v1_" + HEX[:60]),
    ("shopify_token", "shpat_" + HEX[:32], "shpxx_" + HEX[:32]),
    ("telegram_bot", "123456789:" + A[:35], "123456789:" + A[:20]),
    ("generic_api_key", "pk-prod-" + A[:20], "pk-dev-" + A[:20]),
    ("url_credentials", "https://u:p@example.org/x", "https://example.org/x"),
    ("private_key_header", "-----BEGIN " + "RSA PRIVATE KEY-----", "-----BEGIN PUBLIC KEY-----"),
    ("bitcoin_address", "1" + BASE58[:30], "1" + BASE58[:10]),
    ("ethereum_address", "0x" + HEX[:40], "0x" + HEX[:39]),
    ("litecoin", "L" + BASE58[:30], "K" + BASE58[:30]),
    ("ripple", "r" + BASE58[:30], "r" + BASE58[:10]),
    ("monero", "4A" + BASE58[:93], "4A" + BASE58[:80]),
    ("cardano", "addr1" + HEX[:60], "addr1" + HEX[:20]),
    ("dea_number", "AB1234567", "IB1234567"),
    ("medicare_mbi", "1EG4TE5MK72", "1E44TE5MK7"),
    ("vin", "1HGCM82633A004352", "1HGCM82633I004352"),
    ("solana", "wallet " + BASE58[:40], "thing " + BASE58[:40]),
    ("ndc", "drug 0777-3105-02", "item 0777-3105-02"),
    ("uk_plate", "plate AB12 CDE", "thing AB12 CDE"),
    ("us_passport", "passport C123456789", "pass C123456789"),
    ("drivers_license", "driver D1234567", "thing D1234567"),
    ("canadian_sin", "canadian 123-456-789", "thing 123-456-789"),
    ("australian_tfn", "tax file 123 456 789", "thing 123 456 789"),
    ("us_routing_number", "bank 123456789", "thing 123456789"),
    ("date_of_birth", "DOB: 1990-01-31", "DOB: soon"),
    ("password_kv", "Password = hunter2", "Password hunter2"),
    ("aws_secret_key", "secret " + A, "thing " + A),
]


@pytest.mark.parametrize("name", ["all"])
def test_every_detector_finds_and_misses(spark, name):
    rows = [(i, hit, miss) for i, (_, hit, miss) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "i int, hit string, miss string")
    detector = {n: next(d for d in reversed(C.DETECTORS) if d.name == n) for n, _, _ in CASES}
    for i, (n, _, _) in enumerate(CASES):
        got = df.where(F.col("i") == i).select(count_matches(F.col("hit"), detector[n]).alias("hit"), count_matches(F.col("miss"), detector[n]).alias("miss")).first()
        assert got.hit >= 1 and got.miss == 0, n


def test_patterns_compile_alike():
    for d in C.DETECTORS:
        re.compile(d.pattern, re.I if d.ignore_case else 0)
    assert len(C.DETECTORS) == 68 and len({d.name for d in C.DETECTORS}) == 67


def test_gate_stops_beyond_its_window(spark):
    d = next(d for d in C.DETECTORS if d.name == "us_passport")
    df = spark.createDataFrame([("passport" + " " * 112 + "123456789",), ("passport" + " " * 113 + "123456789",)], "t string")
    assert [r.n for r in df.select(count_matches(F.col("t"), d).alias("n")).collect()] == [1, 0]


def test_selectors():
    everything = {d.name for d in C.DETECTORS}
    assert {d.name for d in select().detectors} == everything
    with pytest.raises(ValueError):
        select(only=["email"], skip=["ssn"])
    with pytest.raises(ValueError):
        select(only=["nothing"])
    with pytest.raises(ValueError):
        select(skip=[""])
    assert [d.name for d in select(only=["email"]).detectors] == ["email"]
    financial = select(only=["financial"])
    assert len(financial.gated) == 9 and all(d.category in ("financial", "context") for d in financial.detectors)
    mixed = select(only=["financial", "password_kv"])
    assert [d.name for d in mixed.gated] == ["password_kv"] and "card_number" in mixed.columns and "email" not in mixed.columns
    skipped = select(skip=["crypto", "npi"])
    assert not {"npi", "monero", "solana"} & {d.name for d in skipped.detectors} and "email" in skipped.columns
    assert len(listing()) == 68
