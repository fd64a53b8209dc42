from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from factloom.functions.identity import Registry
from factloom.operators import reports

ME = Registry("Zoé Doe", ("zoe",), {"whatsapp": ("+961 70 123 456", "Zoe D"), "instagram": ("zoe.doe",)})


@pytest.mark.parametrize(("platform", "sender", "want"), [("whatsapp", "96170123456:2@c.us", True), ("whatsapp", " Zoe D ", True), ("whatsapp", "zoe.doe", False), ("instagram", "zoe.doe", True), ("instagram", "96170123456", False), ("other", "zoe.doe", False), ("whatsapp", None, False)])
def test_identities_count_on_their_platform(spark, platform, sender, want):
    df = spark.createDataFrame([(platform, sender)], "p string, s string")
    assert df.select(ME.is_self(F.col("p"), F.col("s")).alias("v")).first().v is want


@pytest.mark.parametrize(("name", "want"), [("ZOÉ DOE", True), ("Zoé Doe", True), ("zoe.doe", True), ("Zoe", True), ("", False), ("Ann", False)])
def test_own_names(spark, name, want):
    assert spark.createDataFrame([(name,)], "s string").select(ME.is_self_name(F.col("s")).alias("v")).first().v is want


def test_configuration_problems():
    assert ME.problems() == [] and len(Registry("x").problems()) == 2


def test_spot_check(spark, tmp_path):
    doc = {"self_name": "me", "contact_name": "a", "now": "2024-02-01T00:10:00Z", "messages": [{"sender": "a", "at": "2024-02-01T00:00:00Z"}, {"sender": "me", "at": "2024-02-01T00:01:00Z"}]}
    (tmp_path / "m.json").write_text(json.dumps(doc))
    (row,) = reports.spot_check(spark, str(tmp_path / "m.json")).collect()
    assert (row.contact_id, row.frequency, row.reply_speed) == ("a", 1.0, 60.0)
