import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from sightline.functions import dates, numbers, plates
from sightline.sources import files


def value(spark, column):
    return spark.range(1).select(column.alias("v")).collect()[0]["v"]


@pytest.mark.parametrize(
    ("text", "key"),
    [("۱۲ ب ۳۴۵ - ۶۷", "12ب34567"), ("IRAN 12الف34567", "12ا34567"), ("ایران۱۲ي۳۴۵۶۷", "12ی34567"), (None, ""), ("12-b-34567", "12B34567"), ("آ", "ا")],
)
def test_normalize(spark, text, key):
    assert value(spark, plates.normalize_plate(F.lit(text).cast("string"))) == key


@pytest.mark.parametrize(
    ("text", "reason"),
    [("", "empty"), ("12ب34567", "ok"), ("１２ب34567", "ok"), ("12ب34505", "invalid_province"), ("00ب34567", "zero_serial"), ("12ب00067", "zero_serial"), ("12d34567", "ok"), ("12IR34567", "invalid_structure"), ("I.R.A.N 12ب34567", "ok")],
)
def test_validate(spark, text, reason):
    assert value(spark, plates.validate_v2(F.lit(text)))["reason"] == reason


def test_jalali_days(spark):
    known = {dt.date(2024, 3, 20): (1403, 1, 1), dt.date(2024, 3, 19): (1402, 12, 29), dt.date(2021, 3, 20): (1399, 12, 30), dt.date(1979, 2, 11): (1357, 11, 22)}
    for day, want in known.items():
        assert tuple(value(spark, dates.to_jalali(F.lit(day)))) == want
    days = spark.range(13149).select(F.date_add(F.lit(dt.date(2000, 1, 1)), F.col("id").cast("int")).alias("d"))
    j = dates.to_jalali(F.col("d"))
    assert days.where(dates.from_jalali(j["year"], j["month"], j["day"]) != F.col("d")).count() == 0
    assert value(spark, dates.from_jalali(F.lit(1402), F.lit(12), F.lit(30))) is None


def test_wilson(spark):
    low, high = value(spark, numbers.wilson(F.lit(99), F.lit(100)))
    assert (round(low, 4), round(high, 4)) == (0.9455, 0.9982)
    assert tuple(value(spark, numbers.wilson(F.lit(5), F.lit(0)))) == (0.0, 1.0)
    assert tuple(value(spark, numbers.wilson(F.lit(5), F.lit(3)))) == (0.0, 1.0)


def test_combined_confidence(spark):
    assert value(spark, numbers.combined_confidence(F.lit(0.9), F.lit(0.8), F.lit(0.5), F.lit(True))) == pytest.approx(0.884)
    assert value(spark, numbers.combined_confidence(F.lit(0.5), F.lit(0.5), F.lit(0.5), F.lit(False))) == pytest.approx(0.31)


def test_identifiers_and_cells(spark):
    assert value(spark, plates.is_identifier(F.lit("a-1"))) and not value(spark, plates.is_identifier(F.lit(" a")))
    assert not value(spark, plates.is_identifier(F.lit("a\nb"))) and not value(spark, plates.is_identifier(F.lit("")))
    for cell in ("=1", "+1", "-1", "@x", "\t=1", "  =1"):
        assert value(spark, plates.csv_safe(F.lit(cell))).startswith("'")
    assert value(spark, plates.csv_safe(F.lit("12-3"))) == "12-3"


def test_manifest(spark, tmp_path):
    (tmp_path / "m.csv").write_text("image_path,plate_text,group_id,source_license,usage\na.jpg,12ب34567,g1,cc,train\n,x,g1,cc,train\n")
    good, bad = files.read_manifest(spark, str(tmp_path / "m.csv"), files.CROPS, ["image_path", "plate_text"])
    assert good.count() == 1 and [r.reason for r in bad.collect()] == ["missing:image_path"]
    (tmp_path / "n.csv").write_text("image_path\na\n")
    with pytest.raises(ValueError, match="plate_text"):
        files.read_manifest(spark, str(tmp_path / "n.csv"), files.CROPS, [])


def test_labels_traces_voc(spark, tmp_path):
    assert value(spark, files.labels(F.lit(" Night|day||DAY "))) == ["day", "night"]
    track = {"track_id": "t", "split": "train", "profile": "day", "expected_plate": "p", "observations": [{"seq": 1, "ts": 0.1, "text": "p", "confidence": 0.9, "quality": 0.8, "valid": True}]}
    (tmp_path / "t.json").write_text(json.dumps({"tracks": [track], "extra": 1}))
    rows, unknown = files.read_traces(spark, str(tmp_path / "t.json"))
    assert rows.count() == 1 and [r.unknown for r in unknown.collect()] == ["extra"]
    box = "<bndbox><xmin>1</xmin><ymin>2</ymin><xmax>3</xmax><ymax>4</ymax></bndbox>"
    (tmp_path / "a.xml").write_text(f"<annotation><filename>a.jpg</filename><object><name>plate</name>{box}</object><object><name>x</name>{box}</object></annotation>")
    assert files.read_voc(spark, str(tmp_path / "a.xml")).count() == 2
    assert files.inventory(spark, str(tmp_path), "*.xml").count() == 1


def test_export_and_publish(spark, tmp_path):
    rows = spark.range(10).select("id", F.concat(F.lit("="), "id").alias("cell"))
    files.write_export(rows, ["id", "cell"], str(tmp_path / "out"), max_rows=4)
    text = "".join(p.read_text(encoding="utf-8") for p in (tmp_path / "out").glob("part*"))
    assert text.startswith('"﻿id"') or text.startswith("﻿") and "'=9" in text
    assert "export truncated" in text and "'=9" in text and "'=3" not in text
    assert files.publish(rows, str(tmp_path / "snap"))["rows"] == 10
    with pytest.raises(Exception, match="ALREADY_EXISTS"):
        files.publish(rows, str(tmp_path / "snap"))


def test_grid_drops_what_is_not_valid():
    from sightline.operators.joins import grid

    assert grid({"a": [1, 2, 2], "b": [1, 3]}, valid=lambda o: o["a"] <= o["b"]) == [{"a": 1, "b": 1}, {"a": 1, "b": 3}, {"a": 2, "b": 3}]
    with pytest.raises(ValueError):
        grid({"a": list(range(9))}, most=8)


def test_registry_refuses_a_name_twice():
    from sightline.plans import registry

    registry.query("only-in-this-test", "SELECT 1")(lambda spark, d: None)
    with pytest.raises(ValueError):
        registry.query("only-in-this-test")(lambda spark, d: None)
    assert registry.ORACLE_SQL.pop("only-in-this-test") and registry.QUERIES.pop("only-in-this-test")
