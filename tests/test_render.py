"""Result formats hold every row."""

import json

import pytest

from lathe.sources import files


@pytest.mark.parametrize("form", ["csv", "markdown", "html", "table"])
def test_all_rows(spark, form):
    text = files.render(spark.range(2500).selectExpr("concat('row', id) AS k"), form)
    assert text.count("row") - (form == "table") == 2500
    assert form != "table" or text.endswith("(2500 rows)")


def test_json(spark):
    rows = spark.range(2500)
    assert json.loads(files.render(rows, "json")) == [{"id": str(i)} for i in range(2500)]
    assert json.loads(files.render(rows.limit(0), "json")) == [] and len(json.loads(files.render(rows, "json", 3))) == 3
