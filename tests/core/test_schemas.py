from colophon import schemas


def test_schemas_and_migration(spark, tmp_path):
    assert len(schemas.FORMATS) == 34
    works = schemas.schema("works")
    assert works["id"].dataType.typeName() == "string" and not works["id"].nullable and works["state_cursor"].nullable
    made = schemas.migrate(spark, str(tmp_path))
    assert sorted(made) == sorted(schemas.FORMATS) and schemas.migrate(spark, str(tmp_path)) == []
    assert spark.read.schema(works).parquet(f"{tmp_path}/works").columns == works.fieldNames()
    rows = spark.createDataFrame([("m", None, "x", "y", "z", None)], "id string, from_ids array<string>, into_id string, evidence string, event_id string, performed_by string")
    assert schemas.violations(rows, "identity_merges").first()["violation"] == "from_ids"
