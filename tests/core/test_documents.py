"""Files of one document each, from a table whose groups are many more than the tasks that write them."""

import pytest

from colophon import plans


@pytest.mark.parametrize("name", ["saved_responses", "scan_json_dict", "scan_json_list"])
def test_no_document_is_lost_where_tasks_write_several(spark, tmp_path, name):
    part = spark.range(60_000).selectExpr("id AS p_partkey", "concat('title ', id % 64) AS p_name", "concat('type ', id % 5) AS p_type")
    part.repartition(4).write.parquet(str(tmp_path / "part.parquet"))
    rows = plans.QUERIES[name](spark, str(tmp_path))
    key = "key" if name == "scan_json_dict" else "id"
    got = rows.selectExpr("count(*) n", f"count(DISTINCT {key}) d", f"count_if(preferred_title = concat('title ', CAST(substring({key}, 2) AS BIGINT) % 64)) same").first()
    assert tuple(got) == (60_000, 60_000, 60_000)
