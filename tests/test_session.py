import os

import pytest
from riskmill.session import drop_scratch, scratch_path


def test_scratch_tables_can_be_dropped_and_nothing_else(spark, tmp_path):
    path = scratch_path(spark, "gone")
    spark.range(5).write.parquet(path)
    assert os.path.isdir(path)
    drop_scratch(spark, path)
    assert not os.path.exists(path)
    with pytest.raises(ValueError):
        drop_scratch(spark, str(tmp_path))
    assert tmp_path.is_dir()
