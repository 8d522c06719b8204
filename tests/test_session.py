import os
from types import SimpleNamespace

import pytest

from wattshift import session as se


def test_scratch_lives_in_the_run_folder_and_goes(spark):
    path = se.scratch_path(spark, "x")
    spark.range(3).write.parquet(path)
    local = se.run_dir(spark).removeprefix("file:")
    assert os.path.isdir(path.removeprefix("file:")) and path.startswith(se.run_dir(spark))
    se.clean_up(spark)
    assert not os.path.exists(local)


def test_no_machine_local_folder_on_a_cluster():
    none = SimpleNamespace(isDefined=lambda: False)
    context = SimpleNamespace(master="local-cluster[2,1,512]", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: none)))
    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=context)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        se.shared_dir(cluster)
