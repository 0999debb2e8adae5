"""The shared folder with and without a setting, in a process without Spark defaults."""

import os
import subprocess
import sys
from pathlib import Path

PROGRAM = """
import sys
from tidemark.session import local_session, materialise, release, shared_folder

spark = local_session(cpus="2", partitions="2", memory="1g")
first = shared_folder(spark)
assert first and first == shared_folder(spark)
assert sorted(r.id for r in materialise(spark.range(5)).collect()) == [0, 1, 2, 3, 4]
assert release(spark) and not release(spark)
spark.sparkContext.setCheckpointDir(sys.argv[1])
assert shared_folder(spark).removeprefix("file:").startswith(sys.argv[1])
"""


def test_folder_without_defaults(tmp_path):
    (tmp_path / "conf").mkdir()
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path / "conf"), "PYTHONPATH": str(Path(__file__).resolve().parents[1])}
    done = subprocess.run([sys.executable, "-c", PROGRAM, str(tmp_path / "shared")], env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
