"""Every query runs where only the driver can import this package."""

import os
import subprocess
import sys

SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {shared!r}).getOrCreate()
import __spark_entry__ as entry
found = spark.range(1).mapInPandas(lambda parts: (p.assign(id=any({repo!r} in x for x in sys.path)) for p in parts), "id boolean").first()[0]
print("PATH", found)
for name, run in entry.queries().items():
    if name.startswith("op") or name == "pipeline":
        print("DONE", name, run(spark, "/root/testdata/sf0.001").count() > 0, flush=True)
"""


def test_queries_without_the_package_on_executors(tmp_path):
    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    script = SCRIPT.format(repo=repo, shared=str(tmp_path / "shared"))
    out = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    lines = [x for x in out.stdout.splitlines() if x.startswith(("DONE", "PATH"))]
    assert out.returncode == 0, out.stderr[-3000:]
    assert lines[0] == "PATH False"
    assert len(lines) == 15 and all(x.endswith("True") for x in lines[1:])
