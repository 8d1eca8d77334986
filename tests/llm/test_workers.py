"""Every query of this subpackage and the pipeline on workers that cannot import the package."""

import os
import subprocess
import sys

RUN = """
import sys
sys.path.insert(0, {root!r})
import __spark_entry__ as entry
from certflume.session import local_session

spark = local_session(4, 4, "4g")
# What workers find is what they would find on a machine without the package.
found = spark.range(4).mapInArrow(lambda batches: (b for b in batches if not __import__("importlib").util.find_spec("certflume")), "id long").count()
assert found == 4, "workers can import the package"
for name in sorted(n for n in entry.queries() if n.startswith("op") and n[2].isdigit() or n == "pipeline"):
    rows = entry.queries()[name](spark, {folder!r}).count()
    print(name, rows, flush=True)
    assert rows > 0
"""


def test_queries_without_the_package_on_workers(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    env.pop("SPARK_HOME", None)
    done = subprocess.run([sys.executable, "-c", RUN.format(root=root, folder="/root/testdata/sf0.001")], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert done.returncode == 0, done.stdout + done.stderr[-3000:]
    assert len(done.stdout.split()) >= 28
