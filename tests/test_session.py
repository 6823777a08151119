import subprocess
import sys
from pathlib import Path

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.checkpoint.dir", {folder!r}).getOrCreate())
from riskloom.session import materialize, work_dir
df = materialize(spark.range(10), "probe")
print("RESULT", work_dir(spark) == {folder!r}, df.inputFiles()[0].startswith("file://" + {folder!r}), df.count())
"""


def test_intermediate_tables_go_to_the_named_folder(tmp_path):
    """Run outside the repository folder, as a cluster job would."""
    root = str(Path(__file__).resolve().parents[1])
    script = SCRIPT.format(root=root, folder=str(tmp_path / "shared"))
    done = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, cwd=tmp_path, timeout=120)
    assert "RESULT True True 10" in done.stdout, done.stderr[-2000:]
