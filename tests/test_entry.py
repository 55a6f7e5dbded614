"""The driver contract works in a plain session (no halyard options)."""

import subprocess
import sys
import os

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = """
import sys
sys.path.insert(0, %r)
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "4").getOrCreate())
import __spark_entry__ as E
df = E.entry(spark)
rows = df.collect()
print("ROWS", len(rows), len(df.columns))
q = E.queries()
for key in ["dashboard_stats", "surrogate_ids", "reminder_digest", "change_stream"]:
    print("KEY", key, q[key](spark, "/root/testdata/sf0.001").count())
""" % ROOT


def test_entry_in_plain_session():
    out = subprocess.run([sys.executable, "-c", SCRIPT], capture_output=True, text=True,
                         timeout=600)
    assert out.returncode == 0, out.stderr[-3000:]
    assert "ROWS 5 14" in out.stdout
    assert out.stdout.count("KEY ") == 4
