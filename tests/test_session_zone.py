"""Results do not depend on the session time zone or on halyard's session
options: every query, run in a plain session set to a zone with daylight
saving, with ANSI mode off and Spark's default 200 shuffle partitions, still
equals the oracle."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = """
import sys
sys.path.insert(0, %r)
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.sql.session.timeZone", "America/New_York")
         .config("spark.sql.ansi.enabled", "false").getOrCreate())
import __spark_entry__ as E
from tests.oracle_compare import compare, duck_connect
sf = "/root/testdata/sf0.001"
con = duck_connect(sf)
q, s = E.QUERIES, {k: E.with_views(v) for k, v in E.SQL.items()}
for key in sorted(q):
    problems, n, m, _ = compare(spark, con, key, q[key], s[key], sf)
    print("KEY", key, "OK" if not problems else problems)
""" % ROOT


def test_other_session_zone():
    out = subprocess.run([sys.executable, "-c", SCRIPT], capture_output=True, text=True,
                         timeout=900, cwd=ROOT)
    assert out.returncode == 0, out.stderr[-3000:]
    lines = [ln for ln in out.stdout.splitlines() if ln.startswith("KEY ")]
    assert len(lines) == 81
    bad = [ln for ln in lines if not ln.endswith(" OK")]
    assert not bad, bad
