"""Workers find the package wherever the driver was started."""

import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent

CODE = f"""
import sys
sys.path.insert(0, {str(REPO)!r})
import __spark_entry__ as entry
from semblance.session import local_session
spark = local_session(2, 2)
print("ANSWER", entry.queries()["k_anonymity"](spark, "/root/testdata/sf0.001").count())
"""


def test_from_another_directory(tmp_path):
    done = subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert "ANSWER 1" in done.stdout, done.stderr[-2000:]
