"""Workers that cannot import the package run every operator."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
CODE = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
def there(_):
    try:
        import graphloom
        return "there"
    except ImportError:
        return "hidden"
assert spark.sparkContext.parallelize([0], 1).map(there).collect() == ["hidden"]
from graphloom.llm import classifier, decontaminate, licences, line_quality, mixing, neardup, repeats, secrets, token_bin, token_counts
text = " ".join(f"word{{i}}" for i in range(70))
rows = [(i, text + (f" own{{i}}" if i % 2 else ""), "en", "s" if i % 3 else "t") for i in range(12)]
docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
items = spark.createDataFrame([(1, text[:60])], "item_id long, text string")
labels = spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(12)], "doc_id long, quality int, toxic int")
print(
    "ROWS",
    mixing.mixture(docs).count(), mixing.mixed(docs).count() > 0, repeats.repeated_passages(docs).count(), line_quality.clean_lines(docs).count() >= 0,
    token_counts.token_counts(docs).count(), licences.licence_matches(docs).count(), decontaminate.contaminated(docs, items).count(),
    neardup.near_duplicates(docs).count(), secrets.secrets(docs).count(), classifier.classified(docs, labels).count(), token_bin.write_tokens(docs).count(),
)
spark.stop()
"""


def test_all_operators(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", CODE.format(repo=REPO)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert "ROWS 12 True 12 True 12 0 12 12 0 12 12" in out.stdout, out.stdout + out.stderr[-3000:]
