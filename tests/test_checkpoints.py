"""What cutting lineage leaves behind."""

import tempfile
import time
from pathlib import Path

from mosaiq.checkpoints import CLEANUP, cut


def test_shuffle_files_go_when_a_table_is_cut(spark):
    root = Path(spark.conf.get("spark.local.dir", tempfile.gettempdir()))
    seen = lambda: set(root.glob("**/blockmgr-*/*/shuffle_*.data"))
    before, setting = seen(), spark.conf.get(CLEANUP, None)
    done = cut(spark.range(20_000).repartition(7).groupBy("id").count())
    # Spark deletes them in the background
    for _ in range(100):
        if not seen() - before:
            break
        time.sleep(0.1)
    assert not seen() - before
    assert spark.conf.get(CLEANUP, None) == setting
    assert done.count() == 20_000
