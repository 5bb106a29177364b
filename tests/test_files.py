"""Files that queries write: few of them, with all that is in the tables."""

from pathlib import Path

from etherloom.plans import files


def test_addresses_share_files(spark):
    found = files.capture_files(spark, "/root/testdata/sf0.001")
    folder = Path(found.inputFiles()[0].removeprefix("file://")).parent
    assert len(list(folder.glob("part-*"))) < found.select("mac").distinct().count() / 4
