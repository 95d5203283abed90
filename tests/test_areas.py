"""Folders of a corpus that hold scripts or declarations but no source."""

from hearthline.operators import corpus
from hearthline.sources import tables


def test_areas_without_source(spark, tmp_path):
    files = ["A/CWE1.bat", "A/s01/CWE1__x_01.c", "B/CWE2.bat", "C/testcases.h", "C/s01/main.cpp", "D/CWE4.bat", "D/s01/CWE4__x_81.h", "E/s01/E.bat", "E/s02/F.bat", "CWE9__x_01.c", "G/CWE5__x.c.txt"]
    for f in files:
        at = tmp_path / "cases" / f
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text("x")
    listed = tables.listing(spark, str(tmp_path))
    assert listed.count() == len(files) and tables.listing(spark, str(tmp_path), "*.bat").count() == 5
    got = {tuple(r) for r in corpus.areas_without_source(listed, f"{tmp_path}/cases").collect()}
    assert got == {("B", 1, 1), ("C", 2, 0), ("E", 2, 2), ("G", 1, 0)}
    assert corpus.areas_without_source(listed.where("path IS NULL"), "/cases").collect() == []
