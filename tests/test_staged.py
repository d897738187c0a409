"""One scan for all outputs."""

from __future__ import annotations

import pytest

from veilspan.plans import staged
from veilspan.plans.scan import scan_directory, scan_errors, scan_status, write_reports
from veilspan.plans.staged import NotStaged, stage_scan, staged_scan
from veilspan.sources.reports import read_detailed, read_summary


@pytest.fixture
def root(tmp_path):
    folder = tmp_path / "in"
    (folder / "sub").mkdir(parents=True)
    (folder / "a.txt").write_text("a@site.org and +7 916 123-45-67")
    (folder / "none.txt").write_text("nothing")
    (folder / "blank.md").write_text(" ")
    (folder / "empty.csv").write_text("")
    (folder / "sub" / "_t.csv").write_text("b@site.org\nc@site.org\n")
    (folder / "sub" / "p.HTML").write_text("<p title='>'>d@site.org")
    (folder / "x.json").write_text('[{"m": "e@site.org"}, 5]')
    (folder / "bad.parquet").write_text("no table")
    (folder / "photo.png").write_bytes(b"\x89")
    (folder / "notes.rtf").write_bytes(b"x")
    return folder


def rows(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


def test_outputs_equal_those_of_separate_scans(spark, root, tmp_path):
    out = stage_scan(spark, str(root), str(tmp_path / "stage"))
    assert rows(out.profile()) == rows(scan_directory(spark, str(root))) and out.profile().count() == 4
    assert rows(out.status()) == rows(scan_status(spark, str(root))) and out.status().count() == 10
    assert rows(out.errors()) == rows(scan_errors(spark, str(root))) and out.errors().count() == 1
    write_reports(scan_directory(spark, str(root)), str(tmp_path / "s1"), str(tmp_path / "d1"))
    out.write_reports(str(tmp_path / "s2"), str(tmp_path / "d2"))
    assert rows(read_summary(spark, str(tmp_path / "s1"))) == rows(read_summary(spark, str(tmp_path / "s2")))
    assert rows(read_detailed(spark, str(tmp_path / "d1"))) == rows(read_detailed(spark, str(tmp_path / "d2")))


def test_no_output_reads_content(spark, root, tmp_path):
    """Outputs come alike after the files are gone, in another session's view, and their plans open no file."""
    stage_scan(spark, str(root), str(tmp_path / "stage"), categories=["email", "phone"])
    for f in [*root.rglob("*.*")]:
        f.write_bytes(b"changed@site.org " * 9)
    out = staged_scan(spark.newSession(), str(tmp_path / "stage"))
    assert out.categories == ("phone", "email")
    assert {r["name"]: r["pii_counts"] for r in out.profile().collect()} == {
        "a.txt": {"phone": 1, "email": 1}, "_t.csv": {"email": 2}, "p.HTML": {"email": 1}, "x.json": {"email": 1},
    }
    for df in (out.profile(), out.status(), out.errors()):
        assert "MapInArrow" not in df._jdf.queryExecution().executedPlan().toString()


def test_content_is_scanned_once(spark, root, tmp_path, monkeypatch):
    """The job that writes the table opens each piece once: two disjoint reads, and one of Parquet files."""
    plans = []

    def noted(whole, parts, *rest):
        plans.extend(df._jdf.queryExecution().optimizedPlan().toString() for df in (whole, parts))
        return counts(whole, parts, *rest)

    counts = staged.counts_of_files
    monkeypatch.setattr(staged, "counts_of_files", noted)
    stage_scan(spark, str(root), str(tmp_path / "stage"))
    assert [p.count("MapInArrow _read(") for p in plans] == [1, 1] and [p.count("MapInArrow _row_groups(") for p in plans] == [0, 1]


def test_a_run_that_failed_is_not_taken_for_a_whole_one(spark, root, tmp_path, monkeypatch):
    folder = str(tmp_path / "stage")
    with pytest.raises(NotStaged):
        staged_scan(spark, folder)
    stage_scan(spark, str(root), folder)
    monkeypatch.setattr(staged, "counts_of_files", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        stage_scan(spark, str(root), folder)
    with pytest.raises(NotStaged):
        staged_scan(spark, folder)
    monkeypatch.undo()
    assert stage_scan(spark, str(root), folder).profile().count() == 4


def test_empty_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    out = stage_scan(spark, str(tmp_path / "in"), str(tmp_path / "stage"))
    assert out.profile().count() == out.status().count() == out.errors().count() == 0
