"""Pieces of long files give what whole files give."""

from __future__ import annotations

import json
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from veilspan.operators.detect import findings
from veilspan.plans.scan import findings_of, scan_directory, scan_errors, scan_status
from veilspan.sources import contents as contents_module
from veilspan.sources.contents import contents, text_of
from veilspan.sources.directory import Directory
from veilspan.sources.formats import csv_records, decoded, json_texts
from veilspan.sources.listing import expanded, family, list_files
from veilspan.sources.ranges import SAFE, pieces, split_bytes
from veilspan.sources.tables import csv_rows, json_records, parquet_rows_any_schema

WIDTHS = (16, 37, 64, 200)


def csv_body(rng):
    parts = ["a", "bc", ",", ",", "\n", "\r\n", '"', '""', '"x"', ',"', '",', '"\n', ' "', "'", "д", '"q\nr"', '"""", ']
    return "".join(rng.choice(parts) for _ in range(rng.randrange(5, 160))).encode()


def json_value(rng, depth=0):
    kind = rng.randrange(7 if depth < 3 else 4)
    if kind < 4:
        return [rng.randrange(10**9), rng.choice(["", "x\"y", "a\\", "\\\\\"", "},{", "д[", "a,b\n", "]"]), None, 1.5][kind]
    if kind == 4:
        return [json_value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {f"k{i}{rng.choice(['', chr(92), chr(34)])}": json_value(rng, depth + 1) for i in range(rng.randrange(4))}


def json_body(rng):
    values = [json_value(rng) for _ in range(rng.randrange(1, 25))]
    kind = rng.randrange(4)
    if kind == 0:
        return (" \n" * rng.randrange(2) + json.dumps(values, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1])) + "\n" * rng.randrange(40)).encode()
    if kind == 1:
        return "\n".join(json.dumps(v, ensure_ascii=False) for v in values).encode()
    if kind == 2:
        return "".join(json.dumps(v) + rng.choice([" ", "\n"]) for v in values if isinstance(v, (dict, list))).encode()
    return json.dumps({"rows": values, "n": "top"}).encode()


WORDS = (
    "слово Орлов Андрей Ильич, ; тел. +7 (903) 412-55-67. one two a.b@site.org, 4510 654321 ИНН: 500100732259 г. Тверь ул. Мира, диагноз "
    "радужная оболочка 05.03.1987 4539 1488 0343 6467 ! ? « » \n \r\n three four БИК 044525225 112-233-445 95 \t x@y.zz <b> паспорт дом"
).split(" ")


def text_body(rng):
    text = " ".join(rng.choice(WORDS) for _ in range(rng.randrange(3, 150)))
    return rng.choice([text.encode(), text.encode("cp1251", "replace"), text.encode("cp1251", "replace") + b"\x98", text.replace("\n", "\r").encode() + "€".encode()])


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("ranges")
    rng = random.Random(11)
    for kind, make in (("csv", csv_body), ("json", json_body), ("txt", text_body)):
        for k in range(60):
            (root / f"{k}.{kind}").write_bytes(make(rng))
    (root / "runs.csv").write_bytes(b'a,"' + b'"' * 900 + b'\nb",c\nd,' + b'"' * 901 + b"\n" + b"e\n" * 60)
    (root / "slashes.json").write_bytes(b'[["' + b"\\" * 900 + b'"],["' + b"\\" * 902 + b'\\"]"],' + b"1," * 60 + b"2]")
    (root / "one.csv").write_bytes(b"x" * 3000)
    return root


def read_back(rows):
    """Pieces by file in order, and their bytes."""
    found = defaultdict(list)
    for r in rows:
        found[r["path"].removeprefix("file:")].append(r)
    for path, parts in found.items():
        parts.sort(key=lambda r: r["begin"])
        with open(path, "rb") as f:
            whole = f.read()
        assert [r["begin"] for r in parts] == [0, *(r["end"] for r in parts[:-1])] and parts[-1]["end"] == len(whole)
        yield path, whole, parts, [whole[r["begin"] : r["end"]] for r in parts]


@pytest.mark.parametrize("width", WIDTHS)
def test_pieces_give_what_the_file_gives(spark, folder, width):
    files = list_files(spark, str(folder)).selectExpr("path", "size", "mtime", f"{family('path')} as family")
    cut = defaultdict(int)
    for path, whole, parts, bodies in read_back(pieces(files, width).collect()):
        kind = path.rpartition(".")[2]
        cut[kind] += len(parts) - 1
        if kind == "csv":
            assert [r for b in bodies for r in csv_records(b).to_pylist()] == csv_records(whole).to_pylist()
            continue
        text = text_of(whole, None)
        pieces_of = [text_of(b, r["encoding"]) for b, r in zip(bodies, parts)]
        assert "".join(pieces_of) == text, path
        if kind == "json":
            got = [t for r, b in zip(parts, pieces_of) for t in json_texts(b, r["inside"])]
            assert got == list(json_texts(text)), path
        else:
            assert [r["before"] for r in parts] == np.cumsum([0, *map(len, pieces_of[:-1])]).tolist()
    assert min(cut.values()) > 25, cut


def test_records_of_csv_are_those_of_a_plain_reader():
    rng = random.Random(12)
    for _ in range(500):
        body = csv_body(rng)
        records, cell, state = [b""], True, False  # at the start of a cell, inside quotes
        k = 0
        while k < len(body):
            c = body[k : k + 1]
            if c == b'"':
                run = re.match(b'"+', body[k:]).end()
                if state or cell:
                    state = (run + state) % 2 == 1
                records[-1] += body[k : k + run]
                cell, k = False, k + run
                continue
            records[-1] += c
            cell = c in (b",", b"\n", b"\r")
            k += 1
            if not state and (c == b"\n" or c == b"\r" and body[k : k + 1] != b"\n"):
                records.append(b"")
        assert csv_records(body).to_pylist() == [r for r in records if r] or [b""], body


def test_no_match_crosses_a_safe_place(spark):
    """Every text, cut at all its safe places at once, has the matches of the whole."""
    rng = random.Random(13)
    texts = [" ".join(rng.choice(WORDS) + rng.choice(["", "", ",", ";", "x"]) for _ in range(60)) for _ in range(300)]
    rows = []
    for k, text in enumerate(texts):
        # Cuts are found in bytes; count in code points.
        body = text.encode()
        at = [0, *(len(body[: m.start()].decode()) for m in SAFE.finditer(body)), len(text)]
        rows += [(k, a, text[a:b]) for a, b in zip(at, at[1:])]
    whole = findings(spark.createDataFrame(list(enumerate(texts)), "k int, text string"), ["k"]).collect()
    cut = findings(spark.createDataFrame(rows, "k int, at int, text string"), ["k", "at"]).collect()
    assert len(whole) > 2000 and len(rows) > 5000
    assert sorted((r["k"], r["category"], r["position"], r["value"]) for r in whole) == sorted((r["k"], r["category"], r["position"] + r["at"], r["value"]) for r in cut)


def test_findings_do_not_depend_on_ranges(spark, folder):
    seen = []
    for width in (64, 4096, None):
        found = Directory(spark, str(folder), width)
        seen.append(sorted(map(str, findings_of(found).collect())))
        assert (found.parts().where("path like '%.txt'").count() > 150) == (width == 64)
    assert seen[0] == seen[1] == seen[2] and len(seen[0]) > 500


def test_a_long_file_is_read_by_many_tasks(spark, tmp_path):
    (tmp_path / "long.csv").write_text("".join(f'{k},"line\nbreak",u{k}@site.org\n' for k in range(6000)))
    (tmp_path / "long.json").write_text(json.dumps([{"mail": f"u{k}@site.org"} for k in range(6000)]))
    (tmp_path / "long.txt").write_text("write to me; " * 9000 + "z@site.org")
    whole = {r["name"]: r["pii_counts"] for r in scan_directory(spark, str(tmp_path)).collect()}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
        for read, name in ((csv_rows, "long.csv"), (json_records, "long.json")):
            rows = read(spark, f"{tmp_path}/{name}")
            tasks = rows.selectExpr("spark_partition_id() as task").groupBy("task").count().collect()
            assert len(tasks) >= 6 and sum(r["count"] for r in tasks) == 6000
        assert {r["name"]: r["pii_counts"] for r in scan_directory(spark, str(tmp_path)).collect()} == whole
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert whole == {"long.csv": {"email": 6000}, "long.json": {"email": 6000}, "long.txt": {"email": 1}}


def test_long_csv_is_read_in_short_pieces(spark, tmp_path):
    """Marks of all quotes and line ends of a piece are in memory at once, so a piece is short whatever the splits."""
    record = 'x,"a ""b"",\nc",' + "y" * 80 + "\n"
    (tmp_path / "long.csv").write_text(record * 200_000)
    files = list_files(spark, str(tmp_path)).selectExpr("path", "size", "mtime", f"{family('path')} as family")
    found = pieces(files).selectExpr("max(end - begin) as longest", "sum(end - begin) as total").first()
    assert found["longest"] < 9 << 20 and found["total"] == len(record) * 200_000
    texts = csv_rows(spark, str(tmp_path)).groupBy("text").count().collect()
    assert [tuple(r) for r in texts] == [('x a "b",\nc ' + "y" * 80, 200_000)]


def test_split_bytes(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for told, n in (("134217728b", 1 << 27), ("64k", 1 << 16), ("2m", 1 << 21), ("1", 16)):
            spark.conf.set("spark.sql.files.maxPartitionBytes", told)
            assert split_bytes(spark) == n
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_levels_are_shared_out(spark, tmp_path):
    """A root whose only folder holds many folders is not walked by one task."""
    for k in range(40):
        (tmp_path / "only" / f"{k:02}" / "deep").mkdir(parents=True)
        (tmp_path / "only" / f"{k:02}" / "deep" / f".{k}.txt").write_text("x")
    assert list_files(spark, str(tmp_path)).count() == 40
    folders = spark.createDataFrame([(str(tmp_path / "only" / f"{k:02}"),) for k in range(40)], "path string")
    tasks = expanded(folders, 40).selectExpr("spark_partition_id() as task").groupBy("task").count().collect()
    assert len(tasks) == spark.sparkContext.defaultParallelism and max(r["count"] for r in tasks) <= 6


def test_names_of_any_kind_are_scanned(spark, tmp_path):
    (tmp_path / ".y" / "_z").mkdir(parents=True)
    (tmp_path / "_x.txt").write_text("a@site.org")
    (tmp_path / ".y" / "z.csv").write_text("b@site.org,c@site.org")
    (tmp_path / ".y" / "_z" / "50%+ [a].json").write_text('["d@site.org"]')
    spark.createDataFrame([("e@site.org",)], "v string").toPandas().to_parquet(tmp_path / "_t.parquet")
    got = {r["name"]: r["pii_counts"]["email"] for r in scan_directory(spark, str(tmp_path)).collect()}
    assert got == {"_x.txt": 1, "z.csv": 2, "50%+ [a].json": 1, "_t.parquet": 1}
    assert {r["status"] for r in scan_status(spark, str(tmp_path)).collect()} == {"ok"}


def test_failing_files_leave_the_others(spark, tmp_path, monkeypatch):
    (tmp_path / "good.txt").write_text("a@site.org")
    (tmp_path / "good.csv").write_text("b@site.org\n" * 3)
    (tmp_path / "wide.csv").write_text(",".join(["q"] * 1_100_000) + ",c@site.org\n")  # no limit on cells
    (tmp_path / "deep.json").write_text("[" * 200_000 + '"d@site.org"')
    table = spark.createDataFrame([(f"{k}@site.org",) for k in range(3000)], "v string").toPandas()
    table.to_parquet(tmp_path / "good.parquet")
    body = (tmp_path / "good.parquet").read_bytes()
    (tmp_path / "damaged.parquet").write_bytes(body[:60] + b"\xff" * 400 + body[460:])
    (tmp_path / "none.parquet").write_bytes(b"not a table")
    (tmp_path / "gone.txt").symlink_to(tmp_path / "nowhere")
    monkeypatch.setattr(contents_module, "LONGEST_VALUE", 1 << 30)
    got = {r["name"]: r["pii_counts"]["email"] for r in scan_directory(spark, str(tmp_path)).collect()}
    assert got == {"good.txt": 1, "good.csv": 3, "wide.csv": 1, "deep.json": 1, "good.parquet": 3000}
    errors = {r["name"]: r["error"] for r in scan_errors(spark, str(tmp_path)).collect()}
    assert set(errors) == {"damaged.parquet", "none.parquet"} and all(errors.values())
    failed = scan_status(spark, str(tmp_path)).where("status = 'failed'")
    assert {r["name"]: r["error"] for r in failed.collect()} == errors


def test_a_file_that_goes_away_is_an_error_row(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x")
    found = Directory(spark, str(tmp_path))
    (tmp_path / "a.txt").unlink()
    assert [(r["name"], r["text"], r["error"].split(":")[0]) for r in found.whole().collect()] == [("a.txt", None, "FileNotFoundError")]


def test_a_thousand_parquet_files_of_three_kinds(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    kinds = [
        lambda k: {"v": pa.array([f"u{k}@site.org", None]), "n": pa.array([k, None], pa.int64())},
        lambda k: {"v": pa.array([k, 7], pa.int32()), "x": pa.array([1e10, 1e-4])},
        lambda k: {"v": pa.array([{"k": k}, {"k": None}]), "b": pa.array([b"\xef\xf0", b"ok"])},
    ]
    for k in range(1000):
        pq.write_table(pa.table(kinds[k % 3](k)), tmp_path / f"{k}.parquet")
    rows = parquet_rows_any_schema(spark, str(tmp_path))
    got = defaultdict(list)
    for r in rows.collect():
        got[int(re.search(r"(\d+)\.parquet", r["path"])[1])].append(r["text"])
    want = [
        lambda k: [f"u{k}@site.org {k}", ""],
        lambda k: [f"{k} 10000000000.0", "7 0.0001"],
        lambda k: [f'{{"k":{k}}} пр', "{} ok"],
    ]
    assert got == {k: want[k % 3](k) for k in range(1000)}


def test_a_row_reads_the_same_whatever_its_neighbours(spark, tmp_path):
    """A folder where another file clashes writes the cells of a file as a folder of that file alone does."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    (tmp_path / "alone").mkdir()
    (tmp_path / "both").mkdir()
    row = pa.table({"f": [1e10], "d": pa.array([0.0001]), "s": [{"k": 1, "m": None}], "t": pa.array([0], pa.timestamp("ms"))})
    for sub in ("alone", "both"):
        pq.write_table(row, tmp_path / sub / "a.parquet")
    pq.write_table(pa.table({"f": ["x"]}), tmp_path / "both" / "b.parquet")
    texts = [[r["text"] for r in parquet_rows_any_schema(spark, str(tmp_path / sub)).where("path like '%a.parquet'").collect()] for sub in ("alone", "both")]
    assert texts[0] == texts[1] == ['10000000000.0 0.0001 {"k":1} 1970-01-01 00:00:00']


def test_row_groups_are_dealt_out(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    pq.write_table(pa.table({"v": [f"u{k}" for k in range(8000)]}), tmp_path / "a.parquet", row_group_size=1000)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "10k")
        tasks = parquet_rows_any_schema(spark, str(tmp_path)).selectExpr("spark_partition_id() as task").groupBy("task").count().collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(tasks) > 3 and sum(r["count"] for r in tasks) == 8000


def test_contents_of_nothing(spark, tmp_path):
    files = list_files(spark, str(tmp_path)).selectExpr("path", "size", "mtime", f"{family('path')} as family")
    assert contents(pieces(files).selectExpr("*", "cast(null as binary) as content")).count() == 0
    (tmp_path / "empty.csv").write_bytes(b"")
    (tmp_path / "empty.json").write_bytes(b"")
    assert Directory(spark, str(tmp_path)).rows().count() == 0
    assert decoded(b"\x98\xe9") == "\x98é"
