"""Files of every supported kind, in every supported encoding."""

from __future__ import annotations

import json
import random
import time
from html import unescape
from html.parser import HTMLParser
from pathlib import Path

import pytest
from test_detect import ORDER

from veilspan.functions.text import decode_entities, decode_text, html_text, row_text
from veilspan.operators.levels import LEVEL_2, LEVEL_4
from veilspan.plans.scan import scan_directory, scan_findings, scan_status, write_reports
from veilspan.sources.directory import table_rows
from veilspan.sources.listing import family, list_files, suffix, suffix_group
from veilspan.sources.reports import read_detailed, read_summary
from veilspan.sources.tables import csv_rows, csv_table, json_records, json_table, json_texts
from veilspan.streaming.incremental import scan_new_files

COURIERS = (
    "id;note,who,mail,number\n"
    '1,"Громов Пётр Львович, старший",gromov@post.example,+7 (901) 245-60-13\n'
    '2,"Лебедева\nАнна",leb_a@post.example,8 912 700 81 22\n'
    "3,,,044525974\n"
)
ORDERS = {
    "batch": 17,
    "orders": [
        {"to": "Журавлёва Инна", "card": "4539148803436467", "paid": True},
        {"to": "Зимин Олег", "card": None, "licence": "77 15 640213"},
    ],
}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("files")
    deep = root / "a b" / "c+d"
    deep.mkdir(parents=True)
    (root / "order.txt").write_text(ORDER, encoding="utf-8")
    (root / "_hidden.txt").write_text("h@site.org")
    (root / ".git").mkdir()
    (root / ".git" / "note.md").write_text("g@site.org")
    (root / "empty.txt").write_text("")
    (deep / "cp1251.MD").write_bytes("ИНН: 500100732259\r\nПриём".encode("cp1251"))
    (root / "latin.txt").write_bytes(b"\x98 caf\xe9 user@site.org")
    (root / "couriers.csv").write_text(COURIERS, encoding="utf-8")
    (root / "other.CSV").write_bytes("город;x\n\"Орлов, Пётр\",\"2\"\"3\"\n".encode("cp1251"))
    (root / "orders.json").write_text(json.dumps(ORDERS, ensure_ascii=False, indent=2), "utf-8")
    (root / "lines.json").write_text('{"mail": "a1@site.org", "n": 7}\n{"mail": "b2@site.org"}\n')
    (root / "broken.json").write_text("{not json a@site.org")
    (root / "page.HTM").write_bytes(b"<html><script>x@site.org</script><p>me&#64;site.org</p>\xff</html>")
    (root / "blank.txt").write_text(" \n\t ")
    (root / "photo.JPG").write_bytes(b"\xff\xd8")
    (root / "clip.mp4").write_bytes(b"0")
    (root / "form.pdf").write_bytes(b"%PDF")
    (root / "notes.rtf").write_bytes(b"x")
    rows = spark.createDataFrame(
        [("+79161234567", None, [1]), (None, "x@site.org", None)],
        "phone string, mail string, tags array<int>",
    )
    rows.toPandas().to_parquet(root / "table.parquet")
    return str(root)


def _by_name(df, *columns):
    return {r["name"]: tuple(r[c] for c in columns) for r in df.collect()}


def test_listing(spark, folder):
    files = _by_name(list_files(spark, folder), "format", "size", "path")
    assert len(files) == 18 and {"_hidden.txt", "note.md", "empty.txt"} <= set(files)
    assert files["cp1251.MD"][0] == ".MD"
    assert files["cp1251.MD"][2].endswith("/a b/c+d/cp1251.MD")
    assert files["latin.txt"][1] == 20


def test_suffix_and_families(spark):
    names = ["a.txt", "A.Tar.GZ", ".bashrc", "x.", "noext", "b.DOCX", "c.tiff", "d.mov", "e.htm"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = df.selectExpr(suffix("n"), family("n"), suffix_group(f"{suffix('n')}")).collect()
    assert [r[0] for r in got] == [".txt", ".GZ", "", "", "", ".DOCX", ".tiff", ".mov", ".htm"]
    assert [r[1] for r in got] == ["text", None, None, None, None, "docx", "image", "video", "html"]
    assert [r[2] for r in got][5:] == ["documents", "images", "video", "web"]


def test_status(spark, folder):
    got = {n: s for n, (s,) in _by_name(scan_status(spark, folder), "status").items()}
    expected = {
        "blank.txt": "blank", "empty.txt": "blank", "photo.JPG": "skipped_media",
        "clip.mp4": "skipped_media", "form.pdf": "skipped_media", "notes.rtf": "unsupported",
    }
    assert got == {n: expected.get(n, "ok") for n in got} and len(got) == 18


def test_directory_scan(spark, folder):
    got = _by_name(scan_directory(spark, folder), "pii_counts", "protection_level")
    assert got["order.txt"] == (
        {"fio": 1, "phone": 1, "email": 1, "birth_date": 1, "address": 1}, LEVEL_4,
    )
    assert got["couriers.csv"] == ({"fio": 2, "phone": 2, "email": 2, "bik": 1}, LEVEL_2)
    # The licence also reads as a passport, and the tail of the card as a phone.
    assert got["orders.json"] == (
        {"fio": 2, "phone": 1, "passport": 1, "driver_license": 1, "bank_card": 1}, LEVEL_2,
    )
    assert got["broken.json"][0] == {"email": 1}
    assert got["cp1251.MD"][0] == {"inn": 1}
    assert got["latin.txt"][0] == got["page.HTM"][0] == {"email": 1}
    assert got["lines.json"][0] == {"email": 2}
    assert got["table.parquet"][0] == {"phone": 1, "email": 1}
    assert set(got) == {
        "order.txt", "couriers.csv", "orders.json", "cp1251.MD", "latin.txt", "page.HTM",
        "lines.json", "table.parquet", "broken.json", "_hidden.txt", "note.md",
    }
    order = scan_directory(spark, folder).where("name = 'orders.json'").first().pii_categories
    assert order == ["fio", "phone", "passport", "driver_license", "bank_card"]


def test_directory_findings(spark, folder):
    rows = scan_findings(spark, folder).where("category = 'inn'").collect()
    assert [(r.name, r.value, r.position) for r in rows] == [("cp1251.MD", "ИНН: 500100732259", 0)]


def test_directory_without_tables(spark, tmp_path):
    (tmp_path / "one.txt").write_text("a@site.org")
    assert [r.name for r in scan_directory(spark, str(tmp_path)).collect()] == ["one.txt"]


def test_parquet_files_with_clashing_types(spark, tmp_path):
    for i, (sub, value) in enumerate([("a", "x@site.org"), ("a", 5), ("b", "y@site.org"), ("b", "z")]):
        (tmp_path / sub).mkdir(exist_ok=True)
        table = spark.createDataFrame([(value,)], "v string" if isinstance(value, str) else "v bigint")
        table.toPandas().to_parquet(tmp_path / sub / f"{i}.parquet")
    (tmp_path / "b" / "bad.parquet").write_bytes(b"not parquet at all")
    rows = table_rows(spark, str(tmp_path)).collect()
    assert [r.name for r in rows if r.error] == ["bad.parquet"]
    assert sorted((r.name, r.text) for r in rows if not r.error) == [
        ("0.parquet", "x@site.org"), ("1.parquet", "5"), ("2.parquet", "y@site.org"),
        ("3.parquet", "z"),
    ]


def test_clashing_parquet_files_take_one_plan(spark, tmp_path):
    def plan_of(n: int) -> int:
        root = tmp_path / str(n)
        root.mkdir()
        for i in range(n):
            value, kind = ("x", "v string") if i % 2 else (i, "v bigint")
            spark.createDataFrame([(value,)], kind).toPandas().to_parquet(root / f"{i}.parquet")
        rows = table_rows(spark, str(root))
        assert rows.count() == n
        return rows._jdf.queryExecution().executedPlan().toString().count("Scan")

    assert plan_of(2) == plan_of(12)


def test_splits_do_not_change_findings(spark, tmp_path):
    """Names over line ends, script content and records come out alike however files are split."""
    filler = "слово ещё слово\n" * 3000
    (tmp_path / "big.txt").write_text(filler + "Белов\nИлья встретил\nЛосева\nОлега " + filler, "utf-8")
    (tmp_path / "big.html").write_text("<p>x</p>" * 9000 + "<script>" + "s@site.org;" * 900 + "</script>k@site.org", "utf-8")
    (tmp_path / "big.json").write_text(json.dumps([{"m": f"u{k}@site.org", "x": "y" * 90} for k in range(900)]))
    (tmp_path / "big.csv").write_text("".join(f'{k},"Сомов\nПётр"\n' for k in range(900)), "utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    seen = []
    try:
        for size in ("1k", "20k", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            seen.append(_by_name(scan_directory(spark, str(tmp_path)), "pii_counts", "size"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert seen[0] == seen[1] == seen[2]
    assert {n: c for n, (c, _) in seen[0].items()} == {
        "big.txt": {"fio": 2}, "big.html": {"email": 1}, "big.json": {"email": 900}, "big.csv": {"fio": 900},
    }


def test_reports_on_disk(spark, folder, tmp_path):
    profile = scan_directory(spark, folder)
    write_reports(profile, str(tmp_path / "s"), str(tmp_path / "d"))
    assert read_summary(spark, str(tmp_path / "s")).count() == 11
    detailed = {r["имя_файла"]: r for r in read_detailed(spark, str(tmp_path / "d")).collect()}
    row = detailed["couriers.csv"]
    assert row["количество_находок"] == "fio:2, phone:2, email:2, bik:1"
    assert row["категории_ПДн"] == "fio, phone, email, bik" and row["размер"] > 100


def test_csv_rows(spark, folder, tmp_path):
    rows = csv_rows(spark, folder, "*.CSV").collect()
    assert [r.text for r in rows] == ["город;x", 'Орлов, Пётр 2"3']
    rows = csv_rows(spark, folder, "couriers.csv").collect()
    assert [r.text for r in rows][2:] == ["2 Лебедева\nАнна leb_a@post.example 8 912 700 81 22", "3 044525974"]
    wide = ",".join(["q"] * 30_000)
    body = f'a,b\n1,2,3,004\n"x"\n\n5" pipe,6"\n"un""quoted",\n"two\nlines","z"\n{wide}\n'
    for i, ending in enumerate(["\n", "\r\n"]):
        (tmp_path / f"{i}.csv").write_bytes(body.replace("\n", ending).encode())
        texts = [r.text for r in csv_rows(spark, str(tmp_path / f"{i}.csv")).collect()]
        assert texts == ["a b", "1 2 3 004", "x", '5" pipe 6"', 'un"quoted', "two\nlines z", wide.replace(",", " ")]
    shared = [r.text for r in csv_table(spark, f"{folder}/couriers.csv", ["number", "who"]).collect()]
    assert shared[0] == "+7 (901) 245-60-13 Громов Пётр Львович, старший"


def test_json_records(spark, folder, tmp_path):
    texts = [r.text for r in json_records(spark, folder, "lines.json").collect()]
    assert sorted(texts) == ["a1@site.org 7", "b2@site.org"]
    (tmp_path / "x.json").write_text('[{"a": 1, "b": {"c": "d"}}, 5, {"e": [1, 2], "f": null}]')
    texts = [r.text for r in json_records(spark, str(tmp_path)).collect()]
    assert texts == ['1 {"c":"d"}', "5", "[1,2]"]
    (tmp_path / "y.json").write_text('{"phone": 79161234567, "code": "007"}\n')
    table = json_table(spark, f"{tmp_path}/y.json", "code string, phone string")
    assert [r.text for r in table.collect()] == ["007 79161234567"]


@pytest.mark.parametrize(
    ("body", "texts"),
    [
        ('[{"p": "1", "p": "2"}]', ["2"]), ('{"a": NaN, "b": -Infinity, "c": 1.50, "d": 007}', ["{\"a\": NaN, \"b\": -Infinity, \"c\": 1.50, \"d\": 007}"]),
        ('{"a": NaN, "b": 1.50, "c": true}', ["NaN 1.50 true"]), ('\ufeff{"a": "x"}', ["x"]), ("", []), (" \n", []), ("[]", []), ("{}", []),
        ('{"a": 1}\nbroken a@b.co\n{"a": 2}', ["1", "broken a@b.co", "2"]), ('[{"a": 1},\n{broken},\n{"a": 2}]', ["1", "{broken},", "2"]),
        ('{"rows": [{"a": 1}, {"a": "é"}], "n": "top"}', ["top", "1", "é"]), ('"text"', ["text"]), ("[[1, 2], null]", ["[1,2]"]), ("[" * 100_000, None),
    ],
)
def test_json_texts(body, texts):
    got = list(json_texts(body))
    assert texts is None or got == texts


def test_decode_order(spark):
    cases = [
        ("Привет\r\nмир\r!".encode(), "Привет\nмир\n!"),
        (bytes(b for b in range(0x80, 0x100) if b != 0x98),) * 2,
        (b"\x98\xe9", "\x98é"),
        ("﻿x".encode(), "﻿x"),
        (b"", ""),
    ]
    df = spark.createDataFrame([(i, bytearray(c[0])) for i, c in enumerate(cases)], "i int, b binary")
    got = [r.t for r in df.selectExpr("i", f"{decode_text('b')} as t").orderBy("i").collect()]
    want = [c[1] if isinstance(c[1], str) else c[1].decode("cp1251") for c in cases]
    assert got == want


def test_html(spark):
    cases = [
        ("<p>a</p>\n<p>b</p>\n", "a\n\n\nb\n\n"),
        ("<!DOCTYPE html><b>x</b>y", "x\ny"),
        ("a<!-- <p>c</p> -->b", "a\nb"),
        ("1 < 2 > 0", "1 < 2 > 0"),
        ("<SCRIPT type=x>var a='<p>';</Script >t<style>p{}</style>", "t"),
        ("t<script>never closed a@b.co", "t"),
        ("<script-x>kept</script-x>", "kept"),
        ("<br>" * 20000 + "z", "z"),
        ('<p title="a>b">x', "x"),
        ("<p title='a>\"b' x = \"c>'d\" y=e\"f>g", "g"),
        ('<a href=x"y>t</a "z">u', "t\nu"),
        ('<script src="a>b">s@c.org</script>t', "t"),
        ('<p title="never closed>mail a@b.co</p> <i>x</i>', "mail a@b.co\n \nx"),
        ("<!x y>a<?php echo ?>b</>c<![CDATA[d]]>e", "a\nb\nc\ne"),
        ("<p" + " a" * 9000 + ">x", "x"),
        ("", ""),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, h string")
    got = [r.t for r in df.selectExpr("i", f"{html_text('h')} as t").orderBy("i").collect()]
    assert got == [c[1] for c in cases]


class _Nodes(HTMLParser):
    """Text nodes outside script and style, as the standard library finds them."""

    def __init__(self):
        super().__init__()
        self.nodes, self.open, self.raw = [], False, False

    def handle_data(self, data):
        if self.raw:
            return
        if self.open:
            self.nodes[-1] += data
        else:
            self.nodes.append(data)
        self.open = True

    def markup(self, *_):
        self.open = False

    handle_comment = handle_decl = handle_pi = unknown_decl = markup

    def handle_starttag(self, tag, attrs):
        self.open, self.raw = False, tag in ("script", "style")

    def handle_endtag(self, tag):
        self.open, self.raw = False, False


def test_random_pages_equal_the_standard_parser(spark):
    rng = random.Random(5)
    attributes = ['a="x>y"', "b='<i>'", "c", "d=e", 'f = "g"', "h='\"'", 'i="\'>"', "j=k/l", "data-m=\"</p>\"", 'n=""', "o=p\"q"]
    texts = ["one", " two ", "\n", "3 < 4", "a & b", "&lt;p&gt;", "&amp;", "é>", "user@site.org"]

    def tag(name):
        return "<" + name + "".join(rng.choice([" ", "\n", "  "]) + rng.choice(attributes) for _ in range(rng.randrange(4))) + rng.choice([">", " >", " />"])

    def part():
        kind = rng.randrange(8)
        if kind < 3:
            return rng.choice(texts)
        if kind < 5:
            return tag(rng.choice(["p", "DIV", "a", "br", "x-y", "h1"]))
        if kind == 5:
            return f"</{rng.choice(['p', 'Div', 'a'])}{rng.choice(['', ' '])}>"
        if kind == 6:
            return rng.choice(["<!-- <p title='x'> -->", "<!DOCTYPE html>", "<?xml version='1.0'?>", "<!---->"])
        name = rng.choice(["script", "STYLE"])
        return f"<{name} {rng.choice(attributes)}>if (a < b) '<p>'; mail@in.script</{name}>"

    pages = ["".join(part() for _ in range(rng.randrange(25))) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(pages)), "i int, h string")
    got = [r.t for r in df.selectExpr("i", f"{html_text('h')} as t").orderBy("i").collect()]
    for page, text in zip(pages, got):
        parser = _Nodes()
        parser.feed(page)
        parser.close()
        assert text == "\n".join(parser.nodes), page


@pytest.mark.parametrize(
    "opening", ["<", "<p ", "<p a=", '<p a="', "<p a='", "<a b=\"'", "<!--", "<script>", "<style ", "</", "<!", "<?", '<p a=">', "<p a='>\"", "=\"", "<p>", '<p a="x">']
)
def test_html_takes_linear_time(spark, opening):
    """Twice the length takes about twice the time, whatever never ends."""

    def seconds(n, end):
        df = spark.createDataFrame([(opening * (n // len(opening)) + end,)], "h string")
        started = time.perf_counter()
        df.selectExpr(f"char_length({html_text('h')}) as n").collect()
        return time.perf_counter() - started

    for end in ("", '">', "'>", " x>y", "-->"):
        seconds(1000, end)
        assert seconds(4_000_000, end) < 5 * seconds(1_000_000, end) + 1.5


def test_entities(spark):
    cases = [
        ("a &amp;lt; b", "a &lt; b"),
        ("&copy;&nbsp;&middot;&quot;&#39;&#x41;&#128512;", "©\xa0·\"'A😀"),
        ("&unknown; &; & &#xD800; &#0; AT&T", "&unknown; &; & \ufffd \ufffd AT&T"),
        *((t, unescape(t)) for t in (
            "&apos;", "&amp x", "&#0000000064;", "&#64 &#x40z", "&notit; &notin;", "&#128;&#x9f;&#1;&#11;&#13;",
            "&#99999999999;&#xFFFE;", "&acE;", "&#;&#x;&#xg;", "&copy2024 &ampx",
        )),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, t string")
    got = [r.x for r in df.selectExpr("i", f"{decode_entities('t')} as x").orderBy("i").collect()]
    assert got == [c[1] for c in cases]


def test_row_text(spark):
    df = spark.sql("select 7 as a, cast(null as string) as b, named_struct('c', 'x') as d, 'я' as e")
    assert df.selectExpr(f"{row_text(df)} as t").first().t == '7 {"c":"x"} я'
    assert df.selectExpr(f"{row_text(df, ['e', 'a'])} as t").first().t == "я 7"


def test_stream_gives_the_batch_result_once(spark, folder, tmp_path):
    root, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ck")
    root.mkdir()
    (root / "a.txt").write_text("a@site.org")
    scan_new_files(spark, str(root), out, mark).awaitTermination()
    for name in ("page.HTM", "couriers.csv", "orders.json", "lines.json", "table.parquet", "order.txt"):
        (root / name).write_bytes((Path(folder) / name).read_bytes())
    (root / "c.txt").write_text("nothing")
    (root / "long.txt").write_text("слово\n" * 50_000 + "z@site.org", "utf-8")
    scan_new_files(spark, str(root), out, mark, files_a_batch=4).awaitTermination()
    got = spark.read.parquet(out).drop("batch")
    assert sorted(map(str, got.collect())) == sorted(map(str, scan_directory(spark, str(root)).collect()))
    assert got.count() == 8


