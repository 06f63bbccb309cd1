"""Small files, snapshots, reports and release decisions."""

import glob
from urllib.parse import unquote

import pytest

from stowline.plans.quality import METRICS, corpus_fingerprint, manifest, report, write_report
from stowline.plans.releases import action, to_tell, version, version_text
from stowline.plans.store import Snapshots
from stowline.sources.files import catalogue_pages, page_problems, replace_catalogue, language, launcher_versions, localisation, only_child
from stowline.sources.gamelog import read_log, split_bytes


def write(path, text):
    path.write_bytes(text.encode())
    return str(path)


def test_launcher_versions(spark, tmp_path):
    old, new = write(tmp_path / "a.log", "x 4.8-live.12000001 y 4.9.1-live.12000002"), write(tmp_path / "b.log", "4.9.2-live.12000002 and 4.10-ptu.1")
    assert {tuple(r) for r in launcher_versions(spark, [old, new]).collect()} == {(12000001, "4.8"), (12000002, "4.9.2")}


def test_localisation_and_language(spark, tmp_path):
    ini = write(tmp_path / "global.ini", "﻿Place_A,P=One\r\nplace_a=Two=2\nb ,X=3\n=none\n,P=none\nplain\n")
    assert {tuple(r) for r in localisation(spark, ini).collect()} == {("place_a", "Two=2"), ("b ", "3")}
    assert language(spark, write(tmp_path / "user.cfg", "r_x = 1\n  g_language = french_(france) ; note\n")) == "french_(france)"
    assert language(spark, write(tmp_path / "other.cfg", "r_x = 1\n")) == "english"


def test_only_child(spark):
    keys = spark.createDataFrame([("s_one",), ("s_one_desc",), ("t_a",), ("t_b",), ("u_name",), ("u_desc",)], "key string")
    stems = spark.createDataFrame([("S",), ("t",), ("u",)], "stem string")
    assert {tuple(r) for r in only_child(keys, stems).collect()} == {("s", "s_one"), ("u", "u_name")}


def test_catalogue_pages(spark, tmp_path):
    for n in (1, 2):
        write(tmp_path / f"p{n}.json", '{"data": [{"id": %d, "name": "a"},\n {"id": %d, "name": null}]}' % (n, n + 10))
    assert sorted(r.id for r in catalogue_pages(spark, str(tmp_path), "id int, name string").collect()) == [1, 2, 11, 12]


def test_snapshots_are_whole(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path / "s"))
    assert store.current() is None and store.stale()
    store.publish({"place_name": spark.range(2), "move": spark.range(3)})
    assert store.current() == 1 and not store.stale()
    # A version that was never committed is not seen, and its number is not used again.
    spark.range(9).write.parquet(str(tmp_path / "s" / "v=2" / "move"))
    assert store.read("move").count() == 3
    assert store.publish({"place_name": spark.range(4), "move": spark.range(5)}) == 3
    assert (store.read("move").count(), store.read("move", 1).count()) == (5, 3)
    store.reset()
    assert store.read("place_name").count() == 4
    assert not glob.glob(str(tmp_path / "s" / "v=4" / "move"))


def test_manifest(spark, tmp_path):
    write(tmp_path / "a.log", "x\n")
    before = corpus_fingerprint(manifest(spark, str(tmp_path))).first()[0]
    write(tmp_path / "a.log", "y\n")
    assert corpus_fingerprint(manifest(spark, str(tmp_path))).first()[0] != before


def test_report_fails_losses_and_broken_limits(spark, tmp_path):
    schema = "metric string, value double"
    found = spark.createDataFrame([("live.parity", 0.99), ("holdings.low_share", 0.06), ("enrich.geid_coverage", 0.8), ("holdings.mean_score", 0.7991), ("odd", 1.0)], schema)
    base = spark.createDataFrame([("holdings.low_share", 0.05), ("enrich.geid_coverage", 0.7), ("holdings.mean_score", 0.8)], schema)
    rows = report(found, base)
    assert [(r.metric, r.ok) for r in rows.collect()] == [("enrich.geid_coverage", True), ("holdings.low_share", False), ("holdings.mean_score", True), ("live.parity", False)]
    assert set(METRICS) >= {r.metric for r in rows.collect()}
    write_report(rows, str(tmp_path / "md"), "md")
    lines = open(glob.glob(str(tmp_path / "md" / "part-*"))[0]).read().splitlines()
    assert lines[0].startswith("| Metric") and lines[2] == "| enrich.geid_coverage | 0.8000 | 0.7000 | 0.8500 | ok |" and len(lines) == 6
    write_report(rows, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 4


def test_releases(spark):
    r = spark.createDataFrame([("v1.2", "feat: a"), ("1.3.1", "chore: b"), ("V1.10.0.5", "fix: c"), ("x1", "fix: d")], "tag string, body string")
    assert [tuple(x) for x in r.select(version_text(version(r.tag))).collect()] == [("1.2.0",), ("1.3.1",), ("1.10.0.5",), (None,)]
    assert [x.tag for x in to_tell(r, "2.0", "1.0").collect()] == ["V1.10.0.5", "v1.2"]
    assert [x.tag for x in to_tell(r, "1.3.1").collect()] == []
    say = lambda *a: spark.range(1).select(action(*a)).first()[0]
    assert [say("1.2", None, True), say("1.2", None, False), say("1.2", "1.2.0", True), say("1.10", "1.9", True)] == ["show", "record", "nothing", "show"]


LOGS = {
    "Game.log": b"\xef\xbb\xbffirst \xc3\xa9\r\nsecond \xff bad\n\n\n" + b"third " * 400 + b"line\r\rx\nlast\npartial",
    "a b%20+c Build(99999999).log": b"one\ntwo\r\n",
    "empty.log": b"",
    "no feed.log": b"no line feed",
    "feeds.log": b"\n" * 50,
    "mark only.log": b"\xef\xbb\xbfx\ny",
    "long.log": b"".join(b"%d %s\n" % (i, b"w" * (i % 97)) for i in range(300)),
}


@pytest.mark.parametrize("size", ["700", "5000", "128m"])
def test_lines_are_the_same_for_any_byte_range(spark, tmp_path, size):
    for name, data in LOGS.items():
        (tmp_path / name).write_bytes(data)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        lines, missed = read_log(spark, str(tmp_path))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])
    found = [(unquote(r.path.rsplit("/", 1)[1]), r.line_no, r.line_offset, r.line) for r in lines.collect()]
    assert sorted(found) == sorted((name, i, at, text) for name, data in LOGS.items() for i, (at, text) in enumerate(split_bytes(data)))
    assert missed.count() == 0


def test_a_file_that_cannot_be_read_is_listed_and_the_rest_is_read(spark, tmp_path):
    write(tmp_path / "Game.log", "<x> a\n")
    # The local file system checks a file against the sums beside it.
    write(tmp_path / "Game Build(99999999).log", "<y> b\n" * 300)
    (tmp_path / ".Game Build(99999999).log.crc").write_bytes(b"crc\x00\x00\x00\x02\x00" + b"\x01" * 16)
    lines, missed = read_log(spark, str(tmp_path))
    assert [r.line for r in lines.collect()] == ["<x> a"]
    assert [(unquote(r.path.rsplit("/", 1)[1]), r.length) for r in missed.collect()] == [("Game Build(99999999).log", 1800)]


def test_a_catalogue_is_replaced_by_a_whole_set_of_pages_only(spark, tmp_path):
    schema, store = "uuid string, name string", Snapshots(spark, str(tmp_path / "store"))
    page = lambda n, last, rows: '{"data": [%s], "meta": {"current_page": %s, "last_page": %s}}' % (", ".join('{"uuid": "%s", "name": "%s"}' % r for r in rows), n, last)

    def load(name, *pages):
        (tmp_path / name).mkdir()
        for i, text in enumerate(pages):
            write(tmp_path / name / f"{i}.json", text)
        found = {(r.problem, r.page) for r in page_problems(spark, str(tmp_path / name), schema).collect()}
        return found, replace_catalogue(store, "wiki_item", str(tmp_path / name), schema, "uuid")

    have = lambda: {tuple(r) for r in store.read("wiki_item").collect()}
    assert load("whole", page(1, 2, [("a", "A"), ("b", "B")]), page(2, 2, [("a", "A2")])) == (set(), 1)
    assert have() == {("a", "A2"), ("b", "B")}
    assert load("gap", page(1, 3, [("z", "Z")]), page(3, 3, [])) == ({("missing", 2)}, None)
    assert load("apart", page(1, 2, [("z", "Z")]), page(2, 3, [("y", "Y")])) == ({("missing", 3), ("last pages differ", 3)}, None)
    assert load("broken", page(1, 2, [("z", "Z")]), '{"data": [') == ({("no valid numbers", None), ("missing", 2)}, None)
    assert load("no rows", '{"meta": {"current_page": 1, "last_page": 1}}') == ({("no rows", 1)}, None)
    assert have() == {("a", "A2"), ("b", "B")} and store.current() == 1
    assert load("next", page(1, 1, [("c", "C")])) == (set(), 2) and have() == {("c", "C")}
