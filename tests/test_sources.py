"""Snapshot files, stores, pages and payloads."""

import datetime as dt
import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from postingflow.config import SourceConfig
from postingflow.functions import html
from postingflow.schema import conform
from postingflow.sources import payloads, snapshots


def posting(i, **more):
    return {"title": f"Title {i} }},{{", "company": "A \"quoted\"\nfirm", "locations": ["Wien", "Graz"], "points": 1.25,
            "salary_guessed": {"annual": 42000, "monthly": 3500}, "collected_on": "2024-01-05", **more}


def write(folder, name, data, **kwargs):
    path = os.path.join(folder, name)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(data, f, ensure_ascii=False, **kwargs)
    return path


@pytest.mark.parametrize("layout", [{"indent": 4}, {"indent": 2}, {}])
def test_snapshot_layouts(spark, tmp_path, layout):
    data = {f"site{i}": posting(i) for i in range(40)}
    data["site_empty"] = {}
    data["nested_last"] = {"title": "t", "salary_guessed": {"annual": 1, "monthly": 2}}
    path = write(str(tmp_path), "postings.json", data, **layout)
    rows = {r["posting_id"]: r for r in snapshots.read_snapshots(spark, path, indent=layout.get("indent", 4)).collect()}
    assert set(rows) == set(data)
    assert rows["site7"]["title"] == "Title 7 },{" and rows["site7"]["company"] == 'A "quoted"\nfirm'
    assert rows["site7"]["salary_guessed"]["monthly"] == 3500 and rows["site7"]["locations"] == ["Wien", "Graz"]
    assert rows["site_empty"]["title"] is None and rows["nested_last"]["salary_guessed"]["annual"] == 1


def test_indented_snapshot_is_split(spark, tmp_path):
    data = {f"site{i}": posting(i, description="x" * 500) for i in range(3000)}
    path = write(str(tmp_path), "postings.json", data, indent=4)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(200_000))
    try:
        df = snapshots.read_snapshots(spark, path)
        assert df.rdd.getNumPartitions() > 4
        ids = [r[0] for r in df.select("posting_id").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted(ids) == sorted(data)


def test_unreadable_snapshot_fails(spark, tmp_path):
    path = tmp_path / "bad.json"
    path.write_text('{"a": {"title": ')
    with pytest.raises(Exception, match="unreadable snapshot"):
        snapshots.read_snapshots(spark, str(path)).collect()


def test_empty_snapshot(spark, tmp_path):
    assert snapshots.read_snapshots(spark, write(str(tmp_path), "e.json", {}, indent=4)).count() == 0


def test_folder_scan_and_dates(spark, tmp_path):
    os.makedirs(tmp_path / "sub")
    write(str(tmp_path), "postings_2024-02-03-10-00-00.json", {"a": posting(1, collected_on=None)}, indent=4)
    write(str(tmp_path / "sub"), "postings.json", {"b": posting(2)}, indent=4)
    (tmp_path / "notes.txt").write_text("line 1\nline 2\n")
    flat = snapshots.read_snapshots(spark, str(tmp_path))
    assert [r[0] for r in flat.select("posting_id").collect()] == ["a"]
    nested = snapshots.dated(snapshots.read_snapshots(spark, str(tmp_path), nested=True))
    dates = {r["posting_id"]: r["collected_on"] for r in nested.collect()}
    assert dates == {"a": dt.date(2024, 2, 3), "b": dt.date(2024, 1, 5)}
    assert snapshots.read_snapshots(spark, str(tmp_path), nested=True, modified_after="2090-01-01T00:00:00").count() == 0
    assert snapshots.read_lines(spark, str(tmp_path / "notes.txt")).count() == 2
    write(str(tmp_path), "names.json", ["A & B", "Ö"], indent=4)
    assert [r[0] for r in snapshots.read_list(spark, str(tmp_path / "names.json")).collect()] == ["A & B", "Ö"]
    today = snapshots.collection_date(F.lit(None).cast("date"), F.lit("x.json"), F.lit(dt.datetime(2024, 5, 6, 7)))
    assert spark.range(1).select(today).first()[0] == dt.date(2024, 5, 6)


def test_store_versions(spark, tmp_path):
    path = str(tmp_path / "store")
    assert snapshots.read_or_empty(spark, path).count() == 0
    one = conform(spark.createDataFrame([("a", "T")], "posting_id string, title string"))
    assert snapshots.write_store(one, path) == 0
    grown = snapshots.read_or_empty(spark, path).unionByName(one.withColumn("posting_id", F.lit("b")))
    assert snapshots.write_store(grown, path) == 1
    assert snapshots.read_or_empty(spark, path).count() == 2
    assert snapshots.read_store(spark, path, before=1).count() == 1


def test_nth_snapshot(spark):
    df = spark.createDataFrame([(f"s{i % 3}", i) for i in range(9)], "snapshot_id string, v int")
    assert {r["snapshot_id"] for r in snapshots.nth_snapshot(df, 1).collect()} == {"s1"}
    assert {r["snapshot_id"] for r in snapshots.nth_snapshot(df, 0, ascending=True).collect()} == {"s0"}
    assert snapshots.nth_snapshot(df, 3).count() == 0


def test_scratch_folder_follows_the_session(spark):
    from postingflow import session

    class Conf:
        def __init__(self, value, master):
            self.value, self.master = value, master

        def get(self, key, default=None):
            return {"spark.checkpoint.dir": self.value, "spark.master": self.master}.get(key) or default

    class Fake:
        def __init__(self, value, master="local[4]"):
            self.conf = Conf(value, master)

    assert session.scratch_dir(Fake("hdfs://shared/cp/"), "x").startswith("hdfs://shared/cp/postingflow/x-")
    with pytest.raises(ValueError):
        session.scratch_dir(Fake(None, "yarn"), "x")
    with pytest.raises(ValueError):
        session.scratch_dir(Fake(None, "local-cluster[2,1,1024]"), "x")
    local = session.scratch_dir(Fake(None), "x")
    assert local.startswith(f"{tempfile.gettempdir()}/run-") and session.scratch_dir(Fake(None), "x") != local


def test_log_keeps_runs_newest_first(spark, tmp_path):
    path = str(tmp_path / "log")
    for day in (1, 2):
        lines = spark.createDataFrame([(dt.datetime(2024, 1, day), f"k{day}", f"line {day}")], "run_ts timestamp, posting_id string, line string")
        snapshots.append_log(lines, path)
    assert [r["line"] for r in snapshots.read_log(spark, path).collect()] == ["line 2", "line 1"]


PAGE = """<!DOCTYPE html><html><head><title>T &amp; T</title><style>p{}</style><script>var a="</p>";</script></head>
<body><!-- note --><div class="x"><p>one<br>two<p>three &lt;b&gt;<div class="joblayouttoken displayDTM rtltextaligneligible">intro</div>
<div class="joblayouttoken rtltextaligneligible displayDTM"><ul><li>a</li><li>b<ul><li>in</li></ul></li></ul><ul class="k">no</ul><ul>c</ul></div>
<h2 class="t"><a class="l big" href="/job/1/">First <b>x</b></a></h2><a class="l">plain</a></div></body></html>"""


def test_html_helpers():
    text = html.visible_text(PAGE)
    assert "T & T" in text and "three <b>" in text and "note" not in text and "var a" not in text and "p{}" not in text
    block = html.list_sections(PAGE, "div.joblayouttoken.rtltextaligneligible.displayDTM")
    assert block["sections"] == ["abin", "in", "c"] and block["text"] == "abinnoc"
    assert html.list_sections("<div class='a'>x</div><div class='a'>y</div>", "div.a") == {"sections": [], "text": "y"}
    assert html.list_sections("<p>none</p>", "div.a") is None
    picked = html.selected_elements(PAGE, "div.x h2.t a.l")
    assert [(p["text"], p["href"]) for p in picked] == [("First x", "/job/1/")]
    assert [p["href"] for p in html.selected_elements(PAGE, "a.l")] == ["/job/1/", None]
    assert html.visible_text("<p>cut &am") == "cut &am" and html.visible_text(None) is None
    assert html.visible_text("a</p>b<img src=x>c") == "abc"


def test_generic_listing_by_id_and_text(spark):
    pages = spark.createDataFrame(
        [(1, '<a data-c="Firm" data-s="3.500,00">Job 12 </a><a>Job 13</a>'), (2, '<a data-c="Other">Job 12 again</a>')], "seq int, html string"
    )
    by_id = {r["posting_id"]: r for r in payloads.parse_generic_html(pages, "a", "s", with_id=True, company_attr="data-c", salary_attr="data-s").collect()}
    assert set(by_id) == {"12", "13"} and by_id["12"]["company"] == "Firm" and by_id["12"]["salary_versions"]["monthly"] == 3500
    by_text = {r["posting_id"] for r in payloads.parse_generic_html(pages, "a").collect()}
    assert by_text == {"Job 12", "Job 13", "Job 12 again"}


def test_listing_pages_and_details(spark):
    site = SourceConfig(name="s", search_base_url="https://s/?q=", jobs_base_url="https://s", link_selector="a.j")
    pages = spark.createDataFrame(
        [(1, "https://s/?q=ml&x", '<a class="j" href="/a/7/"> ML </a><a class="j" href="/a/noid">-</a>'),
         (2, "https://s/?q=data", '<a class="j" href="/b/7/">Again</a><a class="j" href="/a/8/">D</a>'),
         (3, "https://elsewhere", '<a class="j" href="/a/8/">D</a>')], "seq int, url string, html string")
    rows = {r["posting_id"]: r for r in payloads.parse_listing_html(pages, site, "Firm").collect()}
    assert set(rows) == {"s7", "s8"}
    assert (rows["s7"]["title"], rows["s7"]["url"], rows["s7"]["matched_titlewords"]) == ("ML", "https://s/a/7/", ["ml", "data"])
    assert rows["s8"]["matched_titlewords"] == ["data"]


def test_windows_line_ends_are_split_too(spark, tmp_path):
    postings = {f"k{i}": {"title": f"T {i}", "description": "two\\nlines"} for i in range(30)}
    (tmp_path / "w.json").write_bytes(json.dumps(postings, indent=4).replace("\n", "\r\n").encode())
    path = str(tmp_path / "w.json")
    chunks = spark.read.option("lineSep", snapshots.record_end(4, "\r\n")).text(path).count()
    rows = snapshots.read_snapshots(spark, path, newline="\r\n")
    assert chunks == 30 and {r["posting_id"] for r in rows.collect()} == set(postings)
    assert snapshots.read_snapshots(spark, path).count() == 30


def test_html_of_unclosed_tags_takes_linear_time():
    import time

    def seconds(n):
        page = "<nav><ul><li>" + "<p>text <b>x" * n + "<a href='u'>link</a>" * n
        start = time.process_time()
        assert len(html.selected_elements(page, "nav li a")) == n and len(html.visible_text(page)) == 10 * n
        return time.process_time() - start

    seconds(500)
    assert seconds(16000) < 16 * max(seconds(2000), 0.02)


def _snapshots_in(root, names):
    for i, name in enumerate(names):
        (root / name).write_text(json.dumps({f"p{i}": {"title": f"t{i}"}}, indent=4))


def test_nth_file_is_found_by_name_and_read_alone(spark, tmp_path):
    _snapshots_in(tmp_path, ["postings_2024-01-01.json", "postings_2024-03-01.json", "postings_2024-02-[1].json", "other.txt"])
    (tmp_path / "broken_2023.json").write_text("not json")  # would fail a scan that read it
    pick = lambda n, **k: snapshots.read_nth_file(spark, str(tmp_path), n, **k)
    assert [pick(n).first()["title"] for n in (0, 1, 2)] == ["t1", "t2", "t0"]
    assert pick(1, ascending=True).first()["title"] == "t0"
    assert pick(4) is None
    assert snapshots.list_files(spark, str(tmp_path)).columns == ["path", "modificationTime", "length"]


def test_nth_partition_has_a_literal_filter(spark, tmp_path):
    path = str(tmp_path / "table")
    rows = spark.createDataFrame([(i, f"s_{i % 4}") for i in range(40)], "id int, name string")
    snapshots.write_snapshot(rows, path, ("name",))
    df = snapshots.read_nth_partition(spark, path, "name", 1)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(name" in plan and "Join" not in plan
    assert {r["name"] for r in df.collect()} == {"s_2"}
    read = {f for f, in df.select("_metadata.file_path").distinct().collect()}
    assert read and all("name=s_2" in f for f in read)
    assert snapshots.read_nth_partition(spark, path, "name", 9).isEmpty()


def test_fields_outside_the_schema_survive(spark, tmp_path):
    posts = {
        "a": {"title": "t", "points": 2.5, "locations": ["Wien"], "team": "x", "deep": {"n": [1, {"k": "v}"}]}, "gone": None},
        "b": {"title": "u", "team": 7}, "c": {}, "d": None,
    }
    for name, indent in (("one_line.json", None), ("indented.json", 4)):
        folder = tmp_path / name
        folder.mkdir()
        (folder / name).write_text(json.dumps(posts, indent=indent))
        rows = snapshots.read_snapshots(spark, str(folder), others="others")
        plain = snapshots.read_snapshots(spark, str(folder))
        assert rows.drop("others").columns == plain.columns
        assert sorted(map(str, rows.drop("others").collect())) == sorted(map(str, plain.collect()))
        path = str(tmp_path / f"{name}_stored")
        snapshots.write_snapshot(rows, path)
        back = spark.read.parquet(path)
        got = {r["posting_id"]: r["o"] for r in back.selectExpr("posting_id", "to_json(others) AS o").collect()}
        assert json.loads(got["a"]) == {k: v for k, v in posts["a"].items() if k in ("team", "deep", "gone")}
        assert json.loads(got["b"]) == {"team": 7} and got["c"] == got["d"] == "{}"
        deep = back.where("posting_id = 'a'").selectExpr("variant_get(others['deep'], '$.n[1].k', 'string')").first()[0]
        assert deep == "v}"
        keys = {r["column_name"]: tuple(r)[1:] for r in snapshots.key_coverage(back, "others").collect()}
        assert keys == {"team": (2, True, False), "deep": (1, True, False), "gone": (0, False, False)}
    whole = spark.sql("""SELECT parse_json(j) AS v FROM VALUES ('{"k": 1}'), ('{"k": 2, "l": null}'), ('[1]'), (NULL) AS t(j)""")
    keys = {r["column_name"]: tuple(r)[1:] for r in snapshots.key_coverage(whole, "v").collect()}
    assert keys == {"k": (2, True, False), "l": (0, False, False)}
    all_ = {r["column_name"]: r["in_all"] for r in snapshots.key_coverage(whole.limit(2), "v").collect()}
    assert all_ == {"k": True, "l": False}
    assert snapshots.key_coverage(whole.limit(0), "v").isEmpty()
