import json
import struct
import time
import zlib

import pytest
from pyspark.sql import functions as F

from reviewmill.functions import urls
from reviewmill.jobs import store_queries
from reviewmill.jobs.queries import ORACLES, QUERIES
from reviewmill.operators import images, ledger, pages, requests
from reviewmill.sources import tables
from reviewmill.streaming import logs
from reviewmill.streaming.logs import merge_batch, read_snapshot, request_windows, upsert_stream

PAGE = """<html lang="en"><head><title>T</title></head><body><a id="bylineInfo">Visit the Acme Store</a><span id="productTitle"> Lamp </span>
<div id="corePriceDisplay_desktop_feature_div"><span class="a-price"><span class="a-offscreen">$12.50</span></span></div>
<span class="a-icon-alt">4.5 out of 5 stars</span><span id="acrCustomerReviewText">1,234 ratings</span>
<table><tr><th>Best Sellers Rank</th><td><ul><li>#1,070 in Home (See Top 100)</li><li>#3 in Lamps</li></ul></td></tr><tr><th>Date First Available</th><td>2024-09-22</td></tr></table>
<li class="swatchElement selected" title="Click to select Red"></li><li class="swatchElement"></li>
<div id="feature-bullets"><span class="a-list-item">short</span><span class="a-list-item">long enough to count</span></div>
<img id="landingImage" src="https://m.media-amazon.com/images/I/x._AC_SX679_.jpg" data-a-dynamic-image='{"https://a.example/1.jpg":[1,2]}'>
<script type="text/javascript">var x = {"hiRes":"https:\\/\\/h.example\\/1.jpg"};</script>
<div id="aplus"><img src="//d.example/aplus-media-library-service-media/1.jpg"><div class="comparison-table"><img src="https://d.example/aplus-media-library-service-media/2.jpg"></div>
<a href="/dp/B000000002"><img src="https://d.example/aplus-media-library-service-media/3.jpg"></a></div></body></html>"""


def test_product_rows(spark):
    df = spark.createDataFrame([("B000000001", "u", PAGE), ("B2", "u", None), ("B3", "u", "Enter the characters you see below"), ("B4", "u", "<p>")], "asin string, url string, html string")
    got = {r.asin: r for r in pages.product_rows(df).collect()}
    r = got["B000000001"]
    assert (r.brand, r.title, r.price, r.rating, r.review_count, r.bsr_rank) == ("Acme", "Lamp", "$12.50", 4.5, 1234, "1,070")
    assert (r.main_category, r.main_category_rank, r.sub_category, r.sub_category_rank) == ("Home", "1,070", "Lamps", "3")
    assert (r.launch_date, r.variant_count, r.best_selling_color, r.bullet_points, r.status) == ("2024-09-22", 2, "Red", ["long enough to count"], "success")
    assert [got[k].error for k in ("B2", "B3", "B4")] == ["no page", "verification page", None]
    assert got["B4"].title is None and got["B4"].bullet_points == []


@pytest.mark.parametrize("html", [
    '<div id="aplus"><img src="https://d.example/aplus-media-library-service-media/1.jpg">' * 400, "<span>x" * 3000, "<li>#y" * 3000, "<th>z" * 3000, "<span>x</b>" * 5000, "<div class='comparison-table'><a href='x'>" * 3000,
])
def test_nested_pages_are_linear(html):
    def took(text):
        best = []
        for _ in range(3):
            began = time.process_time()
            pages.flatten(text)
            best.append(time.process_time() - began)
        return min(best)

    once = took(html)
    assert once < 1 and took(html * 4) < 8 * once + 0.05


def test_fragments_and_broken_pages(spark):
    rows = [
        (0, "<th>Brand</th><td>Acme</td><span>上架时间: <b>x</b></span> 2023-01-01", None), (1, None, "a"), (2, "", "a"), (3, "<li", "a"), (4, "<li class=swatchElement title='Click to select X'><li>#3 in Home</p></b>", "a"),
        (5, '<div id="aplus"><img src="//d.example/aplus-media-library-service-media/1.jpg"><div id="aplus_feature_div"><img data-src="https://d.example/aplus-media-library-service-media/2.jpg"></div></div>'
            '<div id="aplus"><img src="//d.example/aplus-media-library-service-media/1.jpg"><a href="/DP/bother0002"><a><img src="https://d.example/aplus-media-library-service-media/3.jpg"></a></a></div>', "AOTHER0001"),
    ]
    got = {r.i: r.page for r in pages.parse_pages(spark.createDataFrame(rows, "i int, html string, asin string")).collect()}
    assert got[0].brand == "Acme" and got[0].launch_text == "Brand Acme 上架时间: x 2023-01-01"
    assert all(got[i].title is None and got[i].bullets == [] and got[i].problem is None for i in (1, 2, 3))
    assert got[4].color_title == "Click to select X" and got[4].ranks == ["#3 in Home"] * 2 and got[4].variants == 1
    assert got[5].detail_images == [f"https://d.example/aplus-media-library-service-media/{i}.jpg" for i in (1, 2)]


def test_candidates(spark):
    df = spark.createDataFrame([("B000000001", PAGE)], "asin string, html string")
    strict = pages.page_candidates(df).first().candidates
    assert strict == ["https://h.example/1.jpg", "https://d.example/aplus-media-library-service-media/1.jpg"]
    loose = pages.page_candidates(df, strict=False).first().candidates
    assert loose[:2] == strict and set(loose[2:]) == {"https://a.example/1.jpg", "https://m.media-amazon.com/images/I/x._AC_SX679_.jpg"}


def test_upgrade(spark):
    cells = ["x._AC_SX679_.jpg", "x.jpg", "x._SL1500_.jpg"]
    df = spark.createDataFrame([(c,) for c in cells], "u string")
    got = [tuple(r) for r in df.select(urls.upgrade(F.col("u")), urls.url_key(urls.upgrade(F.col("u")))).collect()]
    assert got == [("x._SL1500_.jpg", "x.jpg"), ("x_SL1500_.jpg", "x_SL1500_.jpg"), ("x._SL1500__SL1500_.jpg", "x.jpg")]
    rows = spark.createDataFrame([("p", ["https://a/1._AC_SX679_.jpg", "https://a/1._AC_SY300_.jpg", "https://a/2.jpg", "https://a/3.jpg"])], "asin string, found array<string>")
    assert [(r.idx, r.file_name) for r in images.image_rows(rows, "found", 3).orderBy("idx").collect()] == [(1, "p_01.jpg"), (2, "p_02.jpg")]


def png(w, h):
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IEND", b"")


def test_images(spark, tmp_path):
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x0b\x08\x00\xc8\x00\xc8\x01\x01\x11\x00\xff\xd9"
    files = {"a/1.png": png(200, 200), "a/2.jpg": jpeg, "3.png": png(50, 50), "4.png": png(200, 200)[:20], "5.jpg": b"text", "6.txt": b"no"}
    for name, data in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    checked = images.check_images(tables.read_images(spark, str(tmp_path)))
    assert {r.path.rsplit("/", 1)[1]: r.status for r in checked.collect()} == {"1.png": "valid", "2.jpg": "valid", "3.png": "small", "4.png": "corrupt", "5.jpg": "corrupt"}
    assert tuple(images.image_report(checked).first())[:4] == (5, 2, 3, 1)


def test_images_are_read_at_their_ends(spark, tmp_path):
    for kind in store_queries.KINDS:
        (tmp_path / f"{kind.replace(' ', '_')}.{kind.split()[-1]}").write_bytes(store_queries.image_bytes(kind, 300, 200, 3_000_000))
    (tmp_path / "many.jpg").write_bytes(b"\xff\xd8" + b"\xff\xe1\x00\x04ab" * 5000 + b"\xff\xc0\x00\x0b\x08\x00\xc8\x00\xc8\x01\x01\x11\x00\xff\xd9")
    files = tables.read_images(spark, str(tmp_path))
    assert "content" not in files._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]  # no file is opened by the scan
    checked = images.check_images(files).collect()
    assert max(r.n_read for r in checked) <= images.HEAD + images.TAIL + 9 * images.SEGMENTS
    got = {r.path.rsplit("/", 1)[1]: (r.status, r.width, r.height) for r in checked}
    whole, broken = ("valid", 300, 200), ("corrupt", None, None)
    assert got == {"png.png": whole, "jpg.jpg": whole, "webp.webp": whole, "cut_png.png": broken, "text_jpg.jpg": broken, "gone_bad_jpg.jpg": broken, "padded_png.png": whole, "many.jpg": broken}
    content = images.check_images(tables.read_images(spark, str(tmp_path), content=True)).collect()
    assert {r.path.rsplit("/", 1)[1]: (r.status, r.width, r.height) for r in content} == got
    assert images.probe_file(f"file:{tmp_path}/gone.png", 100) == (None, 0)


def test_completeness(spark):
    df = spark.createDataFrame([("a", "", 0, ["x"]), ("b", "t", 2, []), ("c", None, None, None)], "asin string, title string, n int, bullets array<string>")
    assert {r.field: (r.filled, r.percent) for r in ledger.completeness(df, ["asin", "title", "n", "bullets"]).collect()} == {"asin": (3, 100.0), "title": (1, 33.3), "n": (1, 33.3), "bullets": (1, 33.3)}


def test_product_upsert(spark):
    kind = "asin string, title string, url string, created_at timestamp, updated_at timestamp"
    old = spark.sql("select 'a' asin, 't' title, 'u' url, timestamp'2024-01-01' created_at, timestamp'2024-01-01' updated_at")
    new = spark.sql("select 'a' asin, cast(null as string) title, 'u2' url, timestamp'2024-02-01' created_at, timestamp'2024-02-01' updated_at")
    r = ledger.upsert_products(old, new).first()
    assert (r.title, r.url, str(r.created_at)[:10], str(r.updated_at)[:10]) == ("t", "u2", "2024-01-01", "2024-02-01") and kind


def test_sources(spark, tmp_path):
    (tmp_path / "ids.txt").write_text("A1\n\n A2 \nA1")
    assert sorted(r.asin for r in tables.read_ids(spark, str(tmp_path / "ids.txt")).collect()) == ["A1", "A1", "A2"]
    df = spark.createDataFrame([(1, "x", "k")], "`评论（内容）` int, __tmp string, category string")
    assert tables.resolve_column(df, "评论(内容)") == "评论（内容）"
    with pytest.raises(ValueError, match="nope, other"):
        tables.require_columns(df, ["category", "nope", "other"])


def test_readers_and_reports(spark, tmp_path):
    (tmp_path / "r.csv").write_text('content,star,extra\n"two\nlines",4,x\n,,\n')
    got = tables.read_reviews(spark, str(tmp_path / "r.csv"))
    assert got.columns == ["content", "star", "extra"] and [tuple(r) for r in got.collect()] == [("two\nlines", "4", "x"), (None, None, None)]
    got.write.json(str(tmp_path / "r.json"))
    assert tables.read_reviews(spark, str(tmp_path / "r.json")).filter("star = '4'").first().content == "two\nlines"
    (tmp_path / "pages").mkdir()
    (tmp_path / "pages" / "a.html").write_text("<p>\n</p>")
    assert [(r.path.rsplit("/", 1)[1], r.html) for r in tables.read_pages(spark, str(tmp_path / "pages")).collect()] == [("a.html", "<p>\n</p>")]
    assert tables.keep_columns(got, [["star", "nope"], ["content"]]).columns == ["star", "content"]


def test_late_requests_are_dropped(spark, tmp_path):
    log = lambda minutes: spark.sql(" union all ".join(f"select 'u' url, 200 status_code, 1.0D response_time, timestamp'2024-01-01 10:00:00' + make_dt_interval(0, 0, {m}, 0) created_at" for m in minutes))
    for minutes in ((0, 3, 40), (41, 4), (60,)):
        log(minutes).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
        stream = spark.readStream.schema(log([0]).schema).parquet(str(tmp_path / "log"))
        q = request_windows(stream, "10 minutes", "5 minutes").writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).format("parquet").option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        q.awaitTermination(60)
    got = {(str(r.start)[11:16], r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("09:55", 2), ("10:00", 2), ("10:35", 2), ("10:40", 2)}  # minute 4 came after the watermark had passed its windows


def test_streams_equal_batch(spark, tmp_path):
    log = spark.sql("select concat('u', id) url, 200 + cast(id % 2 as int) status_code, id * 1.5D response_time, timestamp'2024-01-01' + make_dt_interval(0, 0, 0, id * 20) created_at from range(60)")
    log.write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(log.schema).parquet(str(tmp_path / "log"))
    q = request_windows(stream, "5 minutes", None).writeStream.outputMode("complete").format("memory").queryName("rates").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(spark.table("rates").collect()) == sorted(request_windows(log, "5 minutes", None).collect())
    rows = spark.sql("select cast(id % 5 as string) asin, 'i' image_url, case when id > 10 then 'success' else 'failed' end status, timestamp'2024-01-01' + make_dt_interval(0, 0, 0, id) created_at, id seq from range(20)")
    rows.repartition(3).write.parquet(str(tmp_path / "results"))
    results = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "results"))
    upsert_stream(results, str(tmp_path / "ledger"), str(tmp_path / "cp")).awaitTermination(120)
    got = read_snapshot(spark, str(tmp_path / "ledger")).select(*rows.columns)
    assert sorted(got.collect()) == sorted(ledger.latest_downloads(rows).collect())
    # a new checkpoint: the stream's rows come again, and five more; nothing is lost or doubled
    more = spark.sql("select cast(id as string) asin, 'j' image_url, 'success' status, timestamp'2024-01-01' created_at, id seq from range(5)")
    more.coalesce(1).write.parquet(str(tmp_path / "results" / "more"))
    results = spark.readStream.schema(rows.schema).option("recursiveFileLookup", True).parquet(str(tmp_path / "results"))
    upsert_stream(results, str(tmp_path / "ledger"), str(tmp_path / "cp2")).awaitTermination(120)
    got = read_snapshot(spark, str(tmp_path / "ledger")).select(*rows.columns)
    assert sorted(got.collect()) == sorted(ledger.latest_downloads(rows.unionByName(more)).collect())


def test_ledger_rewrites_only_touched_buckets(spark, tmp_path):
    path = str(tmp_path / "ledger")
    rows = lambda n, status: spark.sql(f"select concat('p', id) asin, 'i' image_url, '{status}' status, timestamp'2024-01-01' + make_dt_interval(0, 0, 0, {n}) created_at, {n}L seq from range(200)")
    merge_batch(rows(0, "failed"), path)
    for n in range(1, 5):
        merge_batch(rows(n, "success").filter("asin = 'p7'"), path)
    merge_batch(rows(9, "x").limit(0), path)
    got = read_snapshot(spark, path)
    assert got.count() == 200 and [(r.asin, r.seq) for r in got.filter("status = 'success'").collect()] == [("p7", 4)]
    assert sorted(int(x.name[:-5]) for x in (tmp_path / "ledger/_snapshots").glob("*.json")) == [3, 4]
    versions = {x.name: len(list(x.glob("bucket=*"))) for x in (tmp_path / "ledger").glob("v=*")}
    assert versions["v=3"] == versions["v=4"] == 1 and set(versions) == {"v=0", "v=3", "v=4"} and versions["v=0"] < logs.BUCKETS


def test_rate_audit(spark):
    log = spark.sql("select 'h' host, timestamp'2024-01-01' + make_dt_interval(0, 0, 0, id * 10) created_at from range(30)")
    got = requests.over_limit(log, "host", most=6, seconds=60).orderBy("created_at").collect()
    assert [r.in_span for r in got] == [min(i + 1, 7) for i in range(30)] and sum(r.over for r in got) == 24


def test_hires_reads_the_page(spark, tmp_path):
    pages_of = [(1, '<p>"hiRes":"https://img.example/stored.jpg"</p>'), (2, None)]
    spark.createDataFrame(pages_of, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r.urls for r in QUERIES["sc22_hires"](spark, str(tmp_path)).collect()}
    assert got[1] == "[https://img.example/stored.jpg, https://img.example/1.jpg, https://b.example/?a=1&b=1]"
    assert got[2] == "[https://img.example/2.jpg, https://b.example/?a=1&b=2]"


def test_lists_of_a_large_product(spark):
    rows = spark.range(3000).selectExpr("'p' as asin", "concat('u', lpad(id % 1500, 4, '0')) as image_url", "if(id < 2000, 'failed', 'success') as status", "if(id % 2 = 0, 'late', null) as error_message")
    rows = rows.unionByName(spark.sql("select 'q' as asin, cast(null as string) as image_url, 'skipped' as status, 'late' as error_message"))
    assert [(r.asin, r.found) for r in images.first_urls(rows, 9).collect()] == [("p", [f"u{i:04}" for i in range(9)])]
    p, q = ledger.download_results(rows).orderBy("asin").collect()
    assert tuple(p) == ("p", 3000, 1000, 2000, 0) and tuple(q) == ("q", 1, 0, 0, 1)
    assert sorted(map(tuple, ledger.download_errors(rows).collect())) == [("p", "Unknown error", 1000), ("p", "late", 1000)]


def test_results_hold_all_error_texts(spark, tmp_path):
    rows = spark.range(3000).selectExpr("'p' as asin", "if(id < 2000, 'failed', 'success') as status", "if(id % 2 = 0, 'late', null) as error_message")
    rows = rows.unionByName(spark.sql("select 'q' as asin, 'skipped' as status, 'late' as error_message union all select null, 'failed', '' union all select null, 'failed', 'b' union all select null, null, 'c'"))
    got = {r.asin: tuple(r)[1:] for r in ledger.results_with_errors(rows).collect()}
    assert got == {"p": (3000, 1000, 2000, 0, "; ".join(["Unknown error"] * 1000 + ["late"] * 1000)), "q": (1, 0, 0, 1, ""), None: (3, 0, 2, 0, "; b")}
    items = [(7, 1, 5, "A"), (7, 2, 2, "A"), (7, 3, 2, "A"), (7, 4, 2, "N"), (8, 5, 1, "R")]
    spark.createDataFrame([(*r, 1.0, 0.0, 1.0) for r in items], "l_partkey long, l_orderkey long, l_linenumber int, l_returnflag string, l_quantity double, l_discount double, l_extendedprice double").selectExpr("*", "date'2024-01-01' as l_shipdate").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r.asin: r.asDict() for r in QUERIES["a17_download_results"](spark, str(tmp_path)).collect()}
    assert got["7"] == {"asin": "7", "total": 4, "success": 1, "failed": 3, "skipped": 0, "errors": "HTTP 403; HTTP 403; Unknown error"} and got["8"]["errors"] == ""


def test_page_fields_equal_their_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    texts = ["a &amp; b", "cut &amp", "cut &a", "say &quot;x&quot;", "&amp;quot; &amp;amp; &amp&amp;", "&#38; &lt;b&gt; &nbsp; &copy 1", "", "&"]
    html = [f'<html lang="en"><head><title>{t}</title></head><body><h1>{t}</h1><a href="x&amp;y">{t}</a></body></html>' for t in texts]
    spark.createDataFrame(list(enumerate([*html, "<p>none</p>", "", None])), "page_id long, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted(map(tuple, QUERIES["h5_page_fields"](spark, str(tmp_path)).select("page_id", "lang", "links", "page_title", "heading").collect()))
    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    assert got == sorted(con.execute(f"select page_id, lang, links, page_title, heading from ({ORACLES['h5_page_fields']})").fetchall())
