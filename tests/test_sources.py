"""Readers, sinks and streams on small files."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from seamline.functions import taxonomy
from seamline.sources import readers, sinks
from seamline.streaming import live


def test_locate():
    assert readers.locate("/r", "raw_review_X", "X") == "/r/raw/review_categories/X.jsonl"
    assert readers.locate("/r", "raw_meta_X", "X") == "/r/raw/meta_categories/meta_X.jsonl"
    with pytest.raises(ValueError, match="unknown config"):
        readers.locate("/r", "other", "X")


LINES = [json.dumps({"rating": k % 5, "title": f"t{k}", "verified_purchase": True, "timestamp": 1600000000000 + k}) for k in range(20)]


def test_json_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("\n".join([*LINES, "", ""]))
    assert readers.json_lines(spark, str(tmp_path / "a.jsonl"), readers.REVIEW).count() == 20
    assert readers.json_lines(spark, str(tmp_path / "a.jsonl"), readers.REVIEW, limit=7).count() == 7
    (tmp_path / "b.jsonl").write_text("\n".join([*LINES, '{"rating": 1, "ti']))
    assert readers.json_lines(spark, str(tmp_path / "b.jsonl"), readers.REVIEW, strict=False).count() == 20
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.json_lines(spark, str(tmp_path / "b.jsonl"), readers.REVIEW).collect()
    with gzip.open(tmp_path / "c.jsonl.gz", "wt") as f:
        f.write("\n".join(LINES))
    assert readers.json_lines(spark, str(tmp_path / "c.jsonl.gz"), readers.REVIEW).count() == 20
    assert readers.file_sizes(spark, str(tmp_path / "*.jsonl")).agg(F.sum("bytes").alias("b")).first().b == sum(p.stat().st_size for p in tmp_path.glob("*.jsonl"))


def test_byte_blocks(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("\n".join(LINES * 500))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        got = readers.byte_blocks(spark, str(tmp_path / "a.jsonl"), readers.REVIEW, 31, 3).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted(r.block for r in got) == sorted([0, 1, 2] * 10)


def test_byte_ranges_and_scan(spark, tmp_path):
    lines = [*LINES[:5], "", '{"rating": 1, "ti', "[1]", *LINES[5:]]
    raw = "\n".join(lines)
    path = tmp_path / "r.jsonl"
    path.write_text(raw)
    title = lambda df: [r.title for r in df.orderBy("offset").collect()]
    for offset in (0, 1, len(LINES[0]), len(LINES[0]) + 1, len(LINES[0]) + 2, len(raw) - 1, len(raw), len(raw) + 9):
        skipped = sum(1 for k in range(len(lines)) if (sum(len(x) + 1 for x in lines[:k]) < offset))
        want = [x for x in lines[skipped:] if x in LINES][:7]
        assert title(readers.byte_ranges(spark, str(path), readers.REVIEW, [offset], 7)) == [json.loads(x)["title"] for x in want], offset
    assert title(readers.scan(spark, str(path), readers.REVIEW, 6)) == [f"t{k}" for k in range(6)]
    spread = readers.scan(spark, str(path), readers.REVIEW, 9, "spread", 4).groupBy("offset").count().collect()
    assert len(spread) == 4 and all(r["count"] == 2 for r in spread)
    with pytest.raises(ValueError, match="sampling"):
        readers.scan(spark, str(path), readers.REVIEW, 9, "other")
    (tmp_path / "none.jsonl").write_text("")
    assert readers.scan(spark, str(tmp_path / "none.jsonl"), readers.REVIEW, 5).count() == 0


def test_retail_scope(spark):
    rows = [(None, None, None), (True, None, "Jean"), (True, "", "Jean"), (True, "Kız Çocuk", "Jean"), (True, "Erkek", ""), (True, "Erkek", "Çanta"), (True, "Kadın", "Bluz")]
    df = spark.createDataFrame(rows, "b boolean, g string, c string")
    got = [tuple(r) for r in df.select(taxonomy.retail_scope(F.col("b"), F.col("g"), F.col("c")), taxonomy.retail_half(F.col("c"))).collect()]
    assert got == [
        ("no-metadata-block", "other"), ("missing-gender", "lower"), ("missing-gender", "lower"), ("non-adult-gender:Kız Çocuk", "lower"), ("missing-category", "other"),
        ("off-category:Çanta", "other"), ("keep", "upper"),
    ]


def test_csv_and_map(spark, tmp_path):
    (tmp_path / "k.csv").write_text('id,label\na,1\nb,"x, ""y"""\na,2\n')
    assert {(r.id, r.label) for r in readers.csv_by_key(spark, str(tmp_path / "k.csv"), "id").collect()} == {("a", "2"), ("b", 'x, "y"')}
    (tmp_path / "m.json").write_text('{"p": "s",\n "q": null}')
    assert {tuple(r) for r in readers.json_map(spark, str(tmp_path / "m.json")).collect()} == {("p", "s"), ("q", None)}
    assert readers.json_map(spark, str(tmp_path / "none.json")).count() == 0


def test_pages(spark):
    html = """<x>'pagetype': 'product', "prodid":"1-2", 'pname' : 'it\\'s "so"', 'cuff': "", 'pcat': " Jean "</x>"""
    df = spark.createDataFrame([(html,), ("<x>'prodid': '1'</x>",), (None,)], "h string").select(readers.page_fields(F.col("h")).alias("f"))
    f = [r.f for r in df.collect()]
    assert (f[0].prodid, f[0].pname, f[0].cuff, f[0].pcat, f[0].sleeve) == ("1-2", "it\\'s \"so\"", "", "Jean", None)
    assert f[1] is None and f[2] is None


def test_sitemaps(spark):
    ns = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
    index = f"<sitemapindex {ns}><sitemap><loc> http://a/x.xml </loc></sitemap><sitemap><loc></loc></sitemap></sitemapindex>"
    df = spark.createDataFrame([(index,)], "x string")
    assert df.select(readers.sitemap_locations(F.col("x"), "sitemap").alias("l"), readers.sitemap_locations(F.col("x")).alias("u")).first().asDict() == {"l": ["http://a/x.xml"], "u": []}
    urls = spark.createDataFrame([("https://a/s/p/1-2?q",), ("https://a/p/1-3",), ("https://a/p/1-3#z",), ("https://a/b",), ("http://a/p/",)], "u string")
    c = readers.catalogue_counts(urls, "u").first()
    assert (c.n_urls, c.n_products, c.n_coded, c.n_variants, c.n_styles) == (5, 4, 3, 2, 1)
    assert urls.select(readers.https(F.col("u")).alias("u")).collect()[4].u == "https://a/p/"


def test_result_count(spark):
    df = spark.createDataFrame([('{"pagination": {"totalNumberOfResults": 7}}',)], "p string")
    assert df.select(readers.result_count(F.col("p")).alias("n")).first().n == 7
    with pytest.raises(Exception, match="totalNumberOfResults"):
        spark.createDataFrame([("{}",)], "p string").select(readers.result_count(F.col("p")).alias("n")).collect()


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("h2", "a,b", "secret"), ("h1", 'q"r', "secret")], "review_id_hash string, review_text string, assigned_bucket string")
    sinks.write_blind_sample(df, str(tmp_path / "s"))
    blind = readers.csv_by_key(spark, str(tmp_path / "s_blind"), "review_id_hash")
    assert "assigned_bucket" not in blind.columns and {r.review_text for r in blind.collect()} == {"a,b", 'q"r'}
    assert set(readers.csv_by_key(spark, str(tmp_path / "s_key"), "review_id_hash").columns) == set(df.columns)
    sinks.write_json_lines(df, str(tmp_path / "j"), "review_id_hash")
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.write_once(df, str(tmp_path / "j"))


def test_streams(spark, data):
    events = spark.read.parquet(f"{data}/events.parquet")
    out = live.drained(live.sessions(live.table_stream(spark, data, "events"), "30 minutes"), "sessions", keep=lambda b: b.select("user_id", "n"))
    assert out.agg(F.sum("n").alias("n")).first().n == events.count()


def test_parsed_lines(spark):
    lines = ['{"rating": 5, "title": "a"}', '{"title": "a", "rating"', "[]", "null", "", None, ' {"asin": "x"} ']
    df = spark.createDataFrame([(x,) for x in lines], "p string").select(readers.parsed(F.col("p"), readers.REVIEW).alias("r"))
    assert [r.r is not None for r in df.collect()] == [True, False, False, False, False, False, True]
