"""Queries on sources and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cuts import own_folder
from ..functions import taxonomy
from ..operators import estimand, frames
from ..session import table
from ..sources import readers, sinks
from ..streaming import live
from . import reviews
from . import sql as S

SHOP = "http://shop.example"


def feed_records(spark: SparkSession, d: str) -> DataFrame:
    """The records of the complete lines of the feed."""
    f = table(spark, d, "review_feed").select("line_id", readers.parsed(F.col("payload"), readers.REVIEW).alias("r")).filter("r is not null")
    return f.select("line_id", "r.asin", "r.parent_asin", "r.user_id", "r.rating", "r.title", "r.text", "r.helpful_vote", "r.verified_purchase")


def feed_health(spark: SparkSession, d: str) -> DataFrame:
    """Lines and how many hold a record."""
    r = readers.parsed(F.col("payload"), readers.REVIEW)
    return table(spark, d, "review_feed").agg(F.count(F.lit(1)).alias("n_lines"), F.count(r).alias("n_records"))


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """A sitemap entry and a product page for every item, as a shop would serve them."""
    m = table(spark, d, "metadata").select("item_id", F.regexp_replace(F.coalesce("title", F.lit("")), r"[\\'\"<>&]", " ").alias("t"), F.regexp_replace(F.coalesce("parent_asin", F.lit("")), r"[^0-9A-Za-z]", "").alias("p"))
    loc = F.concat(F.lit(f" {SHOP}/slug/p/"), "p", F.lit("-"), F.col("item_id").cast("string"), F.lit("?x=1 "))
    xml = F.concat(F.lit('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>'), loc, F.lit(f"</loc></url><url><loc>{SHOP}/about</loc></url></urlset>"))
    html = F.concat(F.lit("<script>var d = {'pagetype': 'product', 'prodid': \""), F.col("item_id").cast("string"), F.lit("\", 'pname': '"), "t", F.lit("', \"baseProduct\": \""), "p", F.lit("\", 'cuff': ''};</script>"))
    return m.select("item_id", "t", "p", xml.alias("xml"), html.alias("html"))


def sitemap_urls(spark: SparkSession, d: str) -> DataFrame:
    """Locations in the sitemaps, over https, with their product code."""
    u = _pages(spark, d).select("item_id", F.explode(readers.sitemap_locations(F.col("xml"))).alias("u")).withColumn("url", readers.https(F.col("u")))
    return u.select("item_id", "url", readers.product_code(F.col("url")).alias("code"))


def catalogue_counts(spark: SparkSession, d: str) -> DataFrame:
    """URLs, products, variants and styles of the catalogue."""
    return readers.catalogue_counts(sitemap_urls(spark, d), "url")


def product_pages(spark: SparkSession, d: str) -> DataFrame:
    """Fields read from the product pages; a published empty value is empty, an absent one null."""
    p = _pages(spark, d).select("item_id", readers.page_fields(F.col("html")).alias("f"))
    return p.select("item_id", "f.prodid", "f.baseProduct", "f.pname", "f.cuff", "f.pgender")


#: What pages of the catalogue publish in turn, by item_id.
GENDERS = ["Erkek", "Kadın", "", "Kız Çocuk", "Kadın"]
CATEGORIES = ["Jean", "Tişört", "Gömlek", "Ayakkabı", "", "Şort", "Sweatshirt"]


def retail_scope(spark: SparkSession, d: str) -> DataFrame:
    """Pages of the catalogue by body half and by why they are left out."""
    nth = lambda names, c: F.element_at(F.array(*map(F.lit, names)), F.pmod(c, F.lit(len(names))).cast("int") + 1)
    m = table(spark, d, "metadata").select("item_id", nth(GENDERS, F.col("item_id")).alias("g"), nth(CATEGORIES, F.col("item_id")).alias("c"))
    kind = F.when(F.pmod("item_id", F.lit(11)) == 0, "category").otherwise("product")
    html = F.concat(F.lit("<script>var d = {'pagetype': '"), kind, F.lit("', 'pgender': '"), "g", F.lit("', \"pcat\": \""), "c", F.lit('"};</script>'))
    p = m.select(F.explode(F.array(readers.page_fields(html, ["pgender", "pcat"]))).alias("f"))  # read once, however often fields are used
    reason = taxonomy.retail_scope(F.col("f").isNotNull(), F.col("f.pgender"), F.col("f.pcat"))
    return p.select(reason.alias("reason"), taxonomy.retail_half(F.col("f.pcat")).alias("half")).groupBy("reason", "half").agg(F.count(F.lit(1)).alias("n"))


def url_lists(spark: SparkSession, d: str) -> DataFrame:
    """URLs and products of the catalogue's sitemap and of the sitemap of items still listed, as one list."""
    live_ = table(spark, d, "metadata").filter("removed_at is null").select("item_id")
    u = sitemap_urls(spark, d)
    both = readers.listed([u, u.join(live_, "item_id", "left_semi")], "url")
    return both.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("url").contains("/p/").cast("int")).alias("n_products"))


def _file(spark: SparkSession, name: str) -> str:
    return f"{own_folder(spark)}/{name}-{uuid.uuid4().hex}"


def gzip_feed(spark: SparkSession, d: str) -> DataFrame:
    """Ratings of the feed's records read back from compressed JSON lines."""
    path = _file(spark, "feed")
    table(spark, d, "review_feed").select("payload").filter("payload is not null").write.option("compression", "gzip").text(path)
    r = readers.json_lines(spark, path, readers.REVIEW, strict=False)
    return r.groupBy("rating").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("helpful_vote", F.lit(0))).alias("votes"))


def feed_prefix(spark: SparkSession, d: str) -> DataFrame:
    """The first 1,000 records of the feed, in the order of its lines, from one file of JSON lines."""
    path = _file(spark, "lines")
    lines = table(spark, d, "review_feed").filter("payload is not null").select("line_id", F.regexp_replace("payload", r"[\r\n]", " ").alias("value"))
    lines.orderBy("line_id").coalesce(1).select("value").write.text(path)
    one = readers.file_sizes(spark, f"{path}/part-*").first()["path"]
    return readers.scan(spark, one, readers.REVIEW, 1000).select("user_id", "asin", "rating")


def key_csv(spark: SparkSession, d: str) -> DataFrame:
    """Hand labels read back from CSV, the one row of each hash, counted."""
    path = _file(spark, "key")
    k = table(spark, d, "precision_key").filter("review_id_hash is not null").groupBy("review_id_hash").agg(F.max("human_label").alias("human_label"), F.max("review_text").alias("review_text"))
    sinks.write_csv(k, path)
    back = readers.csv_by_key(spark, path, "review_id_hash")
    return back.groupBy("human_label").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(F.coalesce("review_text", F.lit("")))).alias("n_chars"))


def store_map(spark: SparkSession, d: str) -> DataFrame:
    """The latest store of each parent as one JSON object, read back."""
    path = _file(spark, "stores")
    m = table(spark, d, "parent_store").filter("parent_asin is not null").groupBy("parent_asin").agg(F.max_by("store", F.struct("added_at", "store")).alias("store"))
    # the file is one object by its format, so it is written by one task
    m.agg(F.map_from_entries(F.collect_list(F.struct("parent_asin", "store"))).alias("m")).select(F.to_json("m", {"ignoreNullFields": "false"}).alias("value")).coalesce(1).write.text(path)
    return readers.json_map(spark, path).select(F.col("key").alias("parent_asin"), F.col("value").alias("store"))


def cluster_dump(spark: SparkSession, d: str) -> DataFrame:
    """Cluster sizes of every scenario written as a dump and loaded again."""
    path = _file(spark, "clusters")
    sinks.write_clusters(reviews.scenario_sizes(spark, d), path)
    return readers.cluster_dump(spark, path)


def survey_scores(spark: SparkSession, d: str) -> DataFrame:
    """Ratings as the steps of a size answer (a quarter each), by the score they stand for."""
    r = table(spark, d, "review").select(estimand.survey_score(F.col("rating") * 25).alias("score"))
    return r.groupBy("score").agg(F.count(F.lit(1)).alias("n"))


def censored_votes(spark: SparkSession, d: str) -> DataFrame:
    """Helpful votes cut at six, as a shop shows its stock."""
    r = table(spark, d, "review").filter("helpful_vote is not null").select(estimand.censored(F.col("helpful_vote")).alias("v"))
    return r.groupBy("v.level", "v.censored").agg(F.count(F.lit(1)).alias("n"))


def result_counts(spark: SparkSession, d: str) -> DataFrame:
    """Review totals read from response bodies, one per item with reviews."""
    n = table(spark, d, "review").filter("parent_asin is not null").groupBy("parent_asin").agg(F.count(F.lit(1)).alias("n"))
    body = F.to_json(F.struct(F.struct(F.col("n").alias("totalNumberOfResults")).alias("pagination")))
    return n.select("parent_asin", readers.result_count(body).alias("total"))


def stream_labels(spark: SparkSession, d: str) -> DataFrame:
    """Label counts kept by a stream over the review files."""
    return live.drained(live.label_counts(live.table_stream(spark, d, "review")), "labels")


def stream_in_scope(spark: SparkSession, d: str) -> DataFrame:
    """Labelled reviews of a stream joined to the static style index, as they were appended."""
    index = frames.style_index(table(spark, d, "metadata")).select("parent_asin", "gender", "half")
    joined = live.labelled_in_scope(live.table_stream(spark, d, "review"), index)
    return live.drained(joined, "scope", mode="append").select("review_id", "label", "gender", "half")


def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """Hourly event counts of a stream with a watermark, kept in complete mode."""
    flat = lambda b: b.select(F.col("w.start").alias("w_start"), "event_type", "n", F.round("total", 4).alias("total"))
    return live.drained(live.event_windows(live.table_stream(spark, d, "events")), "windows", keep=flat)


QUERIES = {f.__name__: f for f in (feed_records, feed_health, sitemap_urls, catalogue_counts, product_pages, retail_scope, url_lists, gzip_feed, feed_prefix, key_csv, store_map, cluster_dump, survey_scores, censored_votes, result_counts, stream_labels, stream_in_scope, stream_windows)}

_OK = "CASE WHEN json_valid(payload) THEN json_type(payload) = 'OBJECT' ELSE false END"
_P = "SELECT item_id, regexp_replace(coalesce(title, ''), '[\\\\''\"<>&]', ' ', 'g') AS t, regexp_replace(coalesce(parent_asin, ''), '[^0-9A-Za-z]', '', 'g') AS p FROM metadata"
_U = f"""WITH p AS ({_P}), u AS (SELECT item_id, 'https://shop.example/slug/p/' || p || '-' || item_id || '?x=1' AS url, p || '-' || item_id AS code, p FROM p UNION ALL SELECT item_id, 'https://shop.example/about', NULL, NULL FROM p)"""
_NTH = lambda names, c: f"list_value({', '.join(S.q(x) for x in names)})[{c} % {len(names)} + 1]"
ORACLE = {
    "retail_scope": f"""WITH p AS (SELECT item_id % 11 <> 0 AS ok, {_NTH(GENDERS, 'item_id')} AS g, {_NTH(CATEGORIES, 'item_id')} AS c FROM metadata)
SELECT CASE WHEN NOT ok THEN 'no-metadata-block' WHEN g = '' THEN 'missing-gender' WHEN g NOT IN ('Erkek', 'Kadın') THEN 'non-adult-gender:' || g WHEN c = '' THEN 'missing-category' WHEN c = 'Ayakkabı' THEN 'off-category:' || c ELSE 'keep' END AS reason,
CASE WHEN NOT ok THEN 'other' WHEN c IN ('Tişört', 'Gömlek', 'Sweatshirt') THEN 'upper' WHEN c IN ('Jean', 'Şort') THEN 'lower' ELSE 'other' END AS half, count(*) AS n FROM p GROUP BY 1, 2""",
    "url_lists": "SELECT 0 AS list, 2 * count(*) AS n, count(*) AS n_products FROM metadata UNION ALL SELECT 1, 2 * count(*), count(*) FROM metadata WHERE removed_at IS NULL",
    "gzip_feed": f"SELECT (payload->>'$.rating')::DOUBLE AS rating, count(*) AS n, sum(coalesce((payload->>'$.helpful_vote')::BIGINT, 0)) AS votes FROM review_feed WHERE {_OK} GROUP BY 1",
    "feed_prefix": f"SELECT payload->>'$.user_id' AS user_id, payload->>'$.asin' AS asin, (payload->>'$.rating')::DOUBLE AS rating FROM review_feed WHERE {_OK} ORDER BY line_id LIMIT 1000",
    "key_csv": "WITH k AS (SELECT review_id_hash, max(human_label) AS human_label, max(review_text) AS t FROM precision_key WHERE review_id_hash IS NOT NULL GROUP BY 1) SELECT human_label, count(*) AS n, sum(length(coalesce(t, ''))) AS n_chars FROM k GROUP BY 1",
    "store_map": "SELECT parent_asin, store FROM parent_store WHERE parent_asin IS NOT NULL QUALIFY row_number() OVER (PARTITION BY parent_asin ORDER BY added_at DESC, store DESC NULLS LAST) = 1",
    "cluster_dump": reviews.ORACLE["scenario_sizes"],
    "survey_scores": "SELECT CASE rating WHEN 1 THEN -1.0 WHEN 2 THEN 0.0 WHEN 3 THEN 1.0 WHEN 4 THEN 1.0 END AS score, count(*) AS n FROM review GROUP BY 1",
    "censored_votes": "SELECT least(helpful_vote, 6) AS level, helpful_vote >= 6 AS censored, count(*) AS n FROM review WHERE helpful_vote IS NOT NULL GROUP BY 1, 2",
    "feed_records": f"""SELECT line_id, payload->>'$.asin' AS asin, payload->>'$.parent_asin' AS parent_asin, payload->>'$.user_id' AS user_id, (payload->>'$.rating')::DOUBLE AS rating, payload->>'$.title' AS title, payload->>'$.text' AS text,
(payload->>'$.helpful_vote')::BIGINT AS helpful_vote, (payload->>'$.verified_purchase')::BOOLEAN AS verified_purchase FROM review_feed WHERE {_OK}""",
    "feed_health": f"SELECT count(*) AS n_lines, count(*) FILTER ({_OK}) AS n_records FROM review_feed",
    "sitemap_urls": f"{_U} SELECT item_id, url, code FROM u",
    "catalogue_counts": f"{_U} SELECT count(*) AS n_urls, count(code) AS n_products, count(code) AS n_coded, count(DISTINCT code) AS n_variants, count(DISTINCT p) AS n_styles FROM u",
    "product_pages": f"WITH p AS ({_P}) SELECT item_id, item_id::VARCHAR AS prodid, p AS \"baseProduct\", trim(t, ' \t\n\r') AS pname, '' AS cuff, NULL::VARCHAR AS pgender FROM p",
    "result_counts": "SELECT parent_asin, count(*) AS total FROM review WHERE parent_asin IS NOT NULL GROUP BY 1",
    "stream_labels": f"WITH {S.labelled('review', 'title', 'text')} SELECT label, count(*) AS n, sum(coalesce(verified_purchase, false)::INT) AS n_verified FROM lab GROUP BY 1",
    "stream_in_scope": f"{S.JOINED} SELECT review_id, label, gender, half FROM obs WHERE {S.IN_BUCKETS}",
    "stream_windows": "SELECT date_trunc('hour', ts) AS w_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
}
