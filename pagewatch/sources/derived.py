"""Input tables derived from the provided ``pages``, ``documents`` and ``events`` tables.

Every row of the provided table takes part. The definitions are those of FIXTURES.md.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F

from pagewatch.functions.urls import normalize_url
from pagewatch.operators.watchlist import wall_time
from pagewatch.sources.captures import normalize_captures, spread

AS_OF = dt.datetime(2024, 1, 30, 23, 30, 0)
CHECK_INTERVAL = 3600


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def page_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page captured in cycles 1, 2 and 3, with a change chosen by its number."""
    pages = spread(table(spark, sf_dir, "pages"))
    k = F.col("page_id") % 12
    cycle = F.col("cycle_no")
    v = cycle.cast("string")
    html = F.col("html")
    keywords = "privacy terms rights " * 60

    def swap(old: str, *new) -> F.Column:
        parts = [F.lit(p) if isinstance(p, str) else p for p in new]
        return F.replace(html, F.lit(old), F.concat(*parts))

    body = (
        F.when((k == 1) & (cycle >= 2), swap("<title>", "<title>Updated "))
        .when(k == 2, swap("<head>", '<head><meta name="description" content="rev ', v, '">'))
        .when((k == 5) & (cycle >= 2), swap("</article>", f"<p>{keywords}</p></article>"))
        .when(k == 6, swap("</article>", "<p>Version: 2.", v, "</p></article>"))
        .when(
            k == 8,
            swap(
                "</head>",
                '<script type="application/ld+json">{"@type":"SoftwareApplication","version":"',
                v,
                '","name":"m"}</script></head>',
            ),
        )
        .when((k == 9) & (cycle == 2), F.lit(None).cast("string"))
        .when(
            k == 10,
            swap(
                "<head>", '<head><meta property="og:title" content="t', v,
                '"><link rel="canonical" href="/p/', v, '">',
            ),
        )
        .when((k == 11) & (cycle >= 2), swap("</article>", "<h2>New</h2><form></form></article>"))
        .otherwise(html)
    )
    lost = (k == 9) & (cycle == 2)
    stamp = F.when(k == 7, F.concat(F.lit("v"), v)).otherwise(F.lit("v0"))
    captured_at = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(cycle)
    rows = pages.withColumn("cycle_no", F.explode(F.sequence(F.lit(1), F.lit(3))))
    return normalize_captures(
        rows.select(
            "page_id",
            "cycle_no",
            "url",
            captured_at.alias("captured_at"),
            F.when((k == 3) & (cycle >= 2), F.lit(404))
            .when(lost, F.lit(None).cast("int"))
            .otherwise(F.lit(200))
            .alias("status_code"),
            F.when(
                ~lost,
                F.create_map(
                    F.lit("Content-Type"), F.lit("text/html; charset=utf-8"),
                    F.lit("ETag"), stamp,
                    F.lit("Last-Modified"), stamp,
                ),
            ).alias("headers"),
            F.when((k == 4) & (cycle >= 2), F.concat("url", F.lit("/moved")))
            .otherwise(F.col("url"))
            .alias("final_url"),
            body.alias("html"),
            F.lit(0.0).alias("response_time"),
            F.when(lost, F.lit("connection failed")).alias("error"),
            F.concat(F.lit("cycle_"), F.date_format(captured_at, "yyyyMMdd_HHmmss")).alias("cycle_id"),
            F.col("page_id").alias("ordinal"),
        )
    )


def capture_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_of_events(table(spark, sf_dir, "events"))


def log_of_events(events: DataFrame) -> DataFrame:
    """Events, batch or stream, as a numeric capture log: key, time, status, length, etag."""
    kind = F.col("event_type")
    return events.select(
        F.col("user_id").alias("key"),
        F.col("ts").alias("captured_at"),
        F.col("event_id").alias("ordinal"),
        F.when(kind == "error", 500).when(kind == "signup", 301).otherwise(200).alias("status_code"),
        F.floor(F.col("value") * 100).cast("bigint").alias("content_length"),
        F.col("props").alias("etag"),
    )


def check_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events up to ``AS_OF`` as a log of checks per URL key."""
    return (
        table(spark, sf_dir, "events")
        .where(F.col("ts") <= wall_time(AS_OF))
        .select(
            F.col("user_id").alias("url_key"),
            F.col("ts").alias("checked_at"),
            F.col("event_id").alias("ordinal"),
            (F.col("event_type") != "error").alias("success"),
        )
    )


def watchlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One entry per page, plus duplicates and entries with a scheme that is not watched."""
    page = F.col("page_id")
    base = table(spark, sf_dir, "pages").select(
        "page_id",
        "url",
        F.when(page % 3 == 0, "policy").when(page % 3 == 1, "research").otherwise("guideline").alias("type"),
        F.when(page % 5 == 0, "high")
        .when(page % 5 == 1, "medium")
        .when(page % 5 == 2, "low")
        .when(page % 5 == 3, "critical")
        .otherwise("urgent")
        .alias("priority"),
    )

    def entry(url, priority, shift: int) -> F.Column:
        return F.struct(
            url.alias("url"), F.col("type").alias("type"), priority.alias("priority"),
            (page + shift).alias("ordinal"),
        )

    ftp = F.concat(F.lit("ftp"), F.regexp_extract("url", r"^https?(:.*)$", 1))
    copies = F.array(
        entry(F.col("url"), F.col("priority"), 0),
        F.when(page % 20 == 0, entry(F.col("url"), F.lit("low"), 1_000_000)),
        F.when(page % 25 == 0, entry(ftp, F.col("priority"), 2_000_000)),
    )
    return base.select(F.inline(F.array_compact(copies)))


def linked_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as linked documents of two cycles: some added, removed, changed."""
    doc = F.col("doc_id")
    extension = F.when(doc % 3 == 0, ".pdf").when(doc % 3 == 1, ".html").otherwise(".DOCX")
    cycles = F.filter(
        F.array(F.lit(1), F.lit(2)),
        lambda c: ~((c == 1) & (doc % 10 == 0)) & ~((c == 2) & (doc % 10 == 1)),
    )
    return (
        table(spark, sf_dir, "documents")
        .withColumn("cycle_no", F.explode(cycles))
        .select(
            "cycle_no",
            F.col("source").alias("page_key"),
            F.concat(F.lit("https://docs.example/"), doc.cast("string"), extension).alias("link"),
            F.when(
                (F.col("cycle_no") == 2) & (doc % 10 == 2), F.concat("text", F.lit(" rev2"))
            ).otherwise(F.col("text")).alias("content"),
            F.when(doc % 4 == 0, "application/pdf; charset=binary")
            .when(doc % 4 == 1, "text/html")
            .when(doc % 4 == 3, "application/msword")
            .alias("content_type"),
            F.lit(200).alias("status_code"),
            F.col("n_chars").alias("declared_length"),
        )
    )


def _doc_link(doc: F.Column) -> F.Column:
    extension = F.when(doc % 3 == 0, ".pdf").when(doc % 3 == 1, ".html").otherwise(".DOCX")
    return F.concat(F.lit("https://docs.example/"), doc.cast("string"), extension)


def document_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page captures with links to four documents each; some links come and go with the cycles."""
    cycle = F.col("cycle_no")
    linked = F.filter(
        F.sequence(F.col("page_id") * 4, F.col("page_id") * 4 + 3),
        lambda d: ~((cycle == 1) & (d % 10 == 0)) & ~((cycle == 2) & (d % 10 == 1)),
    )
    anchors = F.array_join(F.transform(linked, lambda d: F.concat(F.lit('<a href="'), _doc_link(d), F.lit('"></a>'))), "")
    return page_captures(spark, sf_dir).withColumn(
        "html", F.replace("html", F.lit("</article>"), F.concat(anchors, F.lit("</article>")))
    )


def fetched_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as captured in three cycles: some change, some are missing or fail in one of them."""
    doc, cycle = F.col("doc_id"), F.col("cycle_no")
    failed = (cycle == 3) & (doc % 10 == 5)
    captured_at = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(cycle)
    return (
        table(spark, sf_dir, "documents")
        .withColumn("cycle_no", F.explode(F.sequence(F.lit(1), F.lit(3))))
        .where(~((cycle == 2) & (doc % 10 == 4)))
        .select(
            F.concat(F.lit("cycle_"), F.date_format(captured_at, "yyyyMMdd_HHmmss")).alias("cycle_id"),
            _doc_link(doc).alias("link"),
            F.when(failed, F.lit(None)).when((cycle >= 2) & (doc % 10 == 2), F.concat("text", F.lit(" rev2")))
            .when((cycle == 3) & (doc % 10 == 3), F.concat("text", F.lit(" rev3")))
            .otherwise(F.col("text")).alias("content"),
            F.when(doc % 4 == 0, "application/pdf; charset=binary").when(doc % 4 == 1, "text/html")
            .when(doc % 4 == 3, "application/msword").alias("content_type"),
            F.when(~failed, 200).alias("status_code"),
            F.col("n_chars").alias("declared_length"),
            F.when(failed, "timed out").alias("error"),
        )
    )


def page_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as stored under six spellings of their key; every seventh page is not stored."""
    page, url = F.col("page_id"), F.col("url")
    form = page % 6
    swapped = F.when(
        F.startswith(url, F.lit("https://")), F.concat(F.lit("http://"), F.substr(url, F.lit(9)))
    ).otherwise(F.concat(F.lit("https://"), F.substr(url, F.lit(8))))
    has_www = url.rlike("^https?://www\\.")
    toggled = F.when(has_www, F.regexp_replace(url, "://www\\.", "://")).otherwise(
        F.regexp_replace(url, "://", "://www.")
    )
    key = (
        F.when(form == 0, url)
        .when(form == 1, normalize_url(url))
        .when(form == 2, normalize_url(swapped))
        .when(form == 3, normalize_url(toggled))
        .otherwise(F.concat(normalize_url(url), F.lit("/k")))
    )
    return (
        table(spark, sf_dir, "pages")
        .where(page % 7 != 0)
        .select(
            key.alias("history_key"),
            "url",
            F.when(form == 4, url).otherwise(key).alias("final_url"),
            F.when(form == 5, url).alias("canonical_url"),
            page.alias("insertion_seq"),
        )
    )


def tagged_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page once, with tags of every kind that is profiled put into its own document."""
    n = F.col("page_id").cast("string")
    head = F.concat(
        F.lit("<head><META NAME='twitter:card' content=summary><meta content=\"t"), n,
        F.lit('" name="twitter:Title"><meta name="twitter:title" content="u'), n,
        F.lit(' &amp; co"><meta name="description" content=" first '), n,
        F.lit(' "><meta name="description" content="second">'
              "<meta property='OG:Title' content='A > B "), n,
        F.lit("'><meta property=\"og:title\" content=\"last "), n,
        F.lit('"><meta property="og:image" content=""><meta property="og:url" content="/o/'), n,
        F.lit('"><meta http-equiv="Content-Type" content="text/html; charset=iso-8859-1">'
              '<meta http-equiv=refresh content="30"><meta http-equiv="Refresh" content="60">'
              '<meta name="author" content="a'), n,
        F.lit('"><meta name="author" content="b"><meta name="robots" content="">'
              '<meta name="Generator" content="g"><link rel="stylesheet" href="/s.css">'
              '<link rel="nofollow canonical" href=" /c/'), n,
        F.lit(' "><!-- <meta name="keywords" content="hidden"><script type="application/ld+json">{}</script> -->'
              '<script type="application/ld+json">{"part":{"safety":"s'), n,
        F.lit('","version":"v'), n,
        F.lit('"},"name":"n'), n,
        F.lit('","@type":"SoftwareApplication","@list":[1,{"a":null}]}</script>'
              '<script type="application/ld+json">{broken</script>'),
    )
    items = F.array_join(
        F.transform(
            F.sequence(F.lit(0), (F.col("page_id") % 7).cast("int")),
            lambda i: F.concat(
                F.lit('<div itemscope itemtype="https://schema.org/T'), (i % 4).cast("string"), F.lit('"></div>')
            ),
        ),
        "",
    )
    body = F.concat(
        items,
        F.lit('<img src="x"><IMG src=y><ol><li>1</li></ol><h2>two</h2><h3 class="main-head">three</h3><form action="/f"></form>'
              '<a href="https://twitter.com/x'), n,
        F.lit('" title="T &amp; t">share <b> it </b></a><a class="k" href=\'mailto:x@y\'>m</a>'
              '<a href="//cdn.example/x">cdn</a><a href="#x">frag</a><a href="">none</a><a name="n">no</a>'
              "<a href=\"https://other.example/p.html\"> other  page </a>"
              "<p>Last updated: 3 May 2024. Version: 2."), n,
        F.lit(". also v1."), (F.col("page_id") % 7).cast("string"),
        F.lit(" and ver 3; effective as of May 1. Date: 1/2/2024 Privacy policy, &quot;terms&quot; &lt;!-- shown --&gt;</p></article>"),
    )
    pages = spread(table(spark, sf_dir, "pages"))
    tagged = F.replace(F.replace(F.col("html"), F.lit("<head>"), head), F.lit("</article>"), body)
    return normalize_captures(
        pages.select(
            "page_id",
            "url",
            F.lit("2024-01-02").cast("timestamp_ntz").alias("captured_at"),
            F.when(F.col("page_id") % 11 == 10, 503).otherwise(200).alias("status_code"),
            F.create_map(
                F.lit("Content-Type"),
                F.when(F.col("page_id") % 13 == 12, "application/PDF").otherwise("Text/HTML; charset=latin1"),
            ).alias("headers"),
            F.col("url").alias("final_url"),
            tagged.alias("html"),
            F.lit(0.0).alias("response_time"),
            F.lit(None).cast("string").alias("error"),
            F.lit("cycle_20240102_000000").alias("cycle_id"),
            F.col("page_id").alias("ordinal"),
        )
    )
