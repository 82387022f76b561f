import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from pagewatch.functions import jsonld, text
from pagewatch.functions.headers import drop_volatile, header, normalize_headers
from pagewatch.functions.urls import history_key, normalize_url, url_variants
from pagewatch.sources.captures import spread


def values(spark, expression, inputs, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {kind}")
    return [r.x for r in df.select("i", expression(F.col("v")).alias("x")).orderBy("i").collect()]


URLS = {
    "HTTP://A.com:80/b/?q#f": "http://a.com/b",
    "https://a.com": "https://a.com",
    "https://a.com/": "https://a.com/",
    "http://a.com/b;p": "http://a.com/b",
    "http://a.com/b//": "http://a.com/b/",
    "https://A.b:443/x/": "https://a.b/x",
    "http://a.b:443/x": "http://a.b:443/x",
    "https://a.b:80/x": "https://a.b:80/x",
    "http://a.b/x;1/y": "http://a.b/x;1/y",
    "http://A.b/CaSe?Q": "http://a.b/CaSe",
    "": "",
    None: None,
}


def test_normalize_url(spark):
    assert values(spark, normalize_url, list(URLS)) == list(URLS.values())


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.from_regex(r"https?://[A-Za-z.]{1,9}(:80|:443)?(/[a-zA-Z0-9._-]{1,5}){0,3}/?(\?[a-z]{1,4})?", fullmatch=True), min_size=1, max_size=30))
def test_normalize_url_is_idempotent(spark, urls):
    once = values(spark, normalize_url, urls)
    assert values(spark, normalize_url, once) == once


def test_url_variants_in_fixed_order(spark):
    got = values(spark, url_variants, ["https://www.a.com/x/?q", "http://a.com"])
    assert got == [
        ["https://www.a.com/x", "http://www.a.com/x", "https://a.com/x"],
        ["http://a.com", "https://a.com", "http://www.a.com"],
    ]


def test_history_key_falls_back_to_url(spark):
    df = spark.createDataFrame([("", "http://A.b/"), (None, "http://c.d/x/"), ("http://e.f:80/", "x")], "f string, u string")
    got = [r[0] for r in df.select(history_key(F.col("f"), F.col("u"))).collect()]
    assert got == ["http://a.b/", "http://c.d/x", "http://e.f/"]


@pytest.mark.parametrize(
    "raw, decoded",
    [
        ("a &amp; b", "a & b"),
        ("&amp;lt;", "&lt;"),
        ("&copy 2020 &copy;", "© 2020 ©"),
        ("&#233;&#x1F600;&#65 x", "é😀A x"),
        ("AT&T & &unknown; &", "AT&T & &unknown &"),
        ("plain", "plain"),
    ],
)
def test_decode_entities_in_text(spark, raw, decoded):
    assert values(spark, text.decode_entities, [raw]) == [decoded]


def test_decode_entities_in_attributes(spark):
    decode = lambda c: text.decode_entities(c, keep_unknown=True)
    assert values(spark, decode, ["/p?a=1&b=2&amp;c &unknown; &#0;"]) == ["/p?a=1&b=2&c &unknown; �"]


def test_word_count_with_all_kinds_of_space(spark):
    inputs = ["", "  ", "a", " a\t\nb  c ", "a b c", "x\x1cy"]
    counted = lambda c: text.word_count(text.collapse_spaces(c))
    assert values(spark, counted, inputs) == [len(t.split()) for t in inputs]


def test_preview_boundary(spark):
    got = values(spark, text.preview, ["é" * 500, "é" * 501])
    assert got == ["é" * 500, "é" * 500 + "..."]


def test_phrases_do_not_overlap_with_themselves(spark):
    counts = lambda c: F.concat_ws(",", *text.policy_counts(F.lower(c)).values())
    got = values(spark, counts, ["Terms terms and conditions; License licensed COPYRIGHT", "gdpr gdprgdpr", ""])
    assert got == ["0,3,0,0,3,0", "3,0,0,0,0,0", "0,0,0,0,0,0"]


def test_version_marks(spark):
    marks = lambda c: text.version_marks(c, text.fold_case(c))
    got = values(spark, marks, ["Version: 2.1 and v1.3", "see version. Ver 7", "verſion 4", "none"])
    assert got == [["2.1", "1.3"], [".", "7"], ["4"], []]


def test_date_marks_span_lines_and_stop_at_dot(spark):
    marks = lambda c: text.date_marks(c, text.fold_case(c))
    got = values(spark, marks, ["Last updated: 3 May\n2024. Date 1/2/2024", "Effective as of June 1<b"])
    assert got == [["3 May\n2024", "1/2/2024"], ["June 1"]]


def test_canonical_json(spark):
    inputs = ['{"b":1,"a":{"d":[2,{"z":1,"y":null}],"c":"é"}}', '{"a":{"c":"é","d":[2,{"y":null,"z":1}]},"b":1}', "{broken", None]
    got = values(spark, jsonld.canonical_json, inputs)
    assert got[0] == got[1] == '{"a":{"c":"é","d":[2,{"y":null,"z":1}]},"b":1}'
    assert got[2:] == ['"{broken"', None]


def test_model_card_at_any_depth(spark):
    deep = '{"x":' * 40 + '{"@type":["Thing","AIModel"],"version":3,"other":1}' + "}" * 40
    inputs = [
        deep,
        '{"type":"SoftwareApplication","name":"outer","part":{"Safety":"s","name":"inner"}}',
        '{"@type":"Person","name":"p"}',
        None,
    ]
    got = values(spark, lambda c: F.from_json(jsonld.model_card(c), "map<string,string>"), inputs)
    # A later object overrides an earlier one; keys are matched by exact case.
    assert got == [{"version": "3"}, {"name": '"inner"'}, {}, None]


def test_headers(spark):
    df = spark.sql("SELECT map('Date','d','ETag','1','etag','2','X-Cache','h','Age','3') AS v")
    row = df.select(normalize_headers(F.col("v")).alias("n")).select("n", drop_volatile(F.col("n")).alias("d")).first()
    assert row.n == {"date": "d", "etag": "2", "x-cache": "h", "age": "3"}
    assert row.d == {"etag": "2", "age": "3"}
    assert df.select(header(F.col("v"), "etag"), header(F.col("v"), "none")).first() == ("2", None)


def test_runs_of_any_white_space_become_one_space(spark):
    marks = [chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000]
    texts = [f"a{c}b {c}d  e{c} f{c}{c}g h" for c in marks]
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, t string")
    plain = F.trim(F.regexp_replace("t", rf"(?U){text.SPACE}+", " "))
    assert rows.where(text.collapse_spaces(F.col("t")) != plain).count() == 0


def test_phrases_are_counted_without_overlap_and_beside_others(spark):
    cases = {"copyrights copyright": "rights", "ccpaccpa": "ccpa", "no close accounts": "close account", "": "gdpr", "ääterms-terms": "terms"}
    rows = spark.createDataFrame([(t, p, t.count(p)) for t, p in cases.items()], "t string, p string, n int")
    counted = F.coalesce(*[F.when(F.col("p") == p, text.occurrences(F.col("t"), p)) for p in cases.values()])
    assert rows.where(counted != F.col("n")).count() == 0
    assert spark.sql("SELECT CAST(NULL AS STRING) AS t").select(text.occurrences(F.col("t"), "terms")).first()[0] is None


def test_a_scan_of_many_splits_and_one_row_group_is_dealt_out(spark, tmp_path):
    rows = spark.range(2000).select("id", F.sha2(F.col("id").cast("string"), 512).alias("t"))
    rows.coalesce(1).write.parquet(str(tmp_path / "t"))
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    kept = {n: spark.conf.get(n) for n in names}
    try:
        for n in names:
            spark.conf.set(n, "2k")
        scan = spark.read.parquet(str(tmp_path / "t"))
        assert scan.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
        dealt = spread(scan).groupBy(F.spark_partition_id()).count().collect()
    finally:
        for n, value in kept.items():
            spark.conf.set(n, value)
    assert sum(r["count"] for r in dealt) == 2000
    assert max(r["count"] for r in dealt) < 500


def test_a_split_becomes_many_tasks(spark):
    cores = spark.sparkContext.defaultParallelism
    assert spread(spark.range(0, 100, 1, 2 * cores)).rdd.getNumPartitions() == 16 * cores
    assert spread(spark.range(0, 100, 1, 1)).rdd.getNumPartitions() == 4 * cores


def test_phrases_of_all_categories_are_found_in_one_pass(spark):
    phrases = [p for category in text.POLICY_PHRASES.values() for p in category]
    assert not [(p, q) for p in phrases for q in phrases if p != q and q.startswith(p)]
    joined = [p[: len(p) - cut] + q for p in phrases for q in phrases for cut in (0, 1, 2)]
    joined += [" ".join(phrases) + "ä", "personal data protection", "gdprights", "terms\nterm s", "terminaterminaterms", ""]
    rows = spark.createDataFrame([(t, [sum(t.count(p) for p in ps) for ps in text.POLICY_PHRASES.values()]) for t in joined], "t string, n array<int>")
    counted = rows.withColumn("hits", text.phrase_hits(F.col("t"))).withColumn("c", F.array(*text.hit_counts(F.col("hits"), F.col("t")).values()))
    assert counted.where("c IS NULL OR c <> n").count() == 0
    assert counted._jdf.queryExecution().analyzed().toString().count("regexp_") <= 2
    nothing = spark.sql("SELECT CAST(NULL AS STRING) AS t").select(*text.policy_counts(F.col("t")).values())
    assert set(nothing.first()) == {None}


def test_folding_with_the_lower_text_gives_the_same(spark):
    rows = spark.createDataFrame([(t,) for t in ["VerSion", "İstanbul DATE", "verſıon", "Kelvin", "i̇", "", None]], "t string")
    same = text.fold_case(F.col("t")).eqNullSafe(text.fold_case(F.col("t"), F.lower("t")))
    assert rows.where(~same).count() == 0


def test_common_references_are_decoded_as_all_others(spark):
    inputs = ["&amp;lt; &lt;&gt;&quot;&nbsp;| &amp &ampx; &eacute;&CounterClockwiseContourIntegral;&none;"]
    assert values(spark, text.decode_entities, inputs) == ['&lt; <>"\xa0| & &ampx é∳&none']
