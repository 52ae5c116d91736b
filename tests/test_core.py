import json
import random
import time

import pytest
from pyspark.sql import functions as F

from tessella.functions import cleaning as C
from tessella.functions import errors as E
from tessella.functions import keywords as K
from tessella.functions import lang as L
from tessella.functions import urls as U
from tessella.operators.hierarchy import hierarchy
from tessella.operators.politeness import in_window, robots_rules, robots_verdict
from tessella.plans.config import Environment
from tessella.sources import results as R
from tessella.sources.fetch import accept_language
from tessella.streaming.stateful import rate_windows


def brute_tree(rows):
    first = {}
    for o, k, p in sorted((r for r in rows if r[1] is not None and r[0] is not None), key=lambda r: r[0]):
        first.setdefault(k, p or None)
    out, below = {}, dict.fromkeys(first, 0)
    for k in first:
        way, x = [k], k
        ring = False
        while first.get(x):
            x = first[x]
            if x in way:
                ring = True
                break
            way.append(x)
        if not ring:
            for a in way[1:]:
                if a in below:
                    below[a] += 1
        out[k] = ("", -1, 1 if x == k else 2) if ring else (x, len(way) - 1, 0)
    return {k: (*v, below[k] if v[2] == 0 else -1) for k, v in out.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_hierarchy_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    n = 300
    rows = [(i, f"u{i}", rnd.choice([None, "", "outside", f"u{rnd.randrange(n)}", f"u{max(0, i - 1)}", f"u{i - 1}"])) for i in range(n)]
    rows += [(n + 1, "u5", "u9"), (n + 2, None, "u1"), (n + 3, "ring", "ring"), (n + 4, "a", "b"), (n + 5, "b", "a"), (n + 6, "c", "a")]
    df = spark.createDataFrame(rows, "result_id long, url string, parent string").withColumn("name", F.lit("clash"))
    got = {r["name"]: (r["root"], r["depth"], r["ring_state"], r["n_below"]) for r in hierarchy(df, "url", "parent", "result_id").collect()}
    assert got == brute_tree(rows)


def test_hierarchy_empty(spark):
    assert hierarchy(spark.createDataFrame([], "result_id long, url string, parent string"), "url", "parent", "result_id").count() == 0


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("href, want", [("//h.test/x", "https://h.test/x"), ("/a/../b", "https://a.test/b"), ("?q=1", "https://a.test/d/e?q=1"), ("#f", "https://a.test/d/e?z=1#f"), ("x/./y", "https://a.test/d/x/y"), ("../up", "https://a.test/up"), ("HTTPS://B.test:443", "https://b.test/"), ("mailto:x", None)])
def test_resolve(spark, href, want):
    assert one(spark, href, lambda x: U.resolve(F.lit("https://a.test/d/e?z=1"), x)) == want


def test_urls(spark):
    assert one(spark, "https://A.test/x/?utm_source=1&k=v#f", U.normalize_tracking) == "https://a.test/x?k=v"
    assert one(spark, "not a url", U.normalize_core) == "not a url"
    assert one(spark, "https://a.test/x.pdf", U.valid_core) is False
    assert one(spark, None, U.valid_core) is False


def test_keywords(spark):
    m = lambda t, *a: [(r["keyword"], r["pos"]) for r in one(spark, t, lambda x: K.matches(x, K.KeywordConfig(*a)))]
    assert m("aXbxa", ("x",), "ci") == [("x", 1), ("x", 3)]
    assert m("cat concat cat.", ("cat",), "exact") == [("cat", 0), ("cat", 11)]
    assert m("a b", ("a", "c"), "all") == []
    assert m(None, ("a",)) == []
    assert m("a1b22", ("[0-9]+",), "regex") == [("[0-9]+", 1), ("[0-9]+", 3)]
    with pytest.raises(ValueError):
        K.KeywordConfig((" ",))


def test_cleaning(spark):
    assert one(spark, " a 　 b ", lambda x: C.cleaned(x, C.BASIC)) == "a b"
    assert one(spark, "x1 y! z", lambda x: C.cleaned(x, C.AGGRESSIVE)) == "z"
    assert one(spark, "   ", lambda x: C.cleaned(x, C.BASIC)) is None
    with pytest.raises(ValueError):
        C.parse_rule("remove:a:b")


def test_errors(spark):
    assert one(spark, "DNS timeout", E.categorize) == "NetworkTimeout"
    assert one(spark, "what", E.categorize) == "UnknownError"


def test_robots(spark):
    text = "User-agent: *\nDisallow: /a\nAllow: /a/b\nCrawl-delay: 1.5\nUser-agent: x\nDisallow: /"
    rules = robots_rules(spark.createDataFrame([("h", text), ("n", None)], "host string, robots_txt string"))
    urls = spark.createDataFrame([("h", "/a/c"), ("h", "/a/b/c"), ("none", "/a")], "host string, path string")
    got = {(r["host"], r["path"]): (r["allowed"], r["delay_ms"]) for r in robots_verdict(urls, rules, "host", "path").collect()}
    assert got == {("h", "/a/c"): (False, 1500), ("h", "/a/b/c"): (True, 1500), ("none", "/a"): (True, None)}


def test_rate_window_buckets(spark):
    rnd = random.Random(3)
    rows = [("h", rnd.randrange(5000)) for _ in range(300)] + [(None, 3), ("h", None)]
    got = in_window(spark.createDataFrame(rows, "host string, ms long"), "host", "ms", 100, 150).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["host"] and r["ms"] is not None:
            assert r["in_window"] == sum(1 for h, t in rows if h and t is not None and r["ms"] - 100 <= t <= r["ms"])


def test_configuration():
    assert Environment().with_env({"CRAWLER_ENV": "production", "METRICS_PORT": "x"}).optimized().persist_queue
    assert accept_language([]) == "en-US,en;q=0.9"
    assert accept_language(["en"]).startswith("en-US,en-GB;q=0.9")


def test_results_written_are_read_back(spark, tmp_path):
    meta = {"status_code": 200, "content_type": None, "content_length": None, "response_time_ms": 5, "depth": 1, "parent_url": None, "crawl_session_id": "s"}
    stamp = {"secs_since_epoch": 1, "nanos_since_epoch": 0}
    one = lambda i: {"url": f"https://a.test/{i}", "title": None, "content": "x\ny", "word_count": 2, "language": None, "links_found": [], "metadata": meta, "timestamp": stamp}
    rows = spark.createDataFrame([one(i) for i in range(200)], R.RESULT)
    R.write_results(rows, str(tmp_path / "a"))
    R.write_results(rows.where("url like '%7'"), str(tmp_path / "a"), compressed=True)
    assert R.read_results(spark, str(tmp_path / "a")).count() == 220
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "object.json").write_text(json.dumps(one(1), indent=2))
    (tmp_path / "b" / "array.json").write_text(json.dumps([one(2), one(3)], indent=2))
    (tmp_path / "b" / "lines.jsonl").write_text("\n".join([json.dumps(one(4)), "{broken", json.dumps(one(5) | {"word_count": None}), json.dumps(one(6))]))
    (tmp_path / "b" / "session_1.json").write_text(json.dumps({"session_id": "s", "total": 3}))
    (tmp_path / "b" / "note.txt").write_text(json.dumps(one(9)))
    assert sorted(r.url[-1] for r in R.read_results(spark, str(tmp_path / "b")).collect()) == ["1", "2", "3", "4", "6"]
    assert [r.url[-1] for r in R.read_results(spark, str(tmp_path / "b"), "object").collect()] == ["1"]


def test_limiter_over_batches_with_late_rows(spark, tmp_path):
    batches = [[("a", 10_000), ("b", 3_599_500)], [("a", 9_500), ("a", 10_400), ("b", 3_600_100)], [("a", 10_500), (None, 1), ("a", None)]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "host string, ms long").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        time.sleep(1.1)  # files are taken in the order of their times
    stream = spark.readStream.schema("host string, ms long").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    q = rate_windows(stream, "host", "ms", 2, 1000).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    assert got == [("a", 9_500, 1, False, 0), ("a", 10_000, 1, False, 0), ("a", 10_400, 3, True, 500), ("a", 10_500, 4, True, 500), ("b", 3_599_500, 1, False, 0), ("b", 3_600_100, 2, False, 500)]


def test_forms_and_queries(spark):
    df = spark.createDataFrame([("\u3000\ufeff a<b \u2028",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(U.sanitize_text_simple(F.col("t"))).collect()] == ["ab", None, ""]
    urls = {"https://A.test/x/?q=%C3%A4+b&utm%5Fsource=1&k": "https://a.test/x?q=%c3%a4%20b&k=", "https://a.test/?q=%zz": "https://a.test/?q=%zz", "https://a.test/?a=1%262": "https://a.test/?a=1&2", "no url": "no url"}
    got = {r[0]: r[1] for r in spark.createDataFrame([(u,) for u in urls], "u string").select("u", U.normalize_tracking(F.col("u"))).collect()}
    assert got == urls


def test_a_language_is_scored_once(spark):
    rows = [(None, None, None), ("", None, None), ("'The' dog, OF", "en", 1.0), ("der dog in the", "en", 0.5), ("the the of\u3000das und", "en", 1 / 3), ("x" * 9 + "the of", None, None), ("ひらがな 漢字", "ja", 1.0), ("漢字 the", "zh", 1.0), ("мир", "ru", 1.0), ("мир the of and is", "en", 1.0)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, text string, code string, c double")
    told = df.select("i", "code", F.round("c", 6), L.detect(F.col("text")), F.round(L.confidence(F.col("text")), 6))
    assert all(r[1] == r[3] and r[2] == r[4] for r in told.collect())
    plan = df.select(L.confidence(F.col("text")).alias("c"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(" INSET ") == len(L.PROFILES)
