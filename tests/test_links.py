"""URL algebra, rule engines, folds, sources and streams on small tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from citeflow import catalogue, policy
from citeflow.functions import pages, urls
from citeflow.operators import classify, export, graph, state
from citeflow.sources import dumps, wikitext
from citeflow.streaming import folds


@pytest.mark.parametrize("name", ["url_normalize_cases", "reconstruct_url", "registrable_cases", "recheck_cadence", "domain_verdict", "business_name_valid"])
def test_literal_tables(spark, name):
    duckdb = pytest.importorskip("duckdb")
    found = catalogue.queries()[name](spark, "")
    want = duckdb.sql(catalogue.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(map(repr, (tuple(r[c] for c in names) for r in found.collect()))) == sorted(map(repr, want.fetchall()))


def test_null_and_idna_hosts(spark):
    df = spark.createDataFrame([(None,), ("http://BÜCHER.de/",)], "u string")
    df = df.unionByName(spark.createDataFrame([("http://straße.de/x",), ("http://A.com/ü",)], "u string"))
    assert [r.n for r in urls.canonical(df, "u", "n").collect()] == [None, "http://xn--bcher-kva.de/", "http://xn--strae-oqa.de/x", "http://a.com/ü"]
    r = spark.range(1).select(urls.page_range(F.lit("p1p41242")).alias("a"), urls.page_range(F.lit("1-5")).alias("b"), urls.is_namespaced(F.lit("Category:X")).alias("c"), urls.is_namespaced(F.lit("Star Trek: First")).alias("d")).first()
    assert (tuple(r.a), tuple(r.b), r.c, r.d) == ((1, 41242), (1, 5), True, False)
    assert spark.range(1).select(urls.article_url(F.lit("en"), F.lit("A b"))).first()[0] == "https://en.wikipedia.org/wiki/A_b"


def test_tuples():
    text = r"(1,'a\'b,(c)',NULL),(2,'it''s;\n',-3.5);(3,'x',1)"
    assert list(dumps.parse_tuples(text)) == [["1", "a'b,(c)", None], ["2", "it's;\n", "-3.5"]]


def test_dump_and_index(spark, tmp_path):
    (tmp_path / "d.sql").write_text("-- x\nINSERT INTO `externallinks` VALUES (1,10,'http://edu.berkeley.','/a'),(2,12,'http://com.bbc.',NULL);\nINSERT INTO `other` VALUES (9);\n")
    assert [tuple(r) for r in dumps.read_links(spark, str(tmp_path / "d.sql")).collect()] == [(1, 10, "http://edu.berkeley.", "/a"), (2, 12, "http://com.bbc.", None)]
    lines = spark.createDataFrame([("601:10:A",), ("7:8:Star Trek: First",), ("bad",)], "value string")
    assert [tuple(r) for r in dumps.index_rows(lines).collect()] == [(601, 10, "A"), (7, 8, "Star Trek: First")]
    r = spark.range(1).select(dumps.dump_run(F.lit("enwiki-20260701-x")), dumps.dump_lang(F.lit("dewiki-2026")), dumps.dump_lang(F.lit("x")), dumps.pages_of(F.lit("<page><title>A &amp;lt; B</title><id>5</id><text x='1'>t</text></page>"))).first()
    assert (r[0], r[1], r[2], tuple(r[3][0])) == ("20260701", "de", "en", (5, "A &lt; B", "t", None))


def test_registry_and_archive_answers(spark):
    r = spark.range(1).select(
        dumps.rdap(F.lit('{"events":[{"eventAction":"expiration","eventDate":"2026-08-01T00:00:00Z"}],"entities":[{"roles":["registrar"],"handle":"R"}],"status":["active"]}')).alias("a"),
        dumps.availability(F.lit('{"archived_snapshots":{}}'), F.lit(None)).alias("b"), dumps.availability(F.lit(None), F.lit("timeout")).alias("c"),
        dumps.expires_within(F.lit("2026-08-01"), 60, F.lit(dt.datetime(2026, 7, 25))).alias("d"), dumps.expires_within(F.lit("junk"), 60, F.lit(dt.datetime(2026, 7, 25))).alias("e"),
    ).first()
    assert (r.a.registrar, r.a.statuses, r.b.has_snapshot, r.c.has_snapshot, r.d, r.e) == ("R", ["active"], False, None, True, False)
    v = spark.range(1).select(*(classify.gap_verdict(F.lit(a).cast("boolean"), F.lit(s).cast("string")) for a, s in ((None, None), (False, None), (True, "404"), (True, "200")))).first()
    assert tuple(v) == ("unknown", "lost", "lost", "recoverable")


def test_wikitext():
    text = 'Lead.\n== History ==\n<ref name="hist">{{cite web |url=http://a.com/x |archive-url=http://w/1}}</ref>{{dead link}}\n=== Details ===\n[http://b.com/y Deep Link]'
    a, b = wikitext.extract(text, "http://a.com/x"), wikitext.extract(text, "http://www.b.com/y/")
    assert a[:7] == (True, "History", 2, None, "citation", "hist", "cite web") and a[8:10] == (True, "http://w/1")
    assert b[1:5] == ("Details", 3, "Deep Link", "inline")
    assert wikitext.extract(None, "x")[0] is False and wikitext.extract(text, "http://none")[0] is False


def test_classifier_never_says_unregistered(spark):
    rows = [("ok", True, None, s, "") for s in (200, 404, 410, 429, 503, 403, 302, None)] + [("x", True, k, None, "") for k in ("dns_error:x", "tls_error", "timeout", "no_host", "odd")] + [("disallowed: disallow", False, None, 200, ""), ("ok", False, None, 200, ""), ("ok", True, None, 200, "buy this domain, this domain is for sale")]
    df = spark.createDataFrame(rows, "robots string, fetched boolean, kind string, status int, body string")
    content = classify.classify_content(F.lit("t"), F.col("body"), F.lit("http://a/x"), F.lit("http://a/x"), F.lit(0), F.lit(9999))
    got = [r[0] for r in df.select(classify.classify_url(*(F.col(c) for c in ("robots", "fetched", "kind", "status")), content)["classification"]).collect()]
    assert got == ["live", "hard_404", "hard_404", "temporarily_unavailable", "temporarily_unavailable", "live", "unclassified", "unclassified", "dns_failure", "tls_failure", "temporarily_unavailable", "unclassified", "unclassified", "blocked_by_robots", "unclassified", "for_sale"]


def test_appends_are_idempotent(spark):
    log = spark.createDataFrame([(1, "a")], "k int, v string")
    new = spark.createDataFrame([(1, "b"), (2, "c"), (2, "c")], "k int, v string")
    once = log.unionByName(state.append_once(log, new, ["k"]))
    assert once.count() == 2 and state.append_once(once, new, ["k"]).count() == 0
    assert sorted(map(tuple, state.upsert(log.withColumn("o", F.lit(1)), new.withColumn("o", F.lit(2)), ["k"], "o").collect())) == [(1, "b", 2), (2, "c", 2)]


def test_export_digest_covers_rows_alone(spark, tmp_path):
    rows = export.ranked(spark.createDataFrame([("b", 1, 2), ("a", 1, 2), ("c", 5, 0)], "n string, s int, p int"), "s", "p", "n")
    one, two = (export.write_jsonl(rows, str(tmp_path / f"{i}"), {"run": i}) for i in range(2))
    assert one == two and [x[6] for x in (tmp_path / "0").read_text().splitlines()[1:]] == ["c", "a", "b"]


def test_streamed_fold_equals_batch(spark, tmp_path):
    log = spark.createDataFrame([(k, i, f"s{i}") for i in range(20) for k in (1, 2)], "k int, i int, s string")
    log.repartition(5).write.parquet(str(tmp_path / "log"))
    q = folds.latest_stream(folds.read_log(spark, str(tmp_path / "log"), "k int, i int, s string"), "k", "i").writeStream.format("memory").queryName("latest_rows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(map(tuple, spark.table("latest_rows").collect())) == sorted(map(tuple, state.latest(log, ["k"], "i").collect()))
    for n in range(2):
        folds.append_once_stream(folds.read_log(spark, str(tmp_path / "log"), "k int, i int, s string"), str(tmp_path / "out"), str(tmp_path / f"c{n}"), ["k", "i"]).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 40


def test_page_fields(spark):
    r = spark.range(1).select(pages.phone(F.lit("tel +1 (555) 010-2000 x")), pages.rating(F.lit("4.5 stars 12 Reviews")), pages.rating(F.lit("none")), pages.savings(F.lit("You Save: $12 (10%)")), pages.first_business_name(F.lit("share\nBlue Cafe\nx"))).first()
    assert (r[0], tuple(r[1]), tuple(r[2]), tuple(r[3]), r[4]) == ("+1 (555) 010-2000", ("4.5", "12"), ("UNKNOWN", "UNKNOWN"), ("12", "10"), "Blue Cafe")


def test_policy_fingerprint_and_priority(spark):
    assert policy.fingerprint().startswith("1+") and len(policy.fingerprint()) == 14
    assert spark.range(1).select(graph.priority(F.lit("a"), {"a": 3}), graph.priority(F.lit("b"), {"a": 3}), graph.priority(F.lit("b"), {})).first()[:] == (3, 0, 0)


def test_streaks_and_eviction_of_hot_keys(spark, monkeypatch):
    log = spark.createDataFrame([(1, i, "a" if i % 50 else "b") for i in range(1, 1000)] + [(2, 5, "x")], "k int, i int, s string")
    assert sorted(map(tuple, state.streak(log, "k", "i", "s").collect())) == [(1, "a", 20), (2, "x", 1)]
    assert sorted(map(tuple, state.streak(log, "k", "i", "s", 10_000).collect())) == [(1, "a", 49), (2, "x", 1)]
    monkeypatch.setattr(policy, "ORDERED_ROWS", 10)
    cache = spark.createDataFrame([(i, (i * 7) % 100, 1 + i % 5) for i in range(1000)], "n bigint, used bigint, size bigint")
    for budget in (0, 1, 777, 2000, 2999, 3000, 5000):
        want, freed = set(), 0
        for used, n, size in sorted((u, n, s) for n, u, s in map(tuple, cache.collect())):
            if budget > 0 and freed < 3000 - budget:
                want.add(n)
                freed += size
        assert {r.n for r in state.evict(cache, "size", "used", "n", budget, cells=8).collect()} == want


def test_blocks_at_offsets(spark, tmp_path):
    import bz2

    parts = [bz2.compress(f"<page><title>T{i}</title><id>{i}</id><redirect title=\"R\" /><text>x</text></page>".encode() * 50) for i in range(3)]
    (tmp_path / "d.bz2").write_bytes(b"".join(parts))
    offsets = spark.createDataFrame([(0,), (len(parts[0]),), (0,)], "offset bigint")
    got = dumps.read_blocks(spark, offsets, str(tmp_path / "d.bz2")).select("offset", F.explode(dumps.pages_of(F.col("block"))).alias("p")).select("offset", "p.page_id", "p.redirect").distinct().collect()
    assert sorted(map(tuple, got)) == [(0, 0, "R"), (len(parts[0]), 1, "R")]
    with pytest.raises(Exception, match="too large"):
        dumps.read_blocks(spark, offsets, str(tmp_path / "d.bz2"), most=100).collect()


def test_dumps_of_one_run(spark):
    names = spark.createDataFrame([("enwiki-20260701-externallinks.sql.gz", "sql"), ("enwiki-20260701-index1.txt", "index"), ("enwiki-20260601-externallinks.sql.gz", "old")], "name string, kind string")
    assert dumps.check_same_run(names.where("kind <> 'old'")) == "20260701"
    with pytest.raises(ValueError, match="several"):
        dumps.check_same_run(names)
    assert dumps.latest_dump(names, "externallinks").first()[0].startswith("enwiki-20260701")


def test_candidate_files(spark, tmp_path):
    rows = spark.createDataFrame([("a,b.com", 5, '[{"name":"pages","points":3}]')], "domain string, score int, score_explanation string")
    one, two = (export.write_candidates(rows, str(tmp_path / f"c{i}"), [f"run {i}"]) for i in range(2))
    text = (tmp_path / "c1").read_text().splitlines()
    assert one == two and text[0] == "# run 1" and text[1].split(",") == export.COLUMNS and text[2].startswith('"a,b.com",,5')
    export.write_jsonl(rows, str(tmp_path / "j"), {"run": 1})
    assert (tmp_path / "j").read_text().splitlines()[1] == '{"domain":"a,b.com","score":5,"score_explanation":[{"name":"pages","points":3}]}'
    export.write_csv(rows, str(tmp_path / "f"), ["score"])
    assert spark.read.option("header", True).csv(str(tmp_path / "f")).columns == ["score"]
    for extra in ("x", "y"):
        export.append_records(spark.createDataFrame([("n", {extra: "1"}, ["p", "q"])], "name string, specifications map<string,string>, compatibility array<string>"), str(tmp_path / "r"))
    back = spark.read.option("mergeSchema", True).parquet(str(tmp_path / "r"))
    assert set(back.columns) == {"name", "compatibility", "x", "y"} and back.first().compatibility == "p; q"
    export.write_log(rows, str(tmp_path / "l"), "score")
    assert spark.read.parquet(str(tmp_path / "l")).count() == 1


def test_enriched_links_keep_their_archive(spark):
    wiki = spark.createDataFrame([(1, "[http://a.com/x A] {{cite web|archive-url=http://w/9|archive-date=2020}}"), (2, "nothing")], "page_id int, text string")
    links = spark.createDataFrame([(1, "http://a.com/x", "http://old", "1999"), (2, "http://a.com/x", "http://old", None), (3, "http://a.com/x", None, None)], "page_id int, url_raw string, archive_url string, archive_date string")
    got = {r.page_id: (r.archive_url, r.archive_date, r.enrich_status) for r in wikitext.enriched(links, wiki).collect()}
    assert got == {1: ("http://w/9", "2020", "done"), 2: ("http://old", None, "url_not_found_in_wikitext"), 3: (None, None, "page_missing")}


def test_robots_rules(spark):
    from citeflow.functions import net

    rules = "User-agent: *\nDisallow: /private"
    rows = spark.createDataFrame([(rules, "bot", "http://a.com/x"), (rules, "bot", "http://a.com/private/y"), (None, "bot", "http://a.com/")], "b string, a string, u string")
    assert [r[0] for r in rows.select(net.robots_allow(F.col("b"), F.col("a"), F.col("u"))).collect()] == [True, False, None]
    waits = [r[0] for r in spark.range(50).select(net.backoff(F.lit(4), 3)).collect()]
    assert all(0 <= w <= 8 for w in waits) and len(set(waits)) > 10


def test_settings(tmp_path):
    (tmp_path / "p.toml").write_text("look_back = 7\nthin_body = 9\n[state_points]\nparked = 1\n")
    got = policy.load(str(tmp_path / "p.toml"), {"CITEFLOW_THIN_BODY": "10", "HOME": "/"}, {"breaker": 2})
    assert (got["LOOK_BACK"], got["THIN_BODY"], got["BREAKER"], got["STATE_POINTS"]) == (7, 10, 2, {"parked": 1})
    assert policy.load() == policy.defaults() and policy.fingerprint(got) != policy.fingerprint()
    for bad in ({"nothing": 1}, {"breaker": "x"}, {"state_points": [1]}):
        with pytest.raises(ValueError):
            policy.load(given=bad)


def test_streaks_in_a_stream_equal_batch(spark, tmp_path):
    rows = [(k, i, "ok" if (i * k) % 7 < 5 else "dead") for i in range(30) for k in (1, 2, 3)]
    for n in range(3):
        part = rows[n * 30 : n * 30 + 30] + rows[:5]  # some come again
        spark.createDataFrame(part, "k int, i bigint, s string").coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    log = spark.readStream.schema("k int, i bigint, s string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    out = folds.streak_stream(log, "k", "i", "s", ["dead"])
    q = out.writeStream.foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(str(tmp_path / f"out/{n}"))).outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = {}
    for n in range(3):
        last |= {r.k: (r.s, r.streak, r.failures) for r in spark.read.parquet(str(tmp_path / f"out/{n}")).collect()}
    log = spark.createDataFrame(rows, "k int, i bigint, s string")
    want = {r.k: (r.s, r.streak) for r in state.streak(log, "k", "i", "s").collect()}
    assert {k: v[:2] for k, v in last.items()} == want and {k: v[2] for k, v in last.items()} == {k: s[1] if s[0] == "dead" else 0 for k, s in want.items()}


def test_inspect_gathers_what_belongs_to_a_site(spark):
    from citeflow.operators import inspect

    h = spark.range(1).select(F.sha2(F.lit("http://a.com/x"), 256)).first()[0]
    make = spark.createDataFrame
    tables = {
        "domains": make([(1, "a.com"), (2, "b.com")], "domain_id int, registrable_domain string"), "urls": make([(h, "http://a.com/x", 1), ("h2", "http://b.com/", 2)], "url_hash string, url string, domain_id int"),
        "url_checks": make([(10, h, 5), (11, h, 6), (12, "h2", 7)], "check_id int, url_hash string, checked_at int"), "url_classifications": make([(10, h, "1+a", "live"), (10, h, "1+b", "parked")], "check_id int, url_hash string, classifier_version string, classification string"),
        "domain_checks": make([(20, 1, 5)], "check_id int, domain_id int, checked_at int"), "domain_classifications": make([(20, 1, "active")], "check_id int, domain_id int, state string"),
        "links": make([(1, h, 7, "r", "done"), (2, h, 8, "r", "pending")], "id int, url_hash string, page_id int, dump_run string, enrich_status string"), "pages": make([(7, "r", "Z"), (8, "r", "A")], "page_id int, dump_run string, title string"),
    }
    assert inspect.resolve(tables, "http://A.com/x") == ("url", h) and inspect.resolve(tables, "www.a.com/none") == ("domain", "a.com") and inspect.resolve(tables, "c.com")[0] == "unknown"
    got = inspect.gather(tables, "a.com")
    assert [r.check_id for r in got["checks"].collect()] == [11, 10, 10] and [r.title for r in got["citations"].collect()] == ["Z", "A"] and got["domain_checks"].first().state == "active" and got["urls"].count() == 1
    assert set(inspect.gather(tables, "http://a.com/x")) == {"domain", "urls", "checks", "citations"} and inspect.gather(tables, "nowhere.org") == {}
    seen, now = [], [0.0]
    r = inspect.Refresher(lambda b: seen.append(b), 5, lambda: now[0])
    for t in (0, 3, 6, 7):
        now[0] = t
        r(t, t)
    assert seen == [0, 6] and r(9, 9, force=True) and seen[-1] == 9
    page = inspect.gap_page(make([("a", True, "200"), ("b", None, None)], "url_hash string, has boolean, status string"), make([("a", 1), ("a", 2), ("b", 1)], "url_hash string, page_id int"), classify.gap_verdict(F.col("has"), F.col("status")))
    assert sorted(map(tuple, page["reach"].collect())) == [("recoverable", 2, 2), ("unknown", 1, 1)]
