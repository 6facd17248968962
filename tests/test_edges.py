"""Hand-written rows for the corner cases."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from feedloom.functions import json_values as js
from feedloom.functions import labels, text, times
from feedloom.operators import alerts as al
from feedloom.operators import items as it
from feedloom.operators import snapshots as sn
from feedloom.operators import stance as st
from feedloom.operators import translate as tr
from feedloom.operators.pages import position_rank, split_halves
from feedloom.operators.roster import roster_match
from feedloom.operators.topics import derive_all_config, derive_all_roster, derive_all_sources, roster_section
from feedloom.sources import topics as tp

NBSP = chr(0xA0)


def apply(spark, expression, values, kind="STRING"):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i INT, x {kind}")
    return [r[1] for r in df.select("i", expression(F.col("x")).alias("y")).orderBy("i").collect()]


def now():
    return F.lit("2024-01-31 00:00:00").cast("timestamp")


def test_digits_and_dictionaries(spark):
    assert apply(spark, text.latin_digits, ["٠١٢٣٤٥٦٧٨٩", "۰۱۲۳۴۵۶۷۸۹", "a٣b۴5", None]) == ["0123456789", "0123456789", "a3b45", None]
    assert apply(spark, labels.norm_severity, ["CRITICAL", "حرج", "critical ", None, "تم التحقق"]) == [
        "critical", "critical", "info", "info", "verified"]
    assert apply(spark, labels.norm_confidence, ["Verified", "verified", "غير موثق", None]) == [
        "developing", "verified", "unverified", "developing"]


def test_trim_and_urls(spark):
    padded = f"{NBSP}\t HTTPS://x.example \n﻿"
    assert apply(spark, text.trimmed, [padded, "  ", "a b"]) == ["HTTPS://x.example", "", "a b"]
    assert apply(spark, text.http_url_or_null, [padded, "ftp://x", "", None]) == ["HTTPS://x.example", None, None, None]
    assert apply(spark, text.squeezed, [f" A{NBSP}{NBSP}b  C "]) == ["a b c"]


def test_clean_summary(spark):
    values = [
        "Calm week overall.",
        "Coverage leaned left this week. I couldn't find twenty stories. Talks continue in Geneva.",
        "There were no search results.",
        "",
        None,
    ]
    assert apply(spark, text.clean_summary, values) == [
        values[0], "Coverage leaned left this week. Talks continue in Geneva.", values[2], "", None]


def test_extract_json(spark):
    fence = "```"
    cases = [
        ('{"a":1}', "whole", "1"),
        (f'text {fence}json\n{{"a":2}}\n{fence} more', "fenced", "2"),
        (f'text {fence}{{"a":3}}{fence}', "fenced", "3"),
        ('Here: {"a":4} bye', "braces", "4"),
        ('{"a":5} t', "braces", "5"),
        ('12 items: {"a":6}', "braces", "6"),
        ('{"a":1} and {"a":2}', None, None),
        ('{"a":1,"a":7}', "whole", "7"),
        ("null", "whole", None),
        ("1],[2", None, None),
        ('1},{"v":2', None, None),
        ("", None, None),
        ('{"a":', None, None),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i INT, raw STRING")
    got = js.recover(df, "raw").select("i", "stage", F.try_variant_get("value", "$.a", "string").alias("a")).orderBy("i").collect()
    assert [(r.stage, r.a) for r in got] == [(c[1], c[2]) for c in cases]


def test_numbers_and_strings(spark):
    values = ['{}', '{"n":null}', '{"n":""}', '{"n":" 7 "}', '{"n":"12%"}', '{"n":"Infinity"}', '{"n":"1d"}', '{"n":true}', '{"n":-2.5}', '{"n":[1]}', '{"n":"1e3"}']
    got = apply(spark, lambda x: js.coerce_num(F.try_parse_json(x), "$.n", 9), values)
    assert got == [9, 0, 0, 7, 9, 9, 9, 1, -2.5, 9, 1000]
    got = apply(spark, lambda x: js.coerce_str(F.try_parse_json(x), "$.s", "-"), ['{"s":"a"}', '{"s":1}', '{"s":null}', "{}"])
    assert got == ["a", "-", "-", "-"]


def test_timestamps(spark):
    values = ["2026-04-28", "2026-04-28T14:30:00Z", "2026", "12:30", "", "Apr 28, 2026", None, "2026-13-01"]
    got = apply(spark, lambda x: times.iso_utc(times.parse_ts(x)), values)
    assert got == ["2026-04-28T00:00:00Z", "2026-04-28T14:30:00Z", "2026-01-01T00:00:00Z"] + [None] * 5
    assert apply(spark, lambda x: times.format_datetime(x, "Asia/Dubai"), ["2026-04-28T14:30:00Z", "٣ ساعات", None]) == [
        "Apr 28, 18:30", "3 ساعات", ""]
    assert apply(spark, times.format_date, ["2026-04-28"]) == ["Apr 28, 2026"]


def test_freshness(spark):
    values = ["2024-01-30T23:00:00Z", "2024-01-30T23:00:00.001Z", "2024-02-01T00:00:00Z", None, "garbage"]
    assert apply(spark, lambda x: sn.is_fresh(x, F.lit(3_600_000), now()), values) == [False, True, True, False, False]
    newest = ["2024-01-30T22:00:00Z", "2024-01-30T21:59:59.999Z", None]
    assert apply(spark, lambda x: sn.newest_is_fresh(x, now()), newest) == [True, False, False]
    stale = ["2024-01-30T00:00:00Z", "2024-01-29T23:59:59Z", None, "x"]
    assert apply(spark, lambda x: sn.is_stale_snapshot(x, now()), stale) == [False, True, True, True]


def test_range(spark):
    stamps = ["2024-01-02T00:00:00Z", "2024-01-01T23:59:59Z", "2024-01-30T23:59:59Z", "2024-01-31T00:00:00Z", None, "garbage", ""]
    items = spark.createDataFrame([("t", i, s) for i, s in enumerate(stamps)], "conflict STRING, pos BIGINT, ts_raw STRING")
    starts = spark.createDataFrame([("t", "2024-01-02")], "conflict STRING, start_date STRING")
    assert sorted(r.pos for r in it.in_date_range(items, starts, "2024-01-30").collect()) == [0, 2]


def test_keys(spark):
    keys = ["firecrawl-news", "firecrawl-news:all", "firecrawl-news:mars", "perplexity-analyst:all", "a:b:c", "bias-tracker:iran-us"]
    assert apply(spark, sn.is_orphan, keys) == [False, False, True, True, True, False]


def test_expire_then_dedupe(spark):
    rows = [
        ("k", 0, "https://a", "x", "2024-01-01T00:00:00Z"),  # expired, must not shadow the next
        ("k", 1, "https://a", "x", "2024-01-30T00:00:00Z"),
        ("k", 2, None, "Same  Head", "garbage"),
        ("k", 3, None, " same head ", None),
        ("k", 4, "", "twice", None),
        ("k", 5, "", "twice", None),
        ("j", 6, "https://a", "x", None),
    ]
    df = spark.createDataFrame(rows, "key STRING, pos BIGINT, url STRING, title STRING, ts_raw STRING").withColumn(
        "body", F.lit(None).cast("string"))
    live = it.expire_items(df, now(), 48)
    kept = it.dedupe_identity(live, "key")
    assert sorted(r.pos for r in kept.collect()) == [1, 2, 4, 5, 6]
    assert it.dedupe_identity(kept.drop("identity"), "key").count() == 5
    assert sorted(r.pos for r in it.dedupe_identity(live, "key", skip_blank_url=True).collect()) == [1, 2, 4, 6]


def test_urgent_fallback_and_placeholder(spark):
    rows = [("a", 0, "HIGH", "x"), ("a", 1, "info", "y"), ("b", 2, "info", "No recent items"), ("c", 3, None, "no data"), ("c", 4, None, None)]
    df = spark.createDataFrame(rows, "conflict STRING, pos BIGINT, severity STRING, title STRING")
    assert sorted(r.pos for r in it.urgent_or_all(df).collect()) == [0, 2, 3, 4]
    assert sorted(r.pos for r in it.drop_placeholder_sets(df, "conflict").collect()) == [0, 1, 3, 4]


def test_translatable(spark):
    values = ["https://x", "2026-04-28 prose", "12:30", "١٢", "", None, "Attack at 5"]
    assert apply(spark, text.is_translatable, values) == [False] * 6 + [True]


def test_roster(spark):
    roster = tp.topic_roster(spark)
    accented = "Ant" + chr(0xF3) + "nio Guterres"
    names = ["Secretary of State Marco Rubio", "Rubio", accented, "", "g", "MARCO RUBIO!", "Nobody Inparticular"]
    comments = spark.createDataFrame([("iran-us", i, n, "?") for i, n in enumerate(names)], "conflict STRING, id INT, author STRING, affiliation STRING")
    got = {r.id: r.author for r in roster_match(comments, roster).collect()}
    assert got == {0: "Marco Rubio", 1: "Marco Rubio", 4: "Rafael Grossi", 5: "Marco Rubio"}
    got = {r.id: r.author for r in roster_match(comments, roster, strip_marks=True, min_len=2).collect()}
    assert got == {0: "Marco Rubio", 1: "Marco Rubio", 2: "Antonio Guterres", 5: "Marco Rubio"}
    everyone = derive_all_roster(roster)
    zelensky = spark.createDataFrame([("all", 1, "Zelensky", "?")], "conflict STRING, id INT, author STRING, affiliation STRING")
    assert [tuple(r) for r in roster_match(zelensky, everyone).collect()] == [("all", 1, "Volodymyr Zelensky", "President, Ukraine")]


@pytest.mark.parametrize("seed", [1, 2])
def test_roster_matches_plain_contains(spark, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("ab ") for _ in range(rng.randrange(0, 9)))
    people = [("t", i, word(), "job") for i in range(25)] + [("u", 99, "...", "none")]
    authors = [(rng.choice("tu"), i, word(), "?") for i in range(150)]
    norm = lambda s: " ".join("".join(c if c.isalpha() else " " for c in s).split())
    expected = {}
    for c, i, name, _ in authors:
        n = norm(name)
        hit = next((p for p in people if p[0] == c and (norm(p[2]) in n or n in norm(p[2]))), None) if n else None
        if hit:
            expected[i] = hit[2]
    got = roster_match(
        spark.createDataFrame(authors, "conflict STRING, id INT, author STRING, affiliation STRING"),
        spark.createDataFrame(people, "conflict STRING, ord INT, name STRING, title STRING"),
    )
    assert {r.id: r.author for r in got.collect()} == expected


def test_derived_topic(spark):
    config = tp.topic_config(spark)
    row = derive_all_config(config).first()
    assert row.start_date == "2022-02-24" and row.search_terms.count("; ") == 2 and row.n_topics == 3
    sources = derive_all_sources(tp.topic_sources(spark), config).orderBy("first_ord", "first_pos").collect()
    assert [r.url for r in sources] == [u for _, u in tp.TOPIC_SOURCES]
    section = roster_section(tp.topic_roster(spark)).filter("conflict = 'iran-us' AND kind = 'official'").first().section
    assert section.startswith("OFFICIALS:\n- Rafael Grossi (Director General, IAEA)\n- Abbas")


def test_spectrum(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.0), (50.0, 30.0, 30.0), (12.5, 0.5, -0.5)], "left_pct DOUBLE, center_pct DOUBLE, right_pct DOUBLE")
    rows = [r.asDict() for r in st.spectrum(df).collect()]
    assert rows[0]["left_share"] == 0
    assert rows[1]["left_share"] == 50 / 110 * 100
    assert (rows[2]["left_shown"], rows[2]["center_shown"], rows[2]["right_shown"]) == (13, 1, 0)


def test_latest_messages(spark):
    rows = [("a", i, f"2024-01-{i + 1:02d}") for i in range(20)] + [("a", 20, None)] + [("b", i, "same") for i in range(20)]
    got = it.latest_messages(spark.createDataFrame(rows, "conflict STRING, pos BIGINT, ts_raw STRING"), 20).collect()
    assert sorted(r.pos for r in got if r.conflict == "a") == list(range(20))
    assert [r.pos for r in sorted((r for r in got if r.conflict == "b"), key=lambda r: r["rank"])] == list(range(20))


def test_position_rank_in_blocks(spark):
    rng = random.Random(3)
    rows = [(g, p) for g in "ab" for p in rng.sample(range(1000), 101)]
    df = spark.createDataFrame(rows, "conflict STRING, pos BIGINT")
    got = {(r.conflict, r.pos): r["rank"] for r in position_rank(df, "conflict", "pos", block=50).collect()}
    want = {(g, p): i + 1 for g in "ab" for i, p in enumerate(sorted(x for h, x in rows if h == g))}
    assert got == want
    assert split_halves(df).filter("half = 1 AND conflict = 'a'").count() == 51


def test_payloads(spark):
    stamp = lambda x: sn.wrap_payload(x, F.lit("T"))
    assert apply(spark, stamp, ['{"a":1}', "{}", "[1]", '"s"', None]) == [
        '{"a":1,"cached_at":"T"}', '{"cached_at":"T"}', '{"data":[1],"cached_at":"T"}', '{"data":"s","cached_at":"T"}',
        '{"data":null,"cached_at":"T"}']
    assert apply(spark, sn.strip_cached_at, ['{"a":1,"cached_at":"x"}', '{"cached_at":"x"}']) == ['{"a":1}', "{}"]
    shapes = ["[1]", '{"items":[1],"data":[2]}', '{"data":[2]}', '{"stories":[]}', '{"x":1}', None]
    assert apply(spark, lambda x: sn.container_of(F.try_parse_json(x)), shapes) == ["array", "items", "data", "stories", "none", "none"]


def test_upsert_keeps_one_row_per_key(spark):
    schema = "function_name STRING, response_data STRING, cached_at STRING, fetched_at TIMESTAMP"
    at = lambda d: __import__("datetime").datetime(2024, 1, d)
    store = spark.createDataFrame([("a", "1", "x", at(5)), ("b", "2", "x", at(5))], schema)
    changes = spark.createDataFrame([("a", "3", "x", at(1)), ("a", "4", "x", at(2)), ("c", "5", "x", at(1))], schema)
    got = {r.function_name: r.response_data for r in sn.upsert(store, changes).collect()}
    assert got == {"a": "4", "b": "2", "c": "5"}
    assert sn.delete_keys(store, store.filter("false")).count() == 2


def test_audit_rewrites_payloads(spark):
    from feedloom.plans.audit import audit

    schema = "function_name STRING, response_data STRING, cached_at STRING, fetched_at TIMESTAMP"
    fresh, at = "2024-01-30T20:00:00Z", __import__("datetime").datetime(2024, 1, 30)
    items = '[{"url":"u1","timestamp":"2024-01-01"},{"url":"u1"},{"url":"U1 "},{"url":"u2"}]'
    rows = [
        ("perplexity-osint:all", f'{{"items":{items},"note":"n","cached_at":"{fresh}"}}', fresh, at),
        ("firecrawl-news:all", f'{{"stories":{items},"cached_at":"{fresh}"}}', fresh, at),
        ("telegram-feed:all", f"{items}", fresh, at),
        ("bias-tracker:all", f'{{"items":{items},"cached_at":"{fresh}"}}', fresh, at),
        ("old:all", '{"items":[]}', None, at),
        ("ai-summarize", '{"topics":[]}', "2024-01-01", at),
    ]
    store = spark.createDataFrame(rows, schema)
    after, report = audit(store, now())
    got = {r.function_name: r.response_data for r in after.collect()}
    assert set(got) == {"perplexity-osint:all", "firecrawl-news:all", "telegram-feed:all", "bias-tracker:all"}
    count = lambda x, c: F.size(F.try_variant_get(F.try_parse_json(x), f"$.{c}", "array<variant>"))
    assert apply(spark, lambda x: count(x, "items"), [got["perplexity-osint:all"], got["bias-tracker:all"]]) == [2, 4]
    assert apply(spark, lambda x: count(x, "stories"), [got["firecrawl-news:all"]]) == [2]
    assert apply(spark, lambda x: count(x, "data"), [got["telegram-feed:all"]]) == [2]
    assert '"note":"n"' in got["perplexity-osint:all"] and f'"cached_at":"{fresh}"' in got["perplexity-osint:all"]
    assert report.first().asDict() == {
        "audited": 3, "items_before": 12, "items_after": 6, "removed": 6, "deleted_stale": 1, "deleted_orphaned": 1}
    _, legacy = audit(store, now(), legacy=True)
    assert legacy.first().audited == 2


def test_usable_translations(spark):
    cases = [
        ('{"items":[1,2]}', '{"items":[3,4]}', True),
        ('{"items":[1,2]}', '{"items":[3]}', False),
        ('{"items":[1,2]}', "{}", False),
        ('{"items":[1],"n":1}', '{"items":[1]}', True),
        ('{"items":[]}', "{}", True),
        ("[1,2]", "[1]", False),
        ("[1,2]", "[1,2]", True),
        ('{"a":1}', None, False),
    ]
    original = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "doc INT, j STRING")
    translated = spark.createDataFrame([(i, c[1]) for i, c in enumerate(cases)], "doc INT, j STRING")
    got = {r.doc: r.usable for r in tr.translation_usable(original, translated, "doc", "j").collect()}
    assert got == {i: c[2] for i, c in enumerate(cases)}


def test_leaves_and_depth(spark):
    doc = '{"a":"Hello","url":"Skip","b":[{"c":"Deep one"},"x y",7,null],"source":{"name":"Skip"},"d":"2026-01-01 x"}'
    df = spark.createDataFrame([(1, doc), (2, '"Top level"'), (3, "not json")], "doc INT, j STRING")
    got = {(r.doc, r.path): r.value for r in tr.json_leaves(df, "doc", "j").collect()}
    assert got == {(1, "a"): "Hello", (1, "b.0.c"): "Deep one", (1, "b.1"): "x y", (2, ""): "Top level"}
    deep = spark.createDataFrame([(1, '{"k":' * 15 + '"At the end"' + "}" * 15), (2, doc)], "doc INT, j STRING")
    found = {(r.doc, r.path): r.value for r in tr.json_leaves(deep, "doc", "j").collect()}
    assert found == {(1, ".".join("k" * 15)): "At the end", (2, "a"): "Hello", (2, "b.0.c"): "Deep one", (2, "b.1"): "x y"}


def test_channel_corpus_reads_all_channels(spark):
    from feedloom.plans.feeds import corpus

    pages = spark.createDataFrame([(f"u{i}", f"<p>post {i}</p>") for i in range(11)], "url STRING, html STRING")
    sources = spark.createDataFrame([("t", i, f"u{i}") for i in range(11)], "conflict STRING, pos INT, url STRING")
    assert corpus(pages, sources, "channel").first().n_sources == 11
    assert corpus(pages, sources, "news").first().n_sources == 4


def test_unknown_models_are_not_free(spark):
    from feedloom.operators.costs import price_calls
    from feedloom.sources.topics import prices

    calls = spark.createDataFrame(
        [("firecrawl", "scrape-v1", 2, None), ("google_ai", "google/gemini-2.5-flash", 1, None), ("x", "y", 1, None), ("x", "z", 1, 0.5)],
        "provider STRING, model STRING, units INT, cost_usd DOUBLE",
    )
    got = {r.model: None if r.cost_usd is None else float(r.cost_usd) for r in price_calls(calls, prices(spark)).select("model", "cost_usd").collect()}
    assert got == {"scrape-v1": 0.003, "google/gemini-2.5-flash": 0.0008, "y": None, "z": 0.5}


def test_alert_rules(spark):
    batch = spark.createDataFrame([(0, " A ", ""), (1, "a", None), (2, "A", None), (3, " ", None), (4, "B", None)], "pos BIGINT, headline STRING, url STRING")
    store = spark.createDataFrame([("B ",)], "headline STRING")
    got = {(r.pos, r.headline) for r in al.anti_seen(batch, store).collect()}
    assert got == {(0, "A"), (1, "a")}
    notes = spark.createDataFrame([("1", False), ("3", False), ("5", True)], "added_at STRING, is_read BOOLEAN")
    commands = spark.createDataFrame([("clear", "1"), ("mark_read", "3"), ("mark_read", "2")], "command STRING, at STRING")
    assert {tuple(r) for r in al.apply_commands(notes, commands).collect()} == {("3", True), ("5", True)}
    assert al.apply_commands(notes, commands.filter("false")).count() == 3


def test_audit_stamps_before_it_judges(spark):
    """A cleaned snapshot without write time survives; one without items does not."""
    from feedloom.plans.audit import audit
    from feedloom.registry.views import now

    item = '{"headline": "a", "timestamp": ""}'
    store = spark.createDataFrame(
        [("firecrawl-news:all", f"[{item}, {item}]", None), ("perplexity-osint:all", f'{{"items": [{item}]}}', None),
         ("telegram-feed:all", '{"messages": []}', None)],
        "function_name STRING, response_data STRING, cached_at STRING",
    )
    after, report = audit(store, now())
    rows = {r.function_name: (json.loads(r.response_data), r.cached_at) for r in after.collect()}
    assert sorted(rows) == ["firecrawl-news:all", "perplexity-osint:all"]
    assert all(payload["cached_at"] == stamp for payload, stamp in rows.values())
    assert len(rows["firecrawl-news:all"][0]["data"]) == 1
    assert report.first().deleted_stale == 1


def test_default_topic_has_a_corpus(spark):
    """The derived topic's sources, in order of first topic and position, feed the corpus."""
    from feedloom.plans.feeds import corpus

    sources = derive_all_sources(tp.topic_sources(spark), tp.topic_config(spark))
    first = [r.url for r in sources.orderBy("first_ord", "first_pos").collect()][: tp.SOURCES_PER_TOPIC]
    pages = sources.select("url", F.concat(F.lit("<p>text of "), "url", F.lit("</p>")).alias("html"))
    rows = corpus(pages, sources, "news").collect()
    assert [r.n_sources for r in rows] == [len(first)]
    places = [rows[0].corpus.index(f"text of {u}") for u in first]
    assert places == sorted(places)


@pytest.mark.parametrize("files", [0, 3])
def test_streams_read_tables_of_one_file_and_of_several(spark, tmp_path, files):
    from feedloom.registry import QUERIES

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    if files:
        events.repartition(files).write.parquet(f"{tmp_path}/events.parquet")
    else:
        events.toPandas().to_parquet(tmp_path / "events.parquet", coerce_timestamps="us")
    got = QUERIES["cost_stream"](spark, str(tmp_path)).agg(F.sum("n")).first()[0]
    assert got == events.count()
