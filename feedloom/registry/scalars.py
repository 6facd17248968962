"""Column expressions applied to whole table columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedloom.functions import json_values as js
from feedloom.functions import labels, text, times
from feedloom.operators.snapshots import LEGACY_CONTAINERS, base_of, container_of, suffix_of, wrap_payload
from feedloom.registry.core import query
from feedloom.registry.views import SNAP_CONTAINER_SQL, WS_SQL, sql_norm_severity, sql_ts, sql_words


@query(
    "latin_digits",
    r"""select doc_id, md5(translate(replace(replace(text, 'e', '٣'), 'a', '۷'), '٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹', '01234567890123456789')) digest
    from documents""",
)
def latin_digits(v):
    """Eastern digits back to Latin, over whole texts that carry both kinds."""
    eastern = F.translate("text", "ea", "٣۷")
    return v.table("documents", "doc_id", "text").select("doc_id", F.md5(text.latin_digits(eastern)).alias("digest"))


@query(
    "norm_severity",
    f"""select level, count(*) n from (select {sql_norm_severity("s")} level from (
      select case when pos % 6 = 0 then 'حرج' when pos % 6 = 1 then 'critical ' when pos % 6 = 2 then 'تم التحقق' else severity end s from items))
    group by 1""",
    ("items",),
)
def norm_severity(v):
    """Items per normalised severity."""
    p = F.col("pos") % 6
    raw = F.when(p == 0, "حرج").when(p == 1, "critical ").when(p == 2, "تم التحقق").otherwise(F.col("severity"))
    return v.items(urls=False).groupBy(labels.norm_severity(raw).alias("level")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "norm_confidence",
    """select level, count(*) n from (select case s when 'verified' then 'verified' when 'unverified' then 'unverified'
      when 'developing' then 'developing' when 'موثق' then 'verified' when 'تم التحقق' then 'verified'
      when 'غير موثق' then 'unverified' when 'قيد التطور' then 'developing' else 'developing' end level from (
      select case when pos % 6 = 0 then 'غير موثق' when pos % 6 = 1 then 'Verified' when pos % 6 = 2 then 'verified' when pos % 6 = 3 then 'unverified' else severity end s from items))
    group by 1""",
    ("items",),
)
def norm_confidence(v):
    """Items per normalised confidence; case matters."""
    p = F.col("pos") % 6
    raw = (
        F.when(p == 0, "غير موثق").when(p == 1, "Verified").when(p == 2, "verified").when(p == 3, "unverified")
        .otherwise(F.col("severity"))
    )
    return v.items(urls=False).groupBy(labels.norm_confidence(raw).alias("level")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "norm_name",
    r"""select text, trim(regexp_replace(regexp_replace(strip_accents(regexp_replace(lower(text), '([à-öø-ÿ])', '\1 ', 'g')),
      '[^a-z\s]', ' ', 'g'), '\s+', ' ', 'g')) norm from (select distinct text from conversations)""",
)
def norm_name(v):
    """Normalised form of every distinct text."""
    return text.with_norm_name(v.table("conversations", "text").distinct(), "text")


@query(
    "title_words",
    f"""select word, count(*) n from (select unnest({sql_words("title")}) word from items) group by 1""",
    ("items",),
)
def title_words(v):
    """How many titles hold each title word."""
    words = v.items(labels=False, urls=False).select(F.explode(text.title_words(F.col("title"))).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


_LIMITATION_SQL = (
    "only found|couldn''?t find|limited results|not enough|fewer than|unable to (find|retrieve|locate)"
    "|no (search )?results|could not find"
)


@query(
    "clean_summary",
    f"""select doc_id, md5(case when regexp_matches(s, '(?i){_LIMITATION_SQL}') and length(cleaned) > 20 then cleaned else s end) digest
    from (select *, regexp_replace(array_to_string(list_filter(string_split(regexp_replace(s, '([.!?]){WS_SQL}+', '\\1' || chr(1), 'g'), chr(1)),
        lambda x: not regexp_matches(x, '(?i){_LIMITATION_SQL}')), ' '), '^{WS_SQL}+|{WS_SQL}+$', '', 'g') cleaned
      from (select doc_id, case doc_id % 4 when 0 then 'We only FOUND three. ' || text when 1 then 'There were no results!'
        when 2 then text || ' Sorry, I couldn''t find more.' else text end s from documents))""",
)
def clean_summary(v):
    """Whole texts without the sentences that apologise for the search."""
    i = F.col("doc_id") % 4
    summary = (
        F.when(i == 0, F.concat(F.lit("We only FOUND three. "), "text"))
        .when(i == 1, "There were no results!")
        .when(i == 2, F.concat("text", F.lit(" Sorry, I couldn't find more.")))
        .otherwise(F.col("text"))
    )
    docs = v.table("documents", "doc_id", "text").select("doc_id", summary.alias("summary"))
    return docs.select("doc_id", F.md5(text.clean_summary(F.col("summary"))).alias("digest"))


@query(
    "extract_json",
    r"""select response_id, stage, md5(json_extract_string(case stage when 'whole' then raw when 'fenced' then fenced when 'braces' then braces end, '$.stories[0].headline')) headline
    from (select *, case when json_valid(raw) then 'whole' when json_valid(fenced) then 'fenced' when json_valid(braces) then 'braces' else 'none' end stage
      from (select response_id, raw, regexp_extract(raw, '```(?:json)?\s*([\s\S]*?)```', 1) fenced,
        substr(raw, instr(raw, '{'), length(raw) - instr(reverse(raw), '}') + 2 - instr(raw, '{')) braces from story_responses))""",
    ("story_responses",),
)
def extract_json(v):
    """Recovery stage and recovered headline of every response."""
    headline = F.try_variant_get("value", "$.stories[0].headline", "string")
    return js.recover(v.story_responses(), "raw").select(
        "response_id", F.coalesce("stage", F.lit("none")).alias("stage"), F.md5(headline).alias("headline")
    )


_NUMBERS = ("null", '""', '" 7 "', '"12%"', '"Infinity"', '"1d"', "true", "4.5", '"-2.5e1"')
_NUMBERS_SQL = "[0, 0, 7, 3, 3, 3, 1, 4.5, -25]"


@query(
    "coerce_num",
    f"select event_id, cast(case event_id % 10 when 9 then 3 else {_NUMBERS_SQL}[1 + event_id % 10] end as double) + value total from events",
)
def coerce_num(v):
    """A loosely typed number next to each event value; missing counts as 3."""
    listed = F.array(*[F.lit(f'{{"n":{n}}}') for n in _NUMBERS], F.lit('{"m":1}'))
    payload = F.try_parse_json(F.element_at(listed, (F.col("event_id") % 10 + 1).cast("int")))
    return v.table("events", "event_id", "value").select(
        "event_id", (js.coerce_num(payload, "$.n", 3) + F.col("value")).alias("total")
    )


@query(
    "coerce_str",
    """select event_id, case event_id % 4 when 0 then event_type when 1 then '-' when 2 then '-' else '-' end label from events""",
)
def coerce_str(v):
    """Text fields only: numbers, nulls and missing fields take the default."""
    i = F.col("event_id") % 4
    payload = (
        F.when(i == 0, F.to_json(F.struct(F.col("event_type").alias("s"))))
        .when(i == 1, '{"s":12}')
        .when(i == 2, '{"s":null}')
        .otherwise("{}")
    )
    return v.table("events", "event_id", "event_type").select(
        "event_id", js.coerce_str(F.try_parse_json(payload), "$.s", "-").alias("label")
    )


_RAW_TIMES_SQL = """case pos % 8 when 0 then '12:30' when 1 then '2026' when 2 then 'Apr 28, 2026' when 3 then '' else ts_raw end"""


def _raw_times():
    p = F.col("pos") % 8
    return (
        F.when(p == 0, "12:30").when(p == 1, "2026").when(p == 2, "Apr 28, 2026").when(p == 3, "").otherwise(F.col("ts_raw"))
    )


@query(
    "parse_ts",
    f"select pos, cast(epoch_ms({sql_ts('raw')}) as bigint) ms from (select pos, {_RAW_TIMES_SQL} raw from items)",
    ("items",),
)
def parse_ts(v):
    """Parsed time of every raw timestamp."""
    rows = v.items(labels=False, urls=False).select("pos", _raw_times().alias("raw"))
    return rows.select("pos", times.millis(times.parse_ts(F.col("raw"))).alias("ms"))


@query(
    "format_ts",
    f"""select pos, coalesce(strftime({sql_ts('raw')} + interval 4 hours, '%b %-d, %H:%M'), raw, '') shown_time,
      coalesce(strftime({sql_ts('raw')}, '%b %-d, %Y'), raw, '') shown_date
    from (select pos, {_RAW_TIMES_SQL} raw from items)""",
    ("items",),
)
def format_ts(v):
    """Display forms, the time in a fixed-offset zone."""
    raw = F.col("raw")
    return v.items(labels=False, urls=False).select("pos", _raw_times().alias("raw")).select(
        "pos",
        times.format_datetime(raw, "Asia/Dubai").alias("shown_time"),
        times.format_date(raw).alias("shown_date"),
    )


@query(
    "payload_container",
    f"""select event_id, container, case when container in ('stories', 'messages') then 'none' else container end legacy_container
    from (select event_id, {SNAP_CONTAINER_SQL} container from snaps)""",
    ("snaps",),
)
def payload_container(v):
    """Where each snapshot keeps its items, with and without the newer names."""
    payload = F.try_parse_json("response_data")
    return v.snaps().withColumn("payload", payload).select(
        "event_id",
        container_of(F.col("payload")).alias("container"),
        container_of(F.col("payload"), LEGACY_CONTAINERS).alias("legacy_container"),
    )


@query(
    "cache_key_parts",
    r"""select function_name, split_part(function_name, ':', 1) base,
      case when contains(function_name, ':') then substr(function_name, instr(function_name, ':') + 1) end suffix, count(*) n
    from snaps group by 1, 2, 3""",
    ("snaps",),
)
def cache_key_parts(v):
    """Base and suffix of every snapshot key."""
    key = F.col("function_name")
    return v.snaps().groupBy("function_name").agg(F.count(F.lit(1)).alias("n")).select(
        "function_name", base_of(key).alias("base"), suffix_of(key).alias("suffix"), "n"
    )


@query(
    "payload_wrap",
    """select event_id, json_extract_string(w, '$.cached_at') stamp, case when event_id % 6 = 4 then 2 else 0 end wrapped_items from (
      select event_id, case when event_id % 6 = 4 then json_object('data', cast(response_data as json), 'cached_at', 'T' || event_id)
        else json_merge_patch(cast(response_data as json), json_object('cached_at', 'T' || event_id)) end w from snaps)""",
    ("snaps",),
)
def payload_wrap(v):
    """Payloads stamped with a write time; bare lists are wrapped first."""
    wrapped = wrap_payload(F.col("response_data"), F.concat(F.lit("T"), "event_id"))
    parsed = F.try_parse_json(wrapped)
    listed = F.try_variant_get(parsed, "$.data", "array<variant>")
    is_wrapped = F.col("event_id") % 6 == 4
    return v.snaps().select(
        "event_id",
        F.try_variant_get(parsed, "$.cached_at", "string").alias("stamp"),
        F.when(is_wrapped, F.size(listed)).otherwise(0).alias("wrapped_items"),
    )


