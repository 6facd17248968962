"""The shared tables seen as feeds, snapshots, logs and rosters.

Each view exists twice, as a DataFrame and as SQL text, and reads its whole
tables.  ``NOW`` stands in for the clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.operators.items import critical_only
from feedloom.operators.snapshots import keep_latest
from feedloom.sources.tables import read_table
from feedloom.sources.topics import CHANNELS, TOPIC_KEYS

NOW = "2024-01-31 00:00:00"
NOW_ISO = "2024-01-31T00:00:00Z"
NOW_EPOCH = 1706659200
TODAY = "2024-01-30"
KNOWN_CHANNELS = tuple(c for c, _ in CHANNELS)
SEEN_CHANNELS = KNOWN_CHANNELS + ("night_watch", "harbor_log")
STANCE_LABELS = ("Iran", "Russia", "China", "Unlisted")

WS_SQL = r"[\t\n\v\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def now() -> Column:
    return F.lit(NOW).cast("timestamp")


def pick(options: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(o) for o in options]), (index + 1).cast("int"))


def iso(epoch: Column) -> Column:
    return F.date_format(F.timestamp_seconds(epoch), "yyyy-MM-dd'T'HH:mm:ss'Z'")


# -- SQL fragments -----------------------------------------------------------------


def sql_list(options: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + o.replace("'", "''") + "'" for o in options) + "]"


def sql_in(options: tuple[str, ...]) -> str:
    return "(" + ", ".join("'" + o.replace("'", "''") + "'" for o in options) + ")"


def sql_iso(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%dT%H:%M:%SZ')"


def sql_ts(raw: str) -> str:
    return (
        f"case when regexp_full_match({raw}, '\\d{{4}}') then try_cast({raw} || '-01-01' as timestamp)"
        f" when regexp_full_match({raw}, '\\d{{4}}-\\d{{2}}') then try_cast({raw} || '-01' as timestamp)"
        f" when regexp_matches({raw}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}([T ].*)?$') then try_cast({raw} as timestamp) end"
    )


def sql_trim(x: str) -> str:
    return f"regexp_replace({x}, '^{WS_SQL}+|{WS_SQL}+$', '', 'g')"


def sql_squeeze(x: str) -> str:
    return f"regexp_replace(lower({sql_trim(x)}), '{WS_SQL}+', ' ', 'g')"


def sql_is_url(x: str) -> str:
    return f"coalesce(regexp_matches({sql_trim(x)}, '(?i)^https?://'), false)"


def sql_words(x: str) -> str:
    return (
        f"list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower({x}), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'),"
        f" lambda w: length(w) > 3))"
    )


def sql_norm_severity(x: str) -> str:
    return (
        f"case lower({x}) when 'critical' then 'critical' when 'high' then 'high' when 'developing' then 'developing'"
        f" when 'verified' then 'verified' when 'info' then 'info' when 'حرج' then 'critical' when 'عالي' then 'high'"
        f" when 'قيد التطور' then 'developing' when 'موثق' then 'verified' when 'تم التحقق' then 'verified'"
        f" when 'معلومات' then 'info' else 'info' end"
    )


_ITEM_TS = "make_timestamp((1704067200 + (d.doc_id * 7919) % 2592000) * 1000000)"
_K = "cast(json_extract_string(props, '$.k') as int)"
_SNAP_LIST = (
    "'[{\"headline\":\"user ' || user_id || '\",\"timestamp\":\"' || stamp || '\"},"
    "{\"headline\":\" USER  ' || user_id || '\",\"timestamp\":\"' || stamp || '\"}]'"
)
_SNAP_TAIL = "case when cached_at is null then '' else ',\"cached_at\":\"' || cached_at || '\"' end || '}'"

SNAP_CONTAINER_SQL = """case when json_type(response_data) = 'ARRAY' then 'array' when json_type(response_data, '$.items') = 'ARRAY' then 'items'
      when json_type(response_data, '$.data') = 'ARRAY' then 'data' when json_type(response_data, '$.stories') = 'ARRAY' then 'stories'
      when json_type(response_data, '$.messages') = 'ARRAY' then 'messages' else 'none' end"""

# name -> (views it builds on, SQL)
SQL_VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "items": (
        (),
        f"""select d.source conflict, d.doc_id pos, split_part(d.text, chr(10), 1) title, d.text body, d.n_chars,
        case when d.doc_id % 41 = 0 then null when d.doc_id % 43 = 0 then 'garbage'
             when d.doc_id % 47 = 0 then strftime({_ITEM_TS}, '%Y-%m-%d') else {sql_iso(_ITEM_TS)} end ts_raw,
        case when l.toxic = 1 then 'critical' when l.quality = 1 then 'High' when l.quality = 0 then 'developing' end severity,
        case when l.doc_id is null then null when l.toxic = 1 then 'right' when l.quality = 1 then 'left' else 'center' end stance,
        case when d.doc_id % 17 = 0 then '' when d.doc_id % 19 = 0 then '  ' || upper(p.url) else p.url end url
        from documents d left join labels l on l.doc_id = d.doc_id left join pages p on p.page_id = d.doc_id""",
    ),
    "messages": (
        (),
        f"""select {sql_list(TOPIC_KEYS)}[1 + conv_id % 4] conflict, conv_id * 1000 + turn pos,
        {sql_list(SEEN_CHANNELS)}[1 + (conv_id * 7 + turn) % 13] channel, text,
        case when (conv_id + turn) % 29 = 0 then null
             else {sql_iso(f"make_timestamp(({NOW_EPOCH} - 60 * ((conv_id * 31 + turn * 17) % 4320)) * 1000000)")} end ts_raw
        from conversations""",
    ),
    "cost_log": (
        (),
        f"""select event_id id, event_type panel,
        case user_id % 3 when 0 then 'scraper' when 1 then 'model' else 'translator' end provider,
        {_K} % 4 = 0 cache_hit,
        case when {_K} % 4 = 0 then cast(0 as decimal(18,6)) else cast(value as decimal(18,6)) end cost_usd,
        ts created_at from events""",
    ),
    "stamped": (
        (),
        f"""select event_id, user_id, ts,
        case event_type when 'view' then 'firecrawl-news' when 'click' then 'analyst-curated'
             when 'purchase' then 'perplexity-osint' when 'signup' then 'telegram-feed'
             else case when user_id % 2 = 0 then 'ai-summarize' else 'legacy-feed' end end
        || case user_id % 6 when 0 then ':all' when 1 then ':iran-us' when 2 then ':ukraine-russia'
             when 3 then ':china-taiwan' when 4 then ':mars' else '' end function_name,
        {sql_iso("ts")} stamp,
        case when event_id % 97 = 0 then null when event_id % 101 = 0 then 'garbage'
             else {sql_iso("ts - to_hours(cast(12 * (user_id % 5) as bigint))")} end cached_at
        from events""",
    ),
    "snaps": (
        ("stamped",),
        f"""select event_id, function_name, cached_at, ts fetched_at,
        case event_id % 6
          when 0 then '{{"items":' || {_SNAP_LIST} || ',"mode":"x"' || {_SNAP_TAIL}
          when 1 then '{{"data":' || {_SNAP_LIST} || {_SNAP_TAIL}
          when 2 then '{{"stories":' || {_SNAP_LIST} || {_SNAP_TAIL}
          when 3 then '{{"messages":' || {_SNAP_LIST} || {_SNAP_TAIL}
          when 4 then {_SNAP_LIST}
          else '{{"items":[]' || {_SNAP_TAIL} end response_data
        from stamped""",
    ),
    "store": (
        ("snaps",),
        """select * from snaps qualify row_number() over (partition by function_name order by fetched_at desc, event_id desc) = 1""",
    ),
    "snap_items": (
        ("snaps",),
        """select event_id, function_name, container, pos - 1 pos, list_items[pos] item from (
        select event_id, function_name, container, list_items, unnest(generate_series(1, len(list_items))) pos from (
        select event_id, function_name,
          from_json(case container when 'array' then cast(response_data as json) else json_extract(response_data, '$.' || container) end,
            '[{"headline":"VARCHAR","timestamp":"VARCHAR"}]') list_items, container
        from (select *, """ + SNAP_CONTAINER_SQL + """ container from snaps)))""",
    ),
    "config": (
        (),
        f"""select s.source conflict, cast(substr(s.source, 4) as int) ord, 'Topic ' || s.source label,
        {sql_list(STANCE_LABELS)}[1 + cast(substr(s.source, 4) as int) % 4] left_label,
        'Neutral / International' center_label,
        {sql_list(STANCE_LABELS)}[1 + (cast(substr(s.source, 4) as int) + 1) % 4] right_label,
        '2024-01-' || lpad(cast(1 + cast(substr(s.source, 4) as int) % 10 as varchar), 2, '0') start_date,
        b.text search_terms
        from (select distinct source from documents) s join benchmark b on 'src' || b.item_id = s.source""",
    ),
    "page_sources": ((), "select 'src' || page_id % 20 conflict, page_id pos, url from pages"),
    "roster": (
        (),
        """select 'src' || p_partkey % 20 conflict, p_partkey ord, p_name as name, p_brand || ' ' || p_type title,
        case when p_size % 2 = 0 then 'official' else 'analyst' end kind from part""",
    ),
    "comments": (
        (),
        """select 'src' || l.l_suppkey % 20 conflict, l.l_quantity quantity,
        case l.l_linenumber % 4 when 0 then p.p_name when 1 then upper(p.p_name) || ', Brand'
          when 2 then split_part(p.p_name, ' ', 1) else p.p_type end author
        from lineitem l join part p on p.p_partkey = l.l_partkey""",
    ),
    "story_json": (
        (),
        f"""select conv_id * 1000 + turn response_id, {sql_list(TOPIC_KEYS)}[1 + conv_id % 4] conflict, (conv_id + turn) % 6 wrap,
        cast(json_object('stories', [
          {{'headline': text, 'severity': {sql_list(('critical', 'HIGH', 'حرج', 'developing', 'verified'))}[1 + turn % 5],
            'timestamp': {sql_iso(f"make_timestamp(({NOW_EPOCH} - 60 * ((conv_id * 31 + turn * 17) % 4320)) * 1000000)")},
            'url': 'https://news.example/' || conv_id}},
          {{'headline': 'No data available', 'severity': 'info', 'timestamp': '', 'url': ''}}]) as varchar) j
        from conversations""",
    ),
    "story_responses": (
        ("story_json",),
        """select response_id, conflict, wrap, case wrap
          when 0 then j
          when 1 then 'Sure.' || chr(10) || '```json' || chr(10) || j || chr(10) || '```'
          when 2 then 'Here is the result: ' || j || ' Hope this helps.'
          when 3 then left(j, length(j) - 3)
          when 4 then '12 items: ' || j
          else j || ' and ' || j end raw
        from story_json""",
    ),
    "memory": (
        (),
        """select conv_id * 1000 + turn memory_id, text as value,
        case when (conv_id * 1000 + turn) % 5 = 0 then '  ' when (conv_id * 1000 + turn) % 7 = 0 then text
             else 'ar ٣۴ ' || text end translation from conversations""",
    ),
    "leaves": (
        (),
        """select 'message' kind, conv_id * 1000 + turn doc, 'text' path, text as value from conversations
        union all select 'document', doc_id, 'title', split_part(text, chr(10), 1) from documents""",
    ),
    "alerts": (
        (),
        """select event_id pos, ts, 'user ' || user_id headline, event_type kind,
        case when event_id % 3 = 0 then '' else ' https://alerts.example/' || event_id end url,
        cast(floor((epoch(ts) - 1704067200) / 604800) as bigint) batch
        from events where event_type = 'error'""",
    ),
    "notifications": (
        (),
        f"""select cast(floor((epoch(ts) - 1704067200) / 604800) as bigint) batch, event_id pos,
        case when event_id % 23 = 0 then '  ' else ' note ' || user_id end headline,
        {sql_iso("ts")} added_at, event_id % 3 = 0 is_read from events""",
    ),
}


class Views:
    """DataFrame twins of ``SQL_VIEWS`` over one table folder."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark = spark
        self.base = base

    def table(self, name: str, *columns: str) -> DataFrame:
        return read_table(self.spark, self.base, name, *columns)

    def items(self, labels: bool = True, urls: bool = True) -> DataFrame:
        """Items from documents; joins only what the caller uses."""
        i = F.col("doc_id")
        seconds = F.lit(1704067200) + (i * 7919) % 2592000
        d = self.table("documents", "doc_id", "text", "source", "n_chars").select(
            "doc_id",
            F.col("source").alias("conflict"),
            i.alias("pos"),
            F.substring_index("text", "\n", 1).alias("title"),
            F.col("text").alias("body"),
            "n_chars",
            F.when(i % 41 == 0, F.lit(None))
            .when(i % 43 == 0, "garbage")
            .when(i % 47 == 0, F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd"))
            .otherwise(iso(seconds))
            .alias("ts_raw"),
        )
        if labels:
            known = self.table("labels", "doc_id", "quality", "toxic").withColumn("labelled", F.lit(True))
            d = (
                d.join(known, "doc_id", "left")
                .withColumn(
                    "severity",
                    F.when(F.col("toxic") == 1, "critical")
                    .when(F.col("quality") == 1, "High")
                    .when(F.col("quality") == 0, "developing"),
                )
                .withColumn(
                    "stance",
                    F.when(F.col("labelled").isNull(), F.lit(None))
                    .when(F.col("toxic") == 1, "right")
                    .when(F.col("quality") == 1, "left")
                    .otherwise("center"),
                )
                .drop("quality", "toxic", "labelled")
            )
        if urls:
            pages = self.table("pages", "page_id", "url").withColumnRenamed("page_id", "doc_id")
            d = d.join(pages, "doc_id", "left").withColumn(
                "url",
                F.when(i % 17 == 0, "").when(i % 19 == 0, F.concat(F.lit("  "), F.upper("url"))).otherwise(F.col("url")),
            )
        return d.drop("doc_id")

    def messages(self) -> DataFrame:
        c, t = F.col("conv_id"), F.col("turn")
        return self.table("conversations", "conv_id", "turn", "text").select(
            pick(TOPIC_KEYS, c % 4).alias("conflict"),
            (c * 1000 + t).alias("pos"),
            pick(SEEN_CHANNELS, (c * 7 + t) % 13).alias("channel"),
            "text",
            F.when((c + t) % 29 != 0, iso(F.lit(NOW_EPOCH) - F.lit(60) * ((c * 31 + t * 17) % 4320))).alias("ts_raw"),
        )

    def cost_log(self) -> DataFrame:
        k = F.get_json_object("props", "$.k").cast("int")
        return self.table("events", "event_id", "event_type", "user_id", "value", "props", "ts").select(
            F.col("event_id").alias("id"),
            F.col("event_type").alias("panel"),
            pick(("scraper", "model", "translator"), F.col("user_id") % 3).alias("provider"),
            (k % 4 == 0).alias("cache_hit"),
            F.when(k % 4 == 0, F.lit(0)).otherwise(F.col("value")).cast("decimal(18,6)").alias("cost_usd"),
            F.col("ts").alias("created_at"),
        )

    def snaps(self) -> DataFrame:
        e, u = F.col("event_id"), F.col("user_id")
        ts = F.col("ts").cast("timestamp")
        base = (
            F.when(F.col("event_type") == "view", "firecrawl-news")
            .when(F.col("event_type") == "click", "analyst-curated")
            .when(F.col("event_type") == "purchase", "perplexity-osint")
            .when(F.col("event_type") == "signup", "telegram-feed")
            .when(u % 2 == 0, "ai-summarize")
            .otherwise("legacy-feed")
        )
        suffix = pick((":all", ":iran-us", ":ukraine-russia", ":china-taiwan", ":mars", ""), u % 6)
        seconds = F.floor(F.unix_millis(ts) / 1000)
        stamped = self.table("events", "event_id", "event_type", "user_id", "ts").select(
            "event_id",
            "user_id",
            F.concat(base, suffix).alias("function_name"),
            iso(seconds).alias("stamp"),
            F.when(e % 97 == 0, F.lit(None))
            .when(e % 101 == 0, "garbage")
            .otherwise(iso(seconds - F.lit(12 * 3600) * (u % 5)))
            .alias("cached_at"),
            ts.alias("fetched_at"),
        )
        listed = F.format_string(
            '[{"headline":"user %d","timestamp":"%s"},{"headline":" USER  %d","timestamp":"%s"}]',
            "user_id", "stamp", "user_id", "stamp",
        )
        tail = F.concat(
            F.coalesce(F.concat(F.lit(',"cached_at":"'), "cached_at", F.lit('"')), F.lit("")), F.lit("}")
        )
        response = (
            F.when(e % 6 == 0, F.concat(F.lit('{"items":'), listed, F.lit(',"mode":"x"'), tail))
            .when(e % 6 == 1, F.concat(F.lit('{"data":'), listed, tail))
            .when(e % 6 == 2, F.concat(F.lit('{"stories":'), listed, tail))
            .when(e % 6 == 3, F.concat(F.lit('{"messages":'), listed, tail))
            .when(e % 6 == 4, listed)
            .otherwise(F.concat(F.lit('{"items":[]'), tail))
        )
        return stamped.select(
            "event_id", "function_name", "cached_at", "fetched_at", response.alias("response_data")
        )

    def store(self) -> DataFrame:
        return keep_latest(self.snaps(), "fetched_at", "event_id")

    def config(self) -> DataFrame:
        bench = self.table("benchmark", "item_id", "text").select(
            F.concat(F.lit("src"), "item_id").alias("conflict"), F.col("text").alias("search_terms")
        )
        ord_ = F.substring("conflict", 4, 10).cast("int")
        return (
            self.table("documents", "source")
            .select(F.col("source").alias("conflict"))
            .distinct()
            .join(bench, "conflict")
            .select(
                "conflict",
                ord_.alias("ord"),
                F.concat(F.lit("Topic "), "conflict").alias("label"),
                pick(STANCE_LABELS, ord_ % 4).alias("left_label"),
                F.lit("Neutral / International").alias("center_label"),
                pick(STANCE_LABELS, (ord_ + 1) % 4).alias("right_label"),
                F.concat(F.lit("2024-01-"), F.lpad((F.lit(1) + ord_ % 10).cast("string"), 2, "0")).alias("start_date"),
                "search_terms",
            )
        )

    def page_sources(self) -> DataFrame:
        return self.table("pages", "page_id", "url").select(
            F.concat(F.lit("src"), F.col("page_id") % 20).alias("conflict"), F.col("page_id").alias("pos"), "url"
        )

    def roster(self) -> DataFrame:
        return self.table("part", "p_partkey", "p_name", "p_brand", "p_type", "p_size").select(
            F.concat(F.lit("src"), F.col("p_partkey") % 20).alias("conflict"),
            F.col("p_partkey").alias("ord"),
            F.col("p_name").alias("name"),
            F.concat_ws(" ", "p_brand", "p_type").alias("title"),
            F.when(F.col("p_size") % 2 == 0, "official").otherwise("analyst").alias("kind"),
        )

    def comments(self) -> DataFrame:
        names = self.table("part", "p_partkey", "p_name", "p_type").withColumnRenamed("p_partkey", "l_partkey")
        n = F.col("l_linenumber") % 4
        return (
            self.table("lineitem", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
            .join(names, "l_partkey")
            .select(
                F.concat(F.lit("src"), F.col("l_suppkey") % 20).alias("conflict"),
                F.col("l_quantity").alias("quantity"),
                F.when(n == 0, F.col("p_name"))
                .when(n == 1, F.concat(F.upper("p_name"), F.lit(", Brand")))
                .when(n == 2, F.substring_index("p_name", " ", 1))
                .otherwise(F.col("p_type"))
                .alias("author"),
            )
        )

    def wrapped(self, rows: DataFrame) -> DataFrame:
        """Model-style responses around the JSON column ``j``."""
        j = F.col("j")
        fence = "```"
        raw = (
            F.when(F.col("wrap") == 0, j)
            .when(F.col("wrap") == 1, F.concat(F.lit(f"Sure.\n{fence}json\n"), j, F.lit(f"\n{fence}")))
            .when(F.col("wrap") == 2, F.concat(F.lit("Here is the result: "), j, F.lit(" Hope this helps.")))
            .when(F.col("wrap") == 3, F.left(j, F.length(j) - 3))
            .when(F.col("wrap") == 4, F.concat(F.lit("12 items: "), j))
            .otherwise(F.concat(j, F.lit(" and "), j))
        )
        return rows.withColumn("raw", raw).drop("j")

    def story_responses(self) -> DataFrame:
        c, t = F.col("conv_id"), F.col("turn")
        story = F.struct(
            F.col("text").alias("headline"),
            pick(("critical", "HIGH", "حرج", "developing", "verified"), t % 5).alias("severity"),
            iso(F.lit(NOW_EPOCH) - F.lit(60) * ((c * 31 + t * 17) % 4320)).alias("timestamp"),
            F.concat(F.lit("https://news.example/"), "conv_id").alias("url"),
        )
        filler = F.struct(
            F.lit("No data available").alias("headline"),
            F.lit("info").alias("severity"),
            F.lit("").alias("timestamp"),
            F.lit("").alias("url"),
        )
        return self.wrapped(
            self.table("conversations", "conv_id", "turn", "text").select(
                (c * 1000 + t).alias("response_id"),
                pick(TOPIC_KEYS, c % 4).alias("conflict"),
                ((c + t) % 6).alias("wrap"),
                F.to_json(F.struct(F.array(story, filler).alias("stories"))).alias("j"),
            )
        )

    def memory(self) -> DataFrame:
        m = F.col("conv_id") * 1000 + F.col("turn")
        return self.table("conversations", "conv_id", "turn", "text").select(
            m.alias("memory_id"),
            F.col("text").alias("value"),
            F.when(m % 5 == 0, "  ").when(m % 7 == 0, F.col("text")).otherwise(F.concat(F.lit("ar ٣۴ "), "text")).alias(
                "translation"
            ),
        )

    def leaves(self) -> DataFrame:
        messages = self.table("conversations", "conv_id", "turn", "text").select(
            F.lit("message").alias("kind"),
            (F.col("conv_id") * 1000 + F.col("turn")).alias("doc"),
            F.lit("text").alias("path"),
            F.col("text").alias("value"),
        )
        titles = self.table("documents", "doc_id", "text").select(
            F.lit("document").alias("kind"),
            F.col("doc_id").alias("doc"),
            F.lit("title").alias("path"),
            F.substring_index("text", "\n", 1).alias("value"),
        )
        return messages.unionByName(titles)

    def _week(self) -> Column:
        return F.floor((F.unix_seconds(F.col("ts").cast("timestamp")) - 1704067200) / 604800).cast("bigint")

    def alert_items(self, events: DataFrame | None = None) -> DataFrame:
        """Every event as an item of some severity; errors are critical ones."""
        e = F.col("event_id")
        severity = (
            F.when(F.col("event_type") == "error", F.when(e % 2 == 0, "CRITICAL").otherwise("حرج"))
            .when(F.col("event_type") == "signup", "High")
            .when(F.col("event_type") == "view", "info")
        )
        events = self.table("events", "event_id", "ts", "user_id", "event_type") if events is None else events
        return events.select(
            e.alias("pos"),
            F.col("ts").cast("timestamp").alias("ts"),
            F.concat(F.lit("user "), "user_id").alias("headline"),
            severity.alias("severity"),
            F.when(e % 3 == 0, "").otherwise(F.concat(F.lit(" https://alerts.example/"), e)).alias("url"),
            self._week().alias("batch"),
        )

    def alerts(self) -> DataFrame:
        return critical_only(self.alert_items())

    def notifications(self) -> DataFrame:
        return self.table("events", "event_id", "ts", "user_id").select(
            self._week().alias("batch"),
            F.col("event_id").alias("pos"),
            F.when(F.col("event_id") % 23 == 0, "  ").otherwise(F.concat(F.lit(" note "), "user_id")).alias("headline"),
            F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("added_at"),
            (F.col("event_id") % 3 == 0).alias("is_read"),
        )
