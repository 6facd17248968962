"""Translatable text: leaves, chunks, memory merge, rebuild."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedloom.operators import translate as tr
from feedloom.plans.translation import translate_documents, translate_stance
from feedloom.plans.translation import translate_items as translate
from feedloom.registry.core import query
from feedloom.registry.views import sql_trim
from feedloom.sources.topics import LABELS_AR, LEAVES_PER_CHUNK, LEAVES_PER_RETRY, PAYLOAD_LIMIT, labels_ar

_OK = (
    "coalesce({0} <> '' and not regexp_matches({0}, '(?i)^https?://') and not regexp_matches({0}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}')"
    " and regexp_matches({0}, '[A-Za-z]'), false)"
)


def sql_ok(x: str) -> str:
    return _OK.format(x)


def sql_latin(x: str) -> str:
    return f"translate({x}, '٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹', '01234567890123456789')"


_KNOWN = "select value, arg_min(translation, memory_id) translation from memory group by 1"


@query(
    "label_translate",
    f"""with dict as (select * from (values {", ".join(f"('{en}', '{ar}')" for en, ar in LABELS_AR)}) d(en, ar))
    select conflict, coalesce(l.ar, left_label) as label, coalesce(l.ar, left_label) left_label, coalesce(c.ar, center_label) center_label, coalesce(r.ar, right_label) right_label
    from config left join dict l on l.en = left_label left join dict c on c.en = center_label left join dict r on r.en = right_label""",
    ("config",),
)
def label_translate(v):
    """Topic and stance labels in Arabic where the dictionary has them."""
    rows = v.config().select("conflict", F.col("left_label").alias("label"), "left_label", "center_label", "right_label")
    return tr.label_translate(rows, labels_ar(v.spark), ("label", "left_label", "center_label", "right_label"))


@query(
    "translation_merge",
    f"""select kind, doc, coalesce({sql_trim('translation')} <> '', false) translated,
      coalesce(translation = '' or {sql_trim('translation')} = {sql_trim('value')}, true) retry,
      md5({sql_latin(f"case when coalesce({sql_trim('translation')} <> '', false) then translation else value end")}) result
    from leaves left join ({_KNOWN}) using (value)""",
    ("leaves", "memory"),
)
def translation_merge(v):
    """Every leaf with its translation, or the original where there is none."""
    merged = tr.translation_merge(v.leaves(), v.memory())
    return merged.select("kind", "doc", "translated", "retry", F.md5("result").alias("result"))


@query(
    "leaf_chunks",
    f"""select kind, doc, cast(floor(n / {LEAVES_PER_CHUNK}) as bigint) chunk, cast(floor(n / {LEAVES_PER_RETRY}) as bigint) retry_chunk, 'v' || n leaf_id, md5(value) digest from (
      select 'conv' kind, conv_id doc, text as value, row_number() over (partition by conv_id order by turn) - 1 n from conversations where {sql_ok('text')})""",
)
def leaf_chunks(v):
    """Leaves of each conversation numbered and cut into chunks."""
    leaves = v.table("conversations", "conv_id", "turn", "text").filter(tr.is_translatable(F.col("text"))).select(
        F.lit("conv").alias("kind"), F.col("conv_id").alias("doc"), "turn", F.col("text").alias("value")
    )
    chunked = tr.chunk_leaves(leaves, "doc", "turn")
    retry = F.floor(F.col("n") / LEAVES_PER_RETRY).alias("retry_chunk")
    return chunked.select("kind", "doc", "chunk", retry, "leaf_id", F.md5("value").alias("digest"))


@query(
    "chunk_maps",
    f"""select doc, chunk, count(*) n_leaves, md5(arg_min(value, n)) first_value from (
      select *, cast(floor(n / {LEAVES_PER_CHUNK}) as bigint) chunk from (
      select conv_id doc, text as value, row_number() over (partition by conv_id order by turn) - 1 n from conversations where {sql_ok('text')}))
    group by 1, 2""",
)
def chunk_maps(v):
    """One map per chunk, as a translator would receive it."""
    leaves = v.table("conversations", "conv_id", "turn", "text").filter(tr.is_translatable(F.col("text"))).select(
        F.col("conv_id").alias("doc"), "turn", F.col("text").alias("value")
    )
    maps = tr.chunk_maps(tr.chunk_leaves(leaves, "doc", "turn"), "doc")
    first = F.try_element_at("mapping", F.concat(F.lit("v"), F.col("chunk") * LEAVES_PER_CHUNK))
    return maps.select("doc", "chunk", F.size("mapping").cast("bigint").alias("n_leaves"), F.md5(first).alias("first_value"))


@query(
    "json_leaves",
    f"""select doc_id, path, md5(value) digest from (
      select doc_id, 'headline' path, split_part(text, chr(10), 1) as value from documents
      union all select doc_id, 'detail.body.0', text from documents
      union all select doc_id, 'detail.body.1.note', 'Seen in ' || lang from documents)
    where {sql_ok('value')}""",
)
def json_leaves(v):
    """Translatable strings of a nested payload made from every document."""
    docs = v.table("documents", "doc_id", "text", "lang", "source")
    note = F.struct(F.concat(F.lit("Seen in "), "lang").alias("note"), F.lit("https://x.example").alias("url"))
    payload = F.concat(
        F.lit('{"headline":'),
        F.to_json(F.struct(F.substring_index("text", "\n", 1).alias("v"))),
        F.lit(',"detail":{"severity":"high","body":['),
        F.to_json(F.struct(F.col("text").alias("v"))),
        F.lit(","),
        F.to_json(note),
        F.lit(']},"source":{"name":"Skipped whole"},"n":7}'),
    )
    # The helper structs above only serve to quote text; unwrap {"v":...}.
    payload = F.regexp_replace(payload, r'\{"v":("(?:[^"\\]|\\.)*+")\}', "$1")
    leaves = tr.json_leaves(docs.select("doc_id", payload.alias("payload")), "doc_id", "payload")
    return leaves.select("doc_id", "path", F.md5("value").alias("digest"))


_ITEM_FIELDS = ("title", "body")


@query(
    "rebuild_items",
    f"""select pos, md5(case when {sql_ok('title')} then {sql_latin("replace(title, 'e', '٣')")} else title end) title,
      md5(case when {sql_ok('body')} then {sql_latin("replace(body, 'e', '٣')")} else body end) body from items""",
    ("items",),
)
def rebuild_items(v):
    """Rewritten leaves put back into their rows."""
    rows = v.items(labels=False, urls=False).select("pos", "title", "body")
    leaves = tr.field_leaves(rows, ("pos",), _ITEM_FIELDS).withColumn("result", tr.latin_digits(F.replace("value", F.lit("e"), F.lit("٣"))))
    rebuilt = tr.rebuild_rows(rows, leaves, ("pos",), _ITEM_FIELDS)
    return rebuilt.select("pos", F.md5("title").alias("title"), F.md5("body").alias("body"))


@query(
    "translate_items",
    f"""select memory_id, md5(case when {sql_ok('value')} then {sql_latin(f"case when coalesce({sql_trim('k.translation')} <> '', false) then k.translation else value end")} else value end) text
    from (select memory_id, value from memory) left join ({_KNOWN}) k using (value)""",
    ("memory",),
)
def translate_items(v):
    """Every message with its text translated from the memory."""
    rows = v.memory().select("memory_id", F.col("value").alias("text"))
    return translate(rows, v.memory(), ("memory_id",), ("text",)).select("memory_id", F.md5("text").alias("text"))


@query(
    "translation_usable",
    """select event_id, case when event_id % 5 = 4 then false when event_id % 6 in (0, 1, 2, 3, 4) and event_id % 5 in (1, 3) then false else true end usable from events""",
)
def translation_usable(v):
    """Snapshot payloads against translations that are complete, cut, or missing."""
    e = F.col("event_id") % 5
    snaps = v.snaps()
    listed = r'\[\{.*\}\]'
    got = (
        F.when(e == 4, F.lit(None))
        .when(e == 1, F.regexp_replace("response_data", listed, "[1]"))
        .when(e == 3, F.regexp_replace("response_data", listed, '"gone"'))
        .when(e == 2, F.regexp_replace("response_data", listed, "[1,2,3]"))
        .otherwise(F.col("response_data"))
    )
    return tr.translation_usable(
        snaps.select("event_id", "response_data"), snaps.select("event_id", got.alias("response_data")), "event_id", "response_data"
    )


def _simulated(seed):
    """A translator with every kind of failure, as a function of a request's numbers."""

    def translator(requests):
        chunk, again = F.col("chunk"), F.col("round") == 2

        def word(key, value):
            return (
                F.when(~again & (key == "v1") & (seed % 2 == 0), "  ")
                .when(~again & (key == "v2") | again & (seed % 3 == 0), value)
                .otherwise(F.concat(F.lit("ar ٣ "), value))
            )

        answer = F.to_json(F.transform_values(F.from_json("mapping", "map<string,string>"), word))
        status = F.when(~again & (seed % 11 == 5), 429).when(((seed + chunk) % 7 == 3) & (F.col("attempt") == 0), 500)
        content = F.concat(F.lit("Here it is:\n```json\n"), answer, F.lit("\n```"))
        return requests.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("attempt")).select(
            "*", status.otherwise(200).alias("status"), F.when((seed + chunk) % 13 == 4, "Sorry.").otherwise(content).alias("content")
        )

    return translator


def _simulated_sql(leaves: str) -> str:
    """``doc, i, result`` of the leaves ``doc, seed, i, value``."""
    return f"""numbered as (select *, row_number() over (partition by doc order by i) - 1 n from ({leaves}) where {sql_ok('value')}),
    once as (select *, case when seed % 11 = 5 or (seed + n // 6) % 13 = 4 or n = 1 and seed % 2 = 0 then null when n = 2 then value
      else 'ar ٣ ' || value end got from numbered),
    stale as (select doc, n, row_number() over (partition by doc order by n) - 1 r from once where got is null or {sql_trim('got')} = {sql_trim('value')}),
    final as (select o.doc, o.i, case when o.seed % 11 = 5 then value when r is not null and seed % 3 <> 0 and (seed + r // 4) % 13 <> 4
      then {sql_latin("'ar ٣ ' || value")} else {sql_latin('coalesce(got, value)')} end result
      from once o left join stale using (doc, n))"""


_PAYLOAD_SQL = """'{{"title":' || to_json({0}) || ',"list":[' || coalesce({1}, '') || '],"source":{{"name":"Kept"}},"empty":{{}},"none":[],"n":1.5}}'"""
_LINES_SQL = """string_agg('{{"a.b":' || to_json({0}) || ',"url":"Not me"}}', ',' order by i)"""


@query(
    "translate_payloads",
    f"""with docs as (select conv_id * 1000 + turn doc, case when turn % 97 = 3 then repeat('long text ', 5001) else text end title,
      (conv_id * 1000 + turn) % 9 k, role from conversations),
    lines as (select doc, i, 'Line ' || i || ' of ' || role as value from docs, lateral (select unnest(range(1, k + 1)) i)),
    {_simulated_sql("select doc, doc seed, 0 i, title as value from docs union all select doc, doc, i, value from lines")},
    old as (select doc, title, {_LINES_SQL.format('value')} listed from docs left join lines using (doc) group by 1, 2),
    new as (select doc, coalesce(t.result, title) title, {_LINES_SQL.format('coalesce(f.result, value)')} listed
      from docs left join lines using (doc) left join final f using (doc, i) left join (select doc, result from final where i = 0) t using (doc) group by 1, 2),
    payloads as (select doc, case when doc % 23 = 5 then '{{"url":"https://x.example","n":[1,2]}}' when doc % 19 = 4 then '[' || {_PAYLOAD_SQL.format("old.title", "old.listed")}
      else {_PAYLOAD_SQL.format("old.title", "old.listed")} end payload, {_PAYLOAD_SQL.format("new.title", "new.listed")} translated from old join new using (doc)),
    judged as (select *, case when length(payload) > {PAYLOAD_LIMIT} then 'too_large' when doc % 23 = 5 then 'nothing' when doc % 19 = 4 then 'invalid'
      when doc not in (select doc from numbered) then 'nothing' when doc % 11 = 5 then 'gave_up' else 'translated' end status from payloads)
    select doc, status, md5(case when status = 'translated' then translated else payload end) digest from judged""",
)
def translate_payloads(v):
    """Nested payloads of every message through a translator that fails now and then."""
    doc = (F.col("conv_id") * 1000 + F.col("turn")).alias("doc")
    title = F.when(F.col("turn") % 97 == 3, F.repeat(F.lit("long text "), 5001)).otherwise(F.col("text"))
    rows = v.table("conversations", "conv_id", "turn", "role", "text").select(doc, "role", title.alias("title"))
    count = (F.col("doc") % 9).cast("int")
    lines = F.transform(
        F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(F.concat(F.lit("Line "), i, F.lit(" of "), F.col("role")).alias("a.b"), F.lit("Not me").alias("url")),
    )
    whole = F.to_json(
        F.struct(
            "title",
            lines.alias("list"),
            F.struct(F.lit("Kept").alias("name")).alias("source"),
            F.create_map().cast("map<string,string>").alias("empty"),
            F.array().cast("array<string>").alias("none"),
            F.lit(1.5).cast("double").alias("n"),
        )
    )
    payload = (
        F.when(F.col("doc") % 23 == 5, '{"url":"https://x.example","n":[1,2]}')
        .when(F.col("doc") % 19 == 4, F.concat(F.lit("["), whole))
        .otherwise(whole)
    )
    docs = rows.select("doc", payload.alias("payload"))
    done = translate_documents(docs, "doc", "payload", _simulated(F.col("doc")))
    return done.select("doc", "status", F.md5("payload").alias("digest"))


_REPORT_LEAVES = """select conflict doc, ord seed, 0 i, summary as value from reports union all
      select conflict, ord, 1, top_left_story from reports union all select conflict, ord, 2, top_center_story from reports"""


@query(
    "stance_translated",
    f"""with dict as (select * from (values {", ".join(f"('{en}', '{ar}')" for en, ar in LABELS_AR)}) d(en, ar)),
    heads as (select source conflict, split_part(text, chr(10), 1) head, doc_id from documents),
    ends as (select conflict, arg_min(head, doc_id) summary, arg_max(head, doc_id) last from heads group by 1),
    reports as (select conflict, ord, left_label, right_label, summary, case when ord % 5 = 0 then ' ' else last end top_left_story,
      'Seen 12 times' top_center_story from ends join config using (conflict)),
    {_simulated_sql(_REPORT_LEAVES)}
    select conflict, coalesce(l.ar, left_label) left_label, coalesce(r.ar, right_label) right_label,
      md5(coalesce(a.result, summary)) summary, md5(coalesce(b.result, top_left_story)) top_left_story, coalesce(c.result, top_center_story) top_center_story
    from reports left join dict l on l.en = left_label left join dict r on r.en = right_label
    left join final a on a.doc = conflict and a.i = 0 left join final b on b.doc = conflict and b.i = 1 left join final c on c.doc = conflict and c.i = 2""",
    ("config",),
)
def stance_translated(v):
    """Stance reports of every topic: labels by dictionary, texts through the translator."""
    heads = v.table("documents", "doc_id", "text", "source").select(
        F.col("source").alias("conflict"), F.substring_index("text", "\n", 1).alias("head"), "doc_id"
    )
    texts = heads.groupBy("conflict").agg(F.min_by("head", "doc_id").alias("summary"), F.max_by("head", "doc_id").alias("last"))
    reports = v.config().select("conflict", "ord", "left_label", "right_label").join(texts, "conflict")
    reports = reports.withColumn("top_left_story", F.when(F.col("ord") % 5 == 0, " ").otherwise(F.col("last")))
    reports = reports.withColumn("top_center_story", F.lit("Seen 12 times")).drop("ord", "last")
    done = translate_stance(reports, "conflict", labels_ar(v.spark), _simulated(F.substring("conflict", 4, 10).cast("int")))
    return done.select(
        "conflict", "left_label", "right_label", F.md5("summary").alias("summary"), F.md5("top_left_story").alias("top_left_story"), "top_center_story"
    )
