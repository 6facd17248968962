"""The operators over their whole tables, as registered queries, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.llm import (
    alignment, divergence, license_scan, line_dedup, lsh_ann, minhash, mixing, packing, quality_mil, simhash, suffix_dedup,
    tool_calls, weak_rules,
)
from feedloom.llm.storage import ready
from feedloom.sources.tables import read_table

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LLM_ORACLES: dict[str, str] = {}


def llm_query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, base: str) -> DataFrame:
            return fn(ready(spark), base)

        run.__name__, run.__doc__ = name, fn.__doc__
        LLM_QUERIES[name] = run
        if sql:
            LLM_ORACLES[name] = sql
        return fn

    return register


@llm_query("op1_quality_mil")
def op1(spark: SparkSession, base: str) -> DataFrame:
    """Attention over passages: a quality score for every document."""
    docs = read_table(spark, base, "documents", "doc_id", "text")
    model = quality_mil.train(docs, read_table(spark, base, "labels", "doc_id", "quality"))
    scores = quality_mil.score_documents(docs, model)
    return scores.selectExpr(
        "doc_id",
        "coalesce(crc32(cast(cast(doc_id as string) as binary)) % 3 = 1, false) as held_out",
        "score",
        "cast(score >= 0.5 as int) as predicted",
        "n_passages",
        "top_attention",
    )


@llm_query("op2_license_scan")
def op2(spark: SparkSession, base: str) -> DataFrame:
    """Every licence notice in every document, with coverage and span."""
    return license_scan.scan_licenses(read_table(spark, base, "documents", "doc_id", "text"))


@llm_query("op3_weak_rules")
def op3(spark: SparkSession, base: str) -> DataFrame:
    """Counts, votes and the posterior verdict for every document."""
    return weak_rules.quality_rules(read_table(spark, base, "documents", "doc_id", "text"))


@llm_query("op4_suffix_dedup")
def op4(spark: SparkSession, base: str) -> DataFrame:
    """What is left of every document without the 50-byte strings of earlier ones."""
    return suffix_dedup.span_digests(read_table(spark, base, "documents", "doc_id", "text"))


@llm_query("op5_tool_calls")
def op5(spark: SparkSession, base: str) -> DataFrame:
    """Calls and results that all conversations make, linked, ordered and judged."""
    turns = read_table(spark, base, "conversations")
    calls, results, needs = tool_calls.from_conversations(turns)
    return tool_calls.link_calls(calls, results, tool_calls.SCHEMAS, needs)


@llm_query("op6_packing")
def op6(spark: SparkSession, base: str) -> DataFrame:
    """Every document's pieces in windows of 2048 tokens."""
    return packing.pack(read_table(spark, base, "documents", "doc_id", "text"))


@llm_query(
    "op7_mixing",
    """
    with recursive sizes as (
      select source, sum(length(text))::double chars from documents group by source
    ), goal as (
      select source, chars, case when chars > 0 then pow(chars, 0.5) else 0.0 end weight from sizes
    ), rates as (
      select source, 1.0::double * (select sum(chars) from goal) * weight / (select sum(weight) from goal) / chars rate
      from goal where weight > 0
    ), means as (
      select source, ceil(rate / 16)::int terms, rate / ceil(rate / 16) mean from rates
    ), steps as (
      select source, mean, 0 k, exp(-mean) p, exp(-mean) c from means
      union all
      select source, mean, k + 1, p * mean / (k + 1), c + p * mean / (k + 1) from steps where k < 80
    ), draws as (
      select d.doc_id, d.source, i.i,
             (('0x' || substr(md5('7:' || i.i || ':' || coalesce(d.doc_id::varchar, md5(d.text), '')), 1, 13))::bigint)::double
               / 4503599627370496.0 u
      from documents d join means m on d.source is not distinct from m.source, lateral (select unnest(range(1, m.terms + 1)) i) i
    ), counts as (
      select r.doc_id, r.source, sum((select count(*) from steps s where s.source is not distinct from r.source and s.c <= r.u)) n
      from draws r group by 1, 2
    )
    select d.doc_id, d.text, d.lang, d.source, d.n_chars, c.copy::int as copy
    from documents d join counts n on d.doc_id = n.doc_id and d.source is not distinct from n.source,
         lateral (select unnest(range(0, n.n::bigint)) copy) c
    """,
)
def op7(spark: SparkSession, base: str) -> DataFrame:
    """All documents, replicated so that sources share characters by the square root of their size."""
    return mixing.mix_sources(read_table(spark, base, "documents"))


@llm_query(
    "op8_line_dedup",
    """
    with rows as (
      select row_number() over () r, doc_id, string_split(coalesce(text, ''), chr(10)) ls from documents
    ), lines as (
      select r, doc_id, unnest(range(1, len(ls) + 1)) i, unnest(ls) line from rows
    ), keyed as (
      select *, translate(trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') k
      from lines
    ), many as (
      select k, max(doc_id) top from keyed where length(k) >= 40 group by k having count(distinct doc_id) >= 5
    ), marked as (
      select r, doc_id, i, line, coalesce(doc_id <> top, false) gone from keyed left join many using (k)
    )
    select doc_id, count(*) n_lines, count(*) filter (gone) n_dropped,
           sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) kept_sha256
    from marked group by r, doc_id
    """,
)
def op8(spark: SparkSession, base: str) -> DataFrame:
    """What is left of every document when shared lines stay in their largest document only."""
    return line_dedup.line_digests(read_table(spark, base, "documents", "doc_id", "text"))


@llm_query(
    "op9_minhash",
    r"""
    with recursive words as (
      select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w
      from documents
    ), shingles as (
      select distinct doc_id, unnest(case when len(w) = 0 then []
        when len(w) < 5 then [array_to_string(w, ' ')]
        else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) s
      from words
    ), sizes as (
      select w.doc_id, count(s) n from words w left join shingles using (doc_id) group by 1
    ), common as (
      select a.doc_id a, b.doc_id b, count(*) n from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2
    ), links as (
      select c.a, c.b from common c join sizes x on x.doc_id = c.a join sizes y on y.doc_id = c.b
      where 100 * c.n >= 75 * (x.n + y.n - c.n)
    ), sides as (select a, b from links union all select b, a from links),
    reach as (
      select doc_id, doc_id as r from sizes
      union
      select reach.doc_id, sides.b from reach join sides on sides.a = reach.r
    ), named as (select doc_id, min(r) component_id from reach group by 1)
    select s.doc_id, s.n n_shingles, component_id, s.doc_id = component_id as kept from sizes s join named using (doc_id)
    """,
)
def op9(spark: SparkSession, base: str) -> DataFrame:
    """The near-duplicate component of every document."""
    return minhash.near_duplicates(read_table(spark, base, "documents", "doc_id", "text"))


@llm_query("op10_lsh_ann")
def op10(spark: SparkSession, base: str) -> DataFrame:
    """The five nearest vectors of every fiftieth vector."""
    vectors = read_table(spark, base, "embeddings", "vec_id", "embedding")
    return lsh_ann.nearest(vectors, F.col("vec_id") % 50 == 0)


@llm_query(
    "op11_divergence",
    r"""
    with docs as (
      select row_number() over () r, coalesce(text, '') t, coalesce(lang, '') lang, coalesce(source, '') source from documents
    ), found as (
      select r, lang, source, unnest(regexp_extract_all(
        translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) term
      from docs
    ), kept as (
      select lang, term from found group by lang, term having count(distinct r) >= 3
    ), sizes as (select lang, count(*) v from kept group by lang),
    groups as (select distinct lang, source from docs),
    counts as (select lang, source, term, count(*) c from found join kept using (lang, term) group by all),
    totals as (select lang, source, sum(c) n from counts group by all),
    shares as (
      select lang, source, term, coalesce(c, 0) c,
             1 + (1000000000::hugeint * (coalesce(c, 0) + 1)) // (coalesce(n, 0) + v) p
      from groups join kept using (lang) join sizes using (lang)
      left join totals using (lang, source) left join counts using (lang, source, term)
    ), whole as (
      select lang, term, 1 + (1000000000::hugeint * (c + 1)) // (n + v) q
      from (select lang, term, sum(c) c from counts group by all) join (select lang, sum(n) n from totals group by all) using (lang)
      join sizes using (lang)
    ), pairs as (
      select a.lang, a.source, b.source item, coalesce(f.value, 0) as value
      from groups a join groups b on a.lang = b.lang and a.source <> b.source
      left join (
        select x.lang, x.source, y.source other, sum((x.p - y.p) * (x.p - y.p) // y.p) as value
        from shares x join shares y on x.lang = y.lang and x.term = y.term and x.source <> y.source group by all
      ) f on f.lang = a.lang and f.source = a.source and f.other = b.source
    ), best as (
      select lang, source, term item, (p - q) * (p - q) // q as value from shares join whole using (lang, term) where c > 0 and p > q
    ), ranked as (
      select lang, source, 'pair' part, item, value, row_number() over (partition by lang, source order by value desc, item) rank from pairs
      union all
      select lang, source, 'term', item, value, row_number() over (partition by lang, source order by value desc, item) from best
    )
    select lang, source, part, item, value::bigint as value, rank::int as rank from ranked where part = 'pair' or rank <= 200
    """,
)
def op11(spark: SparkSession, base: str) -> DataFrame:
    """Divergence of every source from the others and from its language, and the terms that make it."""
    return divergence.audit(read_table(spark, base, "documents", "text", "lang", "source"))


@llm_query("op12_alignment")
def op12(spark: SparkSession, base: str) -> DataFrame:
    """The groups and links of two tokenizers over every document, weighed by corpus-wide counts."""
    return alignment.alignment_digests(read_table(spark, base, "documents", "doc_id", "text"))


@llm_query("op13_simhash")
def op13(spark: SparkSession, base: str) -> DataFrame:
    """The SimHash fingerprint and component of every document."""
    return simhash.near_duplicates(read_table(spark, base, "documents", "doc_id", "text"))


@llm_query("pipeline")
def pipeline(spark: SparkSession, base: str) -> DataFrame:
    """Classifier, line dedup, near-dedup, mixing and packing, one after the other."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, base)
