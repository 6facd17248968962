"""Scratch clean-up, refresh cadence and the topic dimension."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedloom import session
from feedloom.sources import topics as tp
from feedloom.streaming.jobs import poll_trigger


def test_old_scratch_tables_go(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_dir", lambda _: str(tmp_path))
    spark.range(3).write.parquet(session.scratch_path(spark, "words"))
    (tmp_path / "kept-by-hand").mkdir()
    assert session.clean_scratch(spark, hours=1) == []
    (gone,) = session.clean_scratch(spark, hours=0)
    assert gone.startswith("words-") and [p.name for p in tmp_path.iterdir()] == ["kept-by-hand"]


def test_poll_cadence():
    assert poll_trigger() == {"processingTime": "15 minutes"} == poll_trigger("some other panel")
    assert {p: poll_trigger(p) for p in tp.POLL_MINUTES} == {p: {"processingTime": f"{m} minutes"} for p, m in tp.POLL_MINUTES.items()}
    assert poll_trigger("default", once=True) == {"availableNow": True}


def test_topic_dimension(spark):
    rows = tp.topic_config(spark).orderBy("ord").collect()
    assert [r.conflict for r in rows] == [k for k in tp.TOPIC_KEYS if k != tp.ALL]
    assert [r.start_date for r in rows] == ["2026-02-28", "2022-02-24", "2024-01-01"]
    assert rows[1].left_label == "Ukraine / West" and rows[1].right_label == "Russia" and "Donbas" in rows[1].search_terms
    people = tp.topic_roster(spark)
    assert people.groupBy("conflict", "kind").count().filter("count <> 5").count() == 0 and people.count() == 30
    assert people.filter(F.col("name") == "Fiona Hill").first().title == "Senior Fellow, Brookings Institution"
    assert tp.topic_sources(spark).groupBy("conflict").count().filter("count <> 4").count() == 0
