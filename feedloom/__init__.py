"""feedloom: Spark-native building blocks for feed intelligence.

Landed pages, channel posts and structured model responses go in; clean,
time-filtered, de-duplicated, ranked and auditable feeds come out.  Everything
is a DataFrame transformation, so Catalyst and AQE pick the physical plan.
"""

from feedloom.session import build_session, prepare

__all__ = ["build_session", "prepare"]
