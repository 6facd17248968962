"""Snapshot audit: clean the items, then delete stale and orphaned snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from feedloom.operators import snapshots as sn
from feedloom.session import cut_lineage
from feedloom.sources.snapshots import SnapshotTable


def audit(store: DataFrame, now: Column, legacy: bool = False) -> tuple[DataFrame, DataFrame]:
    """The store after the audit and the one-row report.

    Cleaned snapshots are stamped first and judged afterwards, so one that had no
    write time survives.
    ``legacy`` looks for items under ``items`` and ``data`` only.
    """
    names = sn.LEGACY_CONTAINERS if legacy else sn.CONTAINERS
    cleaned, counts = sn.clean_snapshots(store, now, names)
    stamped = sn.stamp_touched(store, counts, now)
    kept = stamped.filter(sn.snapshot_verdict(now) == "keep")
    rebuilt = sn.rebuild_snapshots(kept.filter("touched"), cleaned, names)
    after = kept.filter("NOT touched").unionByName(rebuilt).drop("touched")
    return after, sn.audit_report(counts, sn.snapshot_verdicts(stamped, now))


def run_audit(table: SnapshotTable, now: Column, legacy: bool = False) -> DataFrame:
    """Audit a stored table: publish the next version, return the report."""
    after, report = audit(table.read(), now, legacy)
    report = cut_lineage(report)
    table.write(after)
    return report
