"""Sinks: ledger, reports, findings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def append_ledger(
    rows: DataFrame, path: str, fmt: str = "json", folders: Sequence[str] = ("chain",)
) -> None:
    """Append ledger rows in a folder per chain, tenants side by side in its files.

    The number of files follows the tasks that write, not the tenants. A ledger of few tenants
    may name ``("tenant_id", "chain")``; it keeps the folders it was begun with.
    """
    rows.write.mode("append").partitionBy(*folders).format(fmt).save(path)


def write_report(sections: dict[str, DataFrame], path: str) -> None:
    """Aggregated report tables, one folder each."""
    for name, df in sections.items():
        df.write.mode("overwrite").json(f"{path}/{name}")


def write_findings(findings: DataFrame, path: str) -> None:
    """Findings by class, so that a reader of one class prunes the rest."""
    findings.write.mode("append").partitionBy("family").parquet(path)
