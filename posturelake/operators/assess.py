"""One run from evidence to reports: who runs, what is found, what is told of it, and whether a host fails."""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.secrets import redact_attributes
from ..sources import sinks
from . import engine, report, rules


class Assessment(NamedTuple):
    """Tables of a run: ``findings`` in order (``place``), ``summary`` with ``failed`` (a row per host with findings), ``limitations``, and of what was given ``secrets``, ``identities`` and ``modules``."""

    findings: DataFrame
    summary: DataFrame
    limitations: DataFrame
    secrets: DataFrame | None = None
    identities: DataFrame | None = None
    modules: DataFrame | None = None

    def reports(self) -> DataFrame:
        """One nested report per host that has findings."""
        return sinks.reports(self.findings, self.summary, self.limitations)

    def integrity(self, header: tuple[str, ...] = ()) -> DataFrame:
        """AGG-18 over all parts."""
        none = self.findings.where("false")
        secrets = none.selectExpr("host_id", "'' AS location", "'' AS fingerprint") if self.secrets is None else self.secrets
        people = none.selectExpr("host_id", "'' AS id", "'' AS canonical", "0 AS strength") if self.identities is None else self.identities
        modules = none.selectExpr("host_id", "'' AS module_id", "'' AS status") if self.modules is None else self.modules
        return report.integrity(self.findings, secrets, people, modules, self.limitations, header)

    def rows(self, header: tuple[str, ...] = ()) -> DataFrame:
        """SNK-01's rows: every part of every host's report, with its digest."""
        parts = {"finding": self.findings, "summary": self.summary, "limitation": self.limitations, "secret": self.secrets, "identity": self.identities, "module": self.modules, "integrity": self.integrity(header)}
        return sinks.report_rows(**{name: df for name, df in parts.items() if df is not None})


def assess(
    tables: rules.Tables,
    depth: int | None = None,
    include: Iterable[str] = (),
    exclude: Iterable[str] = (),
    min_severity: str = "",
    threshold: str = "",
    identities: DataFrame | None = None,
    modules: DataFrame | None = None,
    registry: DataFrame | None = None,
    selected: list[str] | None = None,
) -> Assessment:
    """Evaluate, score, filter, order and sum up the evidence in ``tables``, which holds ``hosts``, a row per host.

    ``depth`` lowers the hosts' own depth, never raises it. ``include`` and ``exclude`` choose rules by id: an empty ``include`` takes all, ``exclude`` wins, an unknown
    id is an error. Findings below ``min_severity`` are left out of everything; a host fails with a finding of ``threshold`` or above, and none fails without one.
    With ``registry``, the fixed module table, modules are gated: rules of modules that are not ``selected`` (None: all are) or, on Windows hosts without ``privileged``, need privileges, find nothing, and
    what was gated is told by the limitations and by ``modules``, unless statuses are given by that name.
    Secret-shaped attributes are redacted once fingerprints are made (RED-01). ``limitations`` names the chosen rules that did not run, after those of ``modules`` (AGG-09's input).
    Findings are checkpointed once, so that rules run once however many of the tables are read. Hosts without findings have no summary.
    """
    if unknown := {*include, *exclude} - rules.BY_ID.keys():
        raise ValueError(f"no such rules: {sorted(unknown)}")
    chosen = [r.id for r in rules.RULES if (not include or r.id in include) and r.id not in exclude]
    if selected is not None and registry is None:
        raise ValueError("modules are selected from a registry")
    if selected is not None:
        chosen = [x for x in chosen if rules.BY_ID[x].module in selected]
    if depth is not None:
        tables = {**tables, "hosts": tables["hosts"].withColumn("depth", F.least("depth", F.lit(depth)))}
    catalogue = rules.metadata(tables["hosts"].sparkSession).where(F.col("rule_id").isin(chosen))
    found = report.at_least(engine.find(tables, catalogue, chosen), min_severity)
    if registry is not None:
        hosts = tables["hosts"]
        bare = hosts.where(engine.needs_privilege(F.lit(next(iter(engine.NEED_PRIVILEGE))), F.col("platform"), F.col("privileged") if "privileged" in hosts.columns else F.lit(False))).select(F.col("host_id").alias("bare"))
        found = found.join(bare, (F.col("host_id") == F.col("bare")) & F.col("module_id").isin(*engine.NEED_PRIVILEGE), "left_anti")
        modules = engine.module_gate(hosts, registry, selected) if modules is None else modules
    found = report.finding_order(found.withColumn("attributes", redact_attributes(F.col("attributes"))))
    summary = report.summary(found, identities)
    failed = report.fail_on(found, threshold, min_severity) if threshold else summary.select("host_id", F.lit(False).alias("failed"))
    skipped = engine.applicability(tables["hosts"], catalogue).where("reason <> ''")
    limits = report.rule_limitations(skipped).withColumn("place", F.lit(1)) if modules is None else report.ordered_limitations(modules, skipped)
    return Assessment(found, summary.join(failed, "host_id"), limits, tables.get("secrets"), identities if identities is None or "host_id" in identities.columns else identities.withColumn("host_id", F.col("scope").cast("long")), modules)
