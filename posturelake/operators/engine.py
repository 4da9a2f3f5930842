"""The rule engine: who runs, what is found, how it scores and what is the same (ENG-01 to ENG-09)."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.risk import FORMULA, score
from . import rules as R


def applicability(hosts: DataFrame, catalogue: DataFrame) -> DataFrame:
    """ENG-01: (host_id, rule_id, reason) for each host and rule; the reason is empty where the rule runs.

    The catalogue has a fixed number of rows, so that the product grows with the hosts alone.
    """
    reason = (
        F.when((F.size("platforms") > 0) & ~F.array_contains("platforms", F.col("platform")), F.concat(F.lit("not applicable on "), "platform"))
        .when(F.col("depth") < F.col("min_depth"), F.format_string("requires depth %d, running at %d", "min_depth", "depth"))
        .when(~F.col("authorized"), "target authorization not granted")
        .otherwise("")
    )
    return hosts.select("host_id", "platform", "depth", "authorized").crossJoin(F.broadcast(catalogue)).select("host_id", "rule_id", reason.alias("reason"))


def module_applicability(hosts: DataFrame, modules: DataFrame, selected: list[str] | None = None) -> DataFrame:
    """ENG-02: (host_id, module_id, reason) by implementation, selection, platform and depth; ``modules`` is the fixed module table."""
    chosen = F.lit(True) if selected is None else F.col("module_id").isin(selected)
    reason = (
        F.when(~F.col("implemented"), "not implemented")
        .when(~chosen, "not selected")
        .when((F.size("platforms") > 0) & ~F.array_contains("platforms", F.col("platform")), F.concat(F.lit("not applicable on "), "platform"))
        .when(F.col("depth") < F.col("min_depth"), F.format_string("requires depth %d, running at %d", "min_depth", "depth"))
        .otherwise("")
    )
    return hosts.select("host_id", "platform", "depth").crossJoin(F.broadcast(modules)).select("host_id", "module_id", reason.alias("reason"))


# The modules that need privileges on Windows, and the capabilities that are missing without.
NEED_PRIVILEGE = {"binary-integrity": ["authenticode", "codesign"], "persistence": ["systemd"], "os-posture": ["registry"], "process-service": ["processes"]}


def needs_privilege(module: Column, platform: Column, privileged: Column) -> Column:
    """Whether a module can't run on a host for want of privileges; a host of which that is not known has none."""
    return module.isin(*NEED_PRIVILEGE) & F.coalesce(platform == "windows", F.lit(False)) & ~F.coalesce(privileged, F.lit(False))


def module_gate(hosts: DataFrame, modules: DataFrame, selected: list[str] | None = None) -> DataFrame:
    """ENG-02 with privileges: (host_id, module_id, name, status, reason, unavailable) of every module on every host; what runs is ``complete`` so far. ``modules`` is the fixed module table; ``hosts`` may have ``privileged``."""
    known = hosts.select("host_id", F.col("platform").alias("on"), (F.col("privileged") if "privileged" in hosts.columns else F.lit(False)).alias("privileged"))
    rows = module_applicability(hosts, modules, selected).join(F.broadcast(modules.select("module_id", "name")), "module_id").join(known, "host_id")
    bare = (F.col("reason") == "") & needs_privilege(F.col("module_id"), F.col("on"), F.col("privileged"))
    missing = F.create_map(*[x for name, names in NEED_PRIVILEGE.items() for x in (F.lit(name), F.array(*map(F.lit, names)))])
    status = F.when(bare, "requires_privilege").when(F.col("reason") != "", "skipped").otherwise("complete")
    unavailable = F.when(bare, F.try_element_at(missing, F.col("module_id"))).otherwise(F.array().cast("array<string>"))
    return rows.select("host_id", "module_id", "name", status.alias("status"), F.when(bare, "requires privileges").otherwise(F.col("reason")).alias("reason"), unavailable.alias("unavailable"))


def choose(df: DataFrame, column: str, include: list[str] = (), exclude: list[str] = ()) -> DataFrame:
    """ENG-03: an empty include keeps all; exclude wins."""
    if include:
        df = df.where(F.col(column).isin(*include))
    return df.where(~F.col(column).isin(*exclude)) if exclude else df


def evaluate(tables: R.Tables, only: Iterable[str] | None = None) -> DataFrame:
    """ENG-04: matches of the rules (all by default) that run on their host. ``tables`` holds ``hosts``, a row per host."""
    return R.matches(tables, only, applicable=True)


def status(confidence: Column) -> Column:
    """ENG-06."""
    return F.when(confidence == "confirmed", "confirmed").when(confidence.isin("unknown", "not_observed"), "informational").otherwise("detected")


def state(confidence: Column) -> Column:
    """ENG-06."""
    return F.when(confidence.isin("confirmed", "observed"), "observed").when(confidence.isin("probable", "possible"), "inferred").otherwise("unknown")


def in_order(objects: Column) -> Column:
    """Objects in order, null last; most findings have one, which is not sorted."""
    return F.when(F.size(objects) > 1, F.array_sort(objects)).otherwise(objects)


def fingerprint(rule: Column, category: Column, title: Column, objects: Column, entries: Column) -> Column:
    """ENG-07: SHA-256 over the parts, separated by zero characters; ``entries`` are the attributes as key and value."""
    own = F.array_join(F.concat(F.array(F.lit("")), in_order(objects)), "\x00obj=")  # begins with a separator; null objects are left out
    pairs = F.transform(F.sort_array(entries), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.sha2(F.concat(F.concat_ws("\x00", rule, category, title), own, F.array_join(F.concat(F.array(F.lit("")), pairs), "\x00")), 256)


ENUMS = ("severity", "exposure", "privilege", "sensitivity", "confidence")


def _rated() -> dict[str, Column]:
    """The score and what follows from ENUMS; ``marks`` and ``raw_mark`` are the attributes that it adds, as entries."""
    s, number = score(*map(F.col, ENUMS)), lambda v: F.format_string("%.1f", v)
    entry = lambda key, value: F.struct(F.lit(key).alias("key"), value.alias("value"))
    return {
        "risk_raw": s["risk_raw"], "risk_score": s["risk_score"], "risk_band": s["risk_band"], "status": status(F.col("confidence")), "state": state(F.col("confidence")),
        "marks": F.array(entry("risk_band", s["risk_band"]), entry("risk_formula", F.lit(FORMULA)), entry("risk_score", number(s["risk_score"]))), "raw_mark": F.array(entry("risk_raw", number(s["risk_raw"]))),
    }


#: Columns of a finding.
FINDING = ("host_id", "rule_id", "module_id", "title", "category", *ENUMS, "status", "state", "description", "impact", "objects", "attributes", "risk_raw", "risk_score", "risk_int", "risk_band", "dedupe_key", "fingerprint", "correlated")


def build(matches: DataFrame, catalogue: DataFrame) -> DataFrame:
    """ENG-05 to ENG-08: scored findings, one of those that are the same on a host.

    ``dedupe_key`` hashes what was matched and the score, ``fingerprint`` also the raw score. Matches may carry the columns severity,
    exposure, privilege, sensitivity, confidence, description to override the rule's; without any of the first five the score is that of the catalogue's row.
    Matches that are equal are one before anything is scored or hashed. Where ``description`` is given, those that differ in impact and description alone are one
    as well: that of the least texts; else the impact must follow from the rest, as it does in all rules.
    """
    over = [c for c in (*ENUMS, "description") if c in matches.columns]
    own = {c: f"own_{c}" for c in over}
    text = lambda mine, default: F.coalesce(F.nullif(F.col(mine), F.lit("")), default)
    titles = F.broadcast(catalogue.select("rule_id", "default_title"))  # the catalogue's size is fixed
    same = matches.withColumnsRenamed(own).join(titles, "rule_id").select(
        "host_id", "rule_id", text("title", F.col("default_title")).alias("title"), F.nullif("impact", F.lit("")).alias("impact"),
        F.when(F.size("objects") > 0, in_order(F.col("objects"))).otherwise(F.array("rule_id")).alias("objects"), F.sort_array(F.map_entries("attributes")).alias("entries"), *own.values(),
    ).distinct()
    rates = [c for c in over if c in ENUMS]
    f = same.join(F.broadcast(catalogue if rates else catalogue.withColumns(_rated())), "rule_id")
    if rates:
        f = f.withColumns({c: text(own[c], F.col(c)) for c in rates}).withColumns(_rated())
    f = f.withColumn("description", text("own_description", F.col("default_title")) if "description" in over else F.col("default_title"))
    key = lambda *parts: fingerprint(F.col("rule_id"), F.col("category"), F.col("title"), F.col("objects"), F.concat("entries", *parts))
    f = f.withColumns({
        "impact": F.coalesce("impact", "description"), "attributes": F.map_from_entries(F.concat("entries", "marks")), "dedupe_key": key("marks"), "fingerprint": key("marks", "raw_mark"),
        "risk_int": F.col("risk_score").cast("int"), "correlated": F.lit(False),
    })
    f = f.select(*FINDING)
    if over:
        rank = Window.partitionBy("host_id", "dedupe_key").orderBy("impact", "description", "fingerprint")
        f = f.withColumn("nth", F.row_number().over(rank)).where("nth = 1").drop("nth")
    return f


def _build_flat(flat: DataFrame, catalogue: DataFrame, chosen: list[R.Rule]) -> DataFrame:
    """As ``build`` of matches that ``R.flat_matches`` tells, which are different.

    All of a fingerprint's text but a match's own values is the same for a rule, so that it is put together once in the catalogue: ``d1``, ... before the values of the
    slots and ``d_end`` after them, for ``dedupe_key``; ``f1``, ... with the raw score.
    """
    slots = range(1, R.SLOTS)
    text = lambda e: F.concat(F.lit("\x00"), e["key"], F.lit("="), e["value"])
    band, formula, final, raw = (text(F.col(x)[n]) for x, n in (("marks", 0), ("marks", 1), ("marks", 2), ("raw_mark", 0)))
    marks = {"d": F.concat(band, formula, final), "f": F.concat(band, formula, raw, final)}  # in order of their keys
    lead = lambda n, m: F.when(F.col(f"k{n}").isNull(), "").otherwise(F.concat(F.when(F.col("after") == n, m).otherwise(""), F.lit("\x00"), f"k{n}", F.lit("=")))
    parts = {f"{x}{n}": lead(n, m) for x, m in marks.items() for n in slots} | {f"{x}_end": F.when(F.col("after") == 0, m).otherwise("") for x, m in marks.items()}
    known = catalogue.withColumns(_rated()).join(F.broadcast(R.layout(catalogue.sparkSession, chosen)), "rule_id").withColumns(parts)
    f = flat.join(F.broadcast(known), "rule_id")  # of fixed size
    f = f.withColumn("title", F.coalesce(F.nullif("title", F.lit("")), "default_title"))
    own = F.coalesce(F.concat(F.lit("\x00obj="), "v0"), F.lit(""))
    key = lambda x: F.sha2(F.concat("rule_id", F.lit("\x00"), "category", F.lit("\x00"), "title", own, *[y for n in slots for y in (F.col(f"{x}{n}"), F.coalesce(f"v{n}", F.lit("")))], f"{x}_end"), 256)
    entries = F.array_compact(F.array(*[F.when(F.col(f"k{n}").isNotNull(), F.struct(F.col(f"k{n}").alias("key"), F.col(f"v{n}").alias("value"))) for n in slots]))
    return f.withColumns({
        "description": F.col("default_title"), "impact": F.coalesce(F.nullif("impact", F.lit("")), "default_title"), "objects": F.array("v0"), "attributes": F.map_from_entries(F.concat(entries, "marks")),
        "dedupe_key": key("d"), "fingerprint": key("f"), "risk_int": F.col("risk_score").cast("int"), "correlated": F.lit(False),
    }).select(*FINDING)


def find(tables: R.Tables, catalogue: DataFrame, only: Iterable[str] | None = None) -> DataFrame:
    """ENG-04 to ENG-08: the findings that ``build`` makes of what ``evaluate`` tells. Matches of filter rules are made one while they are plain columns."""
    chosen = R.chosen_rules(tables, only)
    parts = []
    if (flat := R.flat_matches(tables, chosen)) is not None:
        parts.append(_build_flat(flat, catalogue, [r for r in chosen if not r.build]))
    if "secrets" in tables:  # a rule that joins them needs each place and type once
        tables = {**tables, "secrets": tables["secrets"].select("host_id", "location", "type").distinct()}
    if (rest := R.built(tables, chosen, applicable=True)) is not None:
        parts.append(build(rest, catalogue))
    return reduce(DataFrame.unionByName, parts) if parts else build(R.matches(tables, [], applicable=True), catalogue)
