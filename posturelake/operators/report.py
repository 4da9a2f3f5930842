"""Report aggregates per host and over the fleet (AGG-01 to AGG-22)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.enums import SEVERITY_RANK, STATUS_ORDER, SUPPORT_RANK, lookup, severity_rank
from ..functions.risk import band
from ..plans.lineage import cut, drop_stored, stored
from ..plans.numbering import number_rows

# What entities are ordered by.
ORDERS = {
    "assets": ["kind", "name", "path"],
    "signals": ["type", "value"],
    "software": ["name", "version"],
    "package_sources": ["provider", "uri", "id"],
    "secrets": ["location", "line", "fingerprint"],
    "processes": ["name", "pid"],
    "sockets": ["port", "addr", "process"],
    "accounts": ["name", "uid"],
    "services": ["name"],
    "packages": ["provider", "name", "version"],
}


def summary(findings: DataFrame, identities: DataFrame | None = None) -> DataFrame:
    """AGG-01."""
    out = findings.groupBy("host_id").agg(F.count("*").alias("total"), F.max("risk_int").alias("max_risk"), F.floor(F.sum("risk_int") / F.count("*")).cast("int").alias("mean_risk"), F.count_if("correlated").alias("correlated"))
    out = out.withColumn("risk_band", band(F.col("max_risk")))
    if identities is None:
        return out.withColumn("identity_count", F.lit(0).cast("long"))
    n = identities.groupBy(F.col("scope").cast("long").alias("host_id")).agg(F.count("*").alias("identity_count"))
    return out.join(n, "host_id", "left").fillna(0, ["identity_count"])


def counts(findings: DataFrame, dims: tuple[str, ...] = ("severity", "category", "state")) -> DataFrame:
    """AGG-02: (host_id, dimension, value, n) in one pass over grouping sets."""
    sets = [[F.col("host_id"), F.col(d)] for d in dims]
    grouped = findings.groupingSets(sets, "host_id", *dims).agg(F.count("*").alias("n"), *[F.grouping(d).alias(f"g_{d}") for d in dims])
    name, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for d in dims:
        name, value = F.when(F.col(f"g_{d}") == 0, d).otherwise(name), F.when(F.col(f"g_{d}") == 0, F.col(d)).otherwise(value)
    return grouped.select("host_id", name.alias("dimension"), value.alias("value"), "n")


def severity_counts(findings: DataFrame) -> DataFrame:
    """AGG-03: counts with their place in the fixed order; severities that do not occur have no row."""
    out = findings.groupBy("host_id", "severity").agg(F.count("*").alias("n"))
    return out.withColumn("place", 6 - severity_rank(F.col("severity")))


def at_least(findings: DataFrame, floor: str = "") -> DataFrame:
    """AGG-04: an empty floor and those up to low let everything pass."""
    rank = SEVERITY_RANK.get(floor, 1) if floor else 0
    return findings if rank <= SEVERITY_RANK["low"] else findings.where(severity_rank(F.col("severity")) >= rank)


def at_each_floor(findings: DataFrame, floors: list[str]) -> DataFrame:
    """AGG-04 for several floors in one pass: each finding once for every ``floor`` that lets it pass."""
    least = lambda f: rank if (rank := SEVERITY_RANK.get(f, 1) if f else 0) > SEVERITY_RANK["low"] else 0
    passing = F.array_compact(F.array(*[F.when(severity_rank(F.col("severity")) >= least(f), F.lit(f)) if least(f) else F.lit(f) for f in floors]))
    return findings.withColumn("floor", F.explode(passing))


def fail_on(findings: DataFrame, threshold: str, min_severity: str = "") -> DataFrame:
    """AGG-05: (host_id, failed). A threshold below the minimum severity could never fire and is an error."""
    if min_severity and SEVERITY_RANK[threshold] < SEVERITY_RANK[min_severity]:
        raise ValueError("the threshold is below the minimum severity")
    return findings.groupBy("host_id").agg(F.bool_or(severity_rank(F.col("severity")) >= SEVERITY_RANK[threshold]).alias("failed"))


def _objects() -> Column:
    return F.array_join("objects", "\x00")


def _placed(df: DataFrame, order: list[Column]) -> DataFrame:
    """``place`` of each row within its host, from 1. A host of any size is sorted by many tasks."""
    given = stored(df)  # since a range shuffle reads its input twice
    numbered = number_rows(given, order, within=["host_id"], out="place", keep=stored)
    drop_stored(given)
    return numbered.withColumn("place", (F.col("place") + 1).cast("int"))


def finding_order(findings: DataFrame) -> DataFrame:
    """AGG-06: ``place`` of each finding of a host."""
    return _placed(findings, [F.desc("risk_int"), *map(F.col, ("rule_id", "module_id", "title")), _objects(), F.col("fingerprint")])


def match_order(findings: DataFrame) -> DataFrame:
    """AGG-07: the order before scoring."""
    return _placed(findings, [*map(F.col, ("category", "rule_id", "title")), _objects(), F.col("fingerprint")])


def entity_order(df: DataFrame, entity: str, ties: tuple[str, ...] = ()) -> DataFrame:
    """AGG-08: ``place`` of each row of an entity table within its host."""
    return _placed(df, [F.col(x) for x in (*ORDERS[entity], *ties)])


def limitations(status: DataFrame) -> DataFrame:
    """AGG-09: (host_id, limitation) texts from module status."""
    missing = F.when(F.size("unavailable") > 0, F.concat(F.lit("unavailable: "), F.array_join("unavailable", ", ")))
    detail = F.concat_ws("; ", F.nullif("reason", F.lit("")), missing)
    detail = F.when(detail == "", "some sources could not be read").otherwise(detail)
    text = (
        F.when((F.col("status") == "skipped") & (F.col("reason") != ""), F.concat("name", F.lit(": not assessed ("), "reason", F.lit(")")))
        .when(F.col("status") == "skipped", F.concat("name", F.lit(": not assessed")))
        .when(F.col("status") == "requires_privilege", F.concat("name", F.lit(": requires privileges this run did not have")))
        .when(F.col("status").isin("degraded", "partial"), F.concat("name", F.lit(": incomplete — "), detail))
    )
    return status.select("host_id", text.alias("limitation")).where("limitation IS NOT NULL")


def rule_limitations(skipped: DataFrame, sample: int = 6) -> DataFrame:
    """AGG-10: (host_id, limitation) for each reason that rules were skipped for; a host skips at most the whole catalogue."""
    out = skipped.groupBy("host_id", "reason").agg(F.array_sort(F.collect_list("rule_id")).alias("ids"))
    n = F.size("ids")
    names = F.concat(F.array_join(F.slice("ids", 1, sample), ", "), F.when(n > sample, F.concat(F.lit(" and "), (n - sample).cast("string"), F.lit(" more"))).otherwise(""))
    return out.select("host_id", F.concat(n.cast("string"), F.lit(" rule(s) not evaluated ("), "reason", F.lit("): "), names).alias("limitation"))


def ordered_limitations(status: DataFrame, skipped: DataFrame) -> DataFrame:
    """AGG-09 and AGG-10 together: (host_id, limitation, place), those of modules first; a host has few."""
    both = limitations(status).withColumn("part", F.lit(1)).union(rule_limitations(skipped).withColumn("part", F.lit(2)))
    return both.withColumn("place", F.row_number().over(Window.partitionBy("host_id").orderBy("part", "limitation"))).drop("part")


def module_status(outcomes: DataFrame, assets: DataFrame) -> DataFrame:
    """AGG-11: outcomes (host_id, module_id, failed, degraded) with ``status`` and the number of assets of the module's domain."""
    n = assets.groupBy("host_id", F.col("domain").alias("module_id")).agg(F.count("*").alias("assets"))
    status = F.when(F.col("failed"), "degraded").when(F.col("degraded"), "partial").otherwise("complete")
    return outcomes.withColumn("status", status).join(n, ["host_id", "module_id"], "left").fillna(0, ["assets"])


def weakest_support(df: DataFrame, by: str = "host_id") -> DataFrame:
    """AGG-12."""
    return df.groupBy(by).agg(F.min_by("support", lookup(F.col("support"), SUPPORT_RANK, 1)).alias("support"))


def support_from(rows: Column, unavailable: Column) -> Column:
    """AGG-13: by what was found and how many sources were missing."""
    return F.when((unavailable > 0) & (rows > 0), "partial").when(unavailable > 0, "unavailable").when(rows > 0, "full").otherwise("limited")


def works(support: Column) -> Column:
    """AGG-14: whether a support level lets its module work."""
    return lookup(support, SUPPORT_RANK, 1) >= 3


def capability(status: DataFrame) -> DataFrame:
    """AGG-14: support level and works flag from a module's status."""
    support = F.when(F.col("status") == "complete", "full").when(F.col("status") == "partial", "partial").when(F.col("status") == "degraded", "limited").when(F.col("status") == "requires_privilege", "requires_privilege").otherwise("unavailable")
    return status.withColumn("support", support).withColumn("works", works(F.col("support")))


def secrets_by_type(secrets: DataFrame, first: int = 5) -> DataFrame:
    """AGG-15: the first records of each type, and how many more there are. Record numbers come before any gathering."""
    by = Window.partitionBy("host_id", "type")
    ranked = secrets.withColumn("rn", F.row_number().over(by.orderBy("location", "line", "fingerprint"))).where(F.col("rn") <= first)
    sizes = secrets.groupBy("host_id", "type").agg(F.count("*").alias("n"))
    return ranked.join(sizes, ["host_id", "type"]).withColumn("overflow", F.greatest(F.col("n") - first, F.lit(0)))


def with_objects(findings: DataFrame, first: int = 5) -> DataFrame:
    """AGG-16: the first objects of a finding and the overflow."""
    return findings.withColumns({"shown": F.slice("objects", 1, first), "overflow": F.greatest(F.size("objects") - first, F.lit(0))})


def modules_by_status(status: DataFrame) -> DataFrame:
    """AGG-17: (host_id, status, place, modules); a host has as many modules as the registry."""
    out = status.groupBy("host_id", "status").agg(F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("modules"))
    return out.withColumn("place", lookup(F.col("status"), STATUS_ORDER, 9))


#: Lines, or hashes of the level below, that one node of a hash tree covers.
NODE = 1024
#: What a finding's line and place are made of.
LINE_COLUMNS = ("rule_id", "module_id", "title", "severity", "state", "exposure", "privilege", "sensitivity", "confidence", "fingerprint", "objects", "risk_int")


def report_lines(findings: DataFrame, secrets: DataFrame, identities: DataFrame, modules: DataFrame, limits: DataFrame, depths: DataFrame | None = None) -> DataFrame:
    """(host_id, k, o, t): the lines of every host's report by part and order; each field of a line ends in a zero character. A host's own depth comes first, if ``depths`` (host_id, depth) is given."""
    z = F.lit("\x00")
    parts = lambda *cols: F.concat(*[x for col in cols for x in (F.coalesce(col, F.lit("")), z)])
    line = lambda df, k, order, *cols: df.select("host_id", F.lit(k).alias("k"), order.alias("o"), parts(*cols).alias("t"))
    c = F.col
    pad = lambda n, w=12: F.lpad(n.cast("string"), w, "0")
    f = finding_order(findings.select("host_id", *LINE_COLUMNS))
    rows = line(f, 1, pad(c("place")), c("rule_id"), c("module_id"), c("title"), c("severity"), c("state"), c("exposure"), c("privilege"), c("sensitivity"), c("confidence"), c("fingerprint"), _objects())
    rows = rows.union(line(secrets, 2, F.concat("location", z, "fingerprint"), c("location"), c("fingerprint")))
    rows = rows.union(line(identities, 3, F.concat(pad(100 - c("strength")), c("id")), c("id"), c("canonical")))
    rows = rows.union(line(modules, 4, c("module_id"), c("module_id"), c("status")))
    rows = rows.union(line(limits, 5, pad(c("place")), c("limitation")))
    return rows if depths is None else rows.union(line(depths, 0, F.lit(""), c("depth").cast("string")))


def hash_tree(lines: DataFrame, head: str = "", node: int = NODE) -> DataFrame:
    """(host_id, level, at, part, root) of lines (host_id, k, o, t): the nodes of each host's hash tree.

    A host's lines are numbered by (k, o, t). On level 0 a node covers ``node`` lines, above it as many nodes of the level below; ``part`` is the SHA-256 of what it covers, one after another. A host's
    last level has one node, whose ``root`` is the SHA-256 of ``head`` and the same. So a report of up to ``node`` lines has the digest of its plain text, and none is gathered in one row. One changed line changes one node on each level.
    """
    below = number_rows(lines.select("host_id", "k", "o", "t"), [F.col(x) for x in ("k", "o", "t")], within=["host_id"], out="at", keep=stored).select("host_id", "at", "t")
    tree, level = None, 0
    while True:
        groups = below.groupBy("host_id", F.expr(f"at div {node}").alias("at")).agg(F.array_sort(F.collect_list(F.struct("at", "t"))).alias("parts"))  # ``node`` rows at most
        text = F.array_join(F.transform("parts", lambda x: x["t"]), "")
        nodes = groups.select("host_id", F.lit(level).alias("level"), "at", F.sha2(text, 256).alias("part"), F.sha2(F.concat(F.lit(head), text), 256).alias("root"))
        sizes = nodes.groupBy("host_id").agg(F.count("*").alias("n"))
        nodes = cut(nodes.join(sizes, "host_id"))
        more = nodes.where("n > 1")
        done = nodes.select("host_id", "level", "at", "part", F.when(F.col("n") == 1, F.col("root")).alias("root"))
        tree = done if tree is None else tree.union(done)
        if more.isEmpty():
            return tree
        below, level = more.select("host_id", "at", F.col("part").alias("t")), level + 1


def integrity(findings: DataFrame, secrets: DataFrame, identities: DataFrame, modules: DataFrame, limits: DataFrame, header: tuple[str, ...], depths: DataFrame | None = None, node: int = NODE) -> DataFrame:
    """AGG-18: (host_id, integrity, report_id), the root of the hash tree over a host's ordered report, headed by the texts of ``header``."""
    tree = hash_tree(report_lines(findings, secrets, identities, modules, limits, depths), "".join(h + "\x00" for h in header), node)
    return tree.where("root IS NOT NULL").select("host_id", F.concat(F.lit("sha256:"), "root").alias("integrity"), F.concat(F.lit("rep-"), F.substring("root", 1, 24)).alias("report_id"))


def changed_lines(before: DataFrame, after: DataFrame, node: int = NODE) -> DataFrame:
    """(host_id, first, last): where the lines of two reports may differ, numbered from 0, by the nodes of level 0 of their hash trees. Hosts whose trees agree have no row."""
    a, b = (x.where("level = 0").select("host_id", "at", F.col("part").alias(name)) for x, name in ((before, "was"), (after, "is")))
    return a.join(b, ["host_id", "at"], "full_outer").where(~F.col("was").eqNullSafe(F.col("is"))).select("host_id", (F.col("at") * node).alias("first"), ((F.col("at") + 1) * node - 1).alias("last"))


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """AGG-19: (host_id, fingerprint, change): new, resolved or unchanged findings of two assessments."""
    key = ["host_id", "fingerprint"]
    a, b = (x.select(*key).distinct().withColumn(n, F.lit(True)) for x, n in ((before, "was"), (after, "is")))
    change = F.when(F.col("was").isNull(), "new").when(F.col("is").isNull(), "resolved").otherwise("unchanged")
    return a.join(b, key, "full_outer").select(*key, change.alias("change"))


def told_changes(rows: DataFrame, key: list[str], told: Column | None = None) -> DataFrame:
    """(key, collected_at, change) of findings in successive snapshots, by one shuffle and a sort: a row of ``rows`` is a finding, named by the columns ``key``, in the snapshot of ``collected_at``; ``before`` and
    ``next`` are the times of the snapshots around it, or null. Repeated rows count once. Without ``told`` a row tells only what the next snapshot lacks."""
    by = Window.partitionBy(*key).orderBy("collected_at")
    seen = rows.withColumns({"__seen": F.lag("collected_at").over(by), "__then": F.lead("collected_at").over(by)})
    at, same = F.col("collected_at"), lambda a, b: F.coalesce(F.col(a) == F.col(b), F.lit(False))
    one = lambda when, change: F.struct(when.alias("collected_at"), change.alias("change"))
    own = F.when((F.lit(True) if told is None else told) & ~same("__seen", "collected_at"), one(at, F.when(same("__seen", "before"), "unchanged").otherwise("new")))
    gone = F.when(F.col("next").isNotNull() & ~same("__then", "collected_at") & ~same("__then", "next"), one(F.col("next"), F.lit("resolved")))
    return seen.select(*key, F.explode_outer(F.array(own, gone)).alias("c")).where("c IS NOT NULL").select(*key, "c.*")


def history(snapshots: DataFrame, findings: DataFrame) -> DataFrame:
    """AGG-19 over time: (host_id, rule_id, collected_at, fingerprint, change) for each snapshot of a host against its last one before.

    ``snapshots`` (host_id, collected_at) names every snapshot, also those without findings; ``findings`` has (host_id, collected_at, rule_id, fingerprint). All of a host's first snapshot is new. What a snapshot
    lacks is told as resolved once, at its time. Repeated rows count once; findings of no named snapshot are left out.
    """
    by = Window.partitionBy("host_id").orderBy("collected_at")
    around = {"before": F.lag("collected_at").over(by), "next": F.lead("collected_at").over(by)}
    named = stored(snapshots.select("host_id", "collected_at").distinct().withColumns(around))
    key = ["host_id", "rule_id", "fingerprint"]
    return told_changes(findings.select(*key, "collected_at").join(named, ["host_id", "collected_at"]), key).select("host_id", "rule_id", "collected_at", "fingerprint", "change")


#: Rows that a snapshot is sent in, which spread the state of a host with many findings.
PARTS = 4


def snapshot_rows(snapshots: DataFrame, findings: DataFrame, parts: int = PARTS) -> DataFrame:
    """(host_id, part, collected_at, items): ``parts`` rows for each snapshot, as a stream of snapshots is compared. An item is a rule and a fingerprint of it, ``rule:fingerprint``; which part it is in goes by
    its CRC-32. A part without findings has an empty list, so that what was found before is resolved."""
    item = F.concat("rule_id", F.lit(":"), "fingerprint")
    every = snapshots.select("host_id", "collected_at").distinct().withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    key = ["host_id", "part", "collected_at"]
    found = findings.select("host_id", (F.crc32(item) % parts).cast("int").alias("part"), "collected_at", item.alias("item")).groupBy(*key).agg(F.collect_set("item").alias("items"))
    return every.join(found, key, "left").select(*key, F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def snapshot_items(snapshots: DataFrame, findings: DataFrame, parts: int = PARTS) -> DataFrame:
    """(host_id, part, collected_at, rule_id, fingerprint): as ``snapshot_rows``, but a row for each finding, so that a host with millions is no large row, and one without rule and fingerprint for each part of a snapshot, which tells that it was sent."""
    kinds = dict(findings.dtypes)
    none = [F.lit(None).cast(kinds[x]).alias(x) for x in ("rule_id", "fingerprint")]
    sent = snapshots.select("host_id", "collected_at").distinct().select("host_id", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "collected_at", *none)
    part = (F.crc32(F.concat(F.col("rule_id").cast("binary"), F.col("fingerprint").cast("binary"))) % parts).cast("int")
    return sent.union(findings.select("host_id", part, "collected_at", "rule_id", "fingerprint"))


def suppress(findings: DataFrame, suppressed: DataFrame) -> DataFrame:
    """AGG-20: without the findings of the rules in ``suppressed``."""
    return findings.join(suppressed, "rule_id", "left_anti")


def _outcomes() -> list[Column]:
    n = lambda e: F.count_if(F.col("event") == e)
    return [n("module.started").alias("started"), n("module.completed").alias("completed"), n("module.failed").alias("failed"), n("module.skipped").alias("skipped"), n("asset.discovered").alias("assets"), F.count_if(F.col("level") == "error").alias("errors"), F.max("ts").alias("last_ts")]


def event_rollup(events: DataFrame, *within: Column) -> DataFrame:
    """AGG-21: outcomes per execution, and within each value of the columns ``within``; runs on a table and on a stream."""
    return events.groupBy("execution_id", *within).agg(*_outcomes())


def merge_rollups(parts: DataFrame) -> DataFrame:
    """Outcomes per execution from those of its windows."""
    counts = ("started", "completed", "failed", "skipped", "assets", "errors")
    return parts.groupBy("execution_id").agg(*[F.sum(x).alias(x) for x in counts], F.max("last_ts").alias("last_ts"))


def execution_sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """AGG-21 by sessions: an execution's events that follow each other within ``gap`` are one session, with its first time and outcomes. On a stream with a watermark a session is told once it can grow no more (append mode)."""
    found = events.groupBy("execution_id", F.session_window("ts", gap).alias("session")).agg(*_outcomes())
    return found.select("execution_id", F.col("session.start").alias("first_ts"), *[c for c in found.columns if c not in ("execution_id", "session")])


def host_summary(hosts: DataFrame) -> DataFrame:
    """AGG-22."""
    have = [c for c in ("hostname", "platform", "kernel", "os", "arch", "user_name", "timezone", "locale", "shell", "cloud", "container") if c in hosts.columns]
    return hosts.select("host_id", *have)
