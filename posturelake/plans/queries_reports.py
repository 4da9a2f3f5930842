"""Queries of secrets and redaction, correlation, and report aggregates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import secrets as S
from ..operators import correlate, engine, report, rules
from ..operators.assess import assess
from ..operators.components import components
from ..streaming import live
from . import rule_oracles as O
from . import secret_oracles as Q
from .queries_core import APPLIES_SQL, FINDINGS_SQL, FINGERPRINT_SQL, findings, flagship
from .lineage import DIGESTS_PLAIN, cut, stored
from .registry import Inputs, query

c = F.col

# SEC and RED over whole texts

def _lines(i: Inputs) -> DataFrame:
    return i.table("documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line")).withColumn("line_no", c("line_no") + 1)


def _scan(i: Inputs) -> DataFrame:
    return S.scan_lines(_lines(i).withColumn("path", F.concat(F.lit("doc:"), c("doc_id").cast("string"))))


query("sec-scan", Q.SCAN)(lambda i: _scan(i).select("doc_id", "line", "type", "field", "length"))
query("sec-rec", f"SELECT 'doc:' || CAST(doc_id AS VARCHAR) AS location, line, type, length, substr(sha256('doc:' || CAST(doc_id AS VARCHAR) || ':' || CAST(line AS VARCHAR) || ':' || type), 1, 12) AS fingerprint FROM ({Q.SCAN})")(lambda i: _scan(i).select("location", "line", "type", "length", "fingerprint"))


query("sec-shape", f"SELECT doc_id, line_no FROM ({Q.LINES}) WHERE {Q.shaped('line')}")(lambda i: _lines(i).where(S.secret_shaped(c("line"))).select("doc_id", "line_no"))
query("sec-key", f"SELECT host_id, name, value, {Q.key_name('name')} AS secret FROM v_env")(lambda i: i.view("v_env").select("host_id", "name", "value", S.secret_key_name(c("name")).alias("secret")))
query("red-01", f"SELECT host_id, name, CASE WHEN {Q.key_name('name')} OR {Q.shaped('value')} THEN '<redacted>' ELSE value END AS value FROM v_env")(
    lambda i: i.view("v_env").withColumn("m", S.redact_attributes(F.create_map("name", "value"))).select("host_id", "name", c("m")[c("name")].alias("value"))
)
query("red-02", f"SELECT doc_id, line_no, CASE WHEN {Q.shaped('line')} THEN '<redacted>' ELSE line END AS data, CASE WHEN {Q.shaped('line')} THEN 'full' ELSE 'none' END AS mode, CASE WHEN {Q.shaped('line')} THEN 'secret-shaped value stripped at render' ELSE '' END AS reason FROM ({Q.LINES})")(
    lambda i: _lines(i).withColumn("e", S.redact_evidence(F.array(F.struct(c("line").alias("data"), F.lit("none").alias("mode"), F.lit("").alias("reason"))))).select("doc_id", "line_no", "e.data", "e.mode", "e.reason").select("doc_id", "line_no", *[c(n)[0].alias(n) for n in ("data", "mode", "reason")])
)
_SHAPED_LINES = f"(SELECT count(*) FILTER (WHERE {Q.shaped('line')}) FROM ({Q.LINES}))"
query("red-03-nested", f"SELECT t.name AS column_name, CAST(t.times * {_SHAPED_LINES} AS BIGINT) AS retained FROM (VALUES ('s.t', 1), ('a[]', 2), ('m{{key}}', 0), ('m{{}}', 1), ('d[].t', 1), ('d[].m{{key}}', 0), ('d[].m{{}}', 1)) AS t(name, times)")(
    lambda i: S.retained_secrets(_lines(i).select(F.struct(c("line").alias("t"), "line_no").alias("s"), F.array("line", "line").alias("a"), F.create_map(F.lit("k"), c("line")).alias("m"), F.array(F.struct(c("line").alias("t"), F.create_map(F.lit("k"), c("line")).alias("m"))).alias("d")))
)
query("red-03", "SELECT * FROM (VALUES ('location', 0), ('type', 0), ('field', 0), ('fingerprint', 0)) AS t(column_name, retained)")(lambda i: S.retained_secrets(_scan(i).select("location", "type", "field", "fingerprint")))


# COR: identities over the signal view

def _distinct_sql(t: str) -> str:
    return f"(strlen({t}) > 2 AND NOT regexp_full_match({t}, '[0-9]*') AND NOT regexp_full_match({t}, '{'|'.join(correlate.COMMON_WORDS)}') AND NOT regexp_matches({t}, '.({'|'.join(correlate.GENERIC_ENDINGS)})$'))"


_LOW = "lower(trim(value))"
_PARTS = f"list_filter(string_split_regex({_LOW}, '[-_. +@/\\\\]'), lambda p: p <> '')"
_OWN = f"list_filter({_PARTS}, lambda p: NOT regexp_full_match(p, '{'|'.join(correlate.PUBLIC_SUFFIXES)}'))"
_LEAF = f"regexp_extract({_LOW}, '[^/\\\\]*$')"
_LOCAL, _DOMAIN = f"split_part({_LOW}, '@', 1)", f"regexp_replace({_LOW}, '^[^@]*@', '')"
_P = _distinct_sql("p")
TOKENS_SQL = f"""SELECT *, CASE
 WHEN type IN ('username', 'account') THEN CASE WHEN {_distinct_sql(_LOW)} THEN ['name:' || {_LOW}] ELSE [] END
 WHEN type = 'home' THEN CASE WHEN {_distinct_sql(_LEAF)} THEN ['name:' || {_LEAF}] ELSE [] END
 WHEN type IN ('email', 'key_comment') THEN CASE WHEN strpos({_LOW}, '@') > 1 THEN list_concat(['email:' || {_LOW}], CASE WHEN {_distinct_sql(_LOCAL)} THEN ['name:' || {_LOCAL}] ELSE [] END, CASE WHEN {_distinct_sql(_DOMAIN)} THEN ['org:' || {_DOMAIN}] ELSE [] END) ELSE [] END
 WHEN type = 'hostname' THEN list_transform(list_filter({_PARTS}, lambda p: {_P}), lambda p: 'name:' || p)
 WHEN type = 'remote' THEN list_concat(CASE WHEN len({_OWN}) >= 2 THEN ['org:' || {_OWN}[2]] ELSE [] END, list_transform(list_filter({_OWN}[3:], lambda p: {_P}), lambda p: 'name:' || p))
 WHEN type = 'org' THEN CASE WHEN {_distinct_sql(_LOW)} THEN ['org:' || {_LOW}] ELSE [] END
 WHEN type = 'project' THEN list_transform(list_filter({_PARTS}, lambda p: {_P}), lambda p: 'proj:' || p)
 WHEN type = 'device' THEN list_transform(list_filter({_PARTS}, lambda p: {_P}), lambda p: 'device:' || p)
 ELSE [] END AS tokens FROM v_signals"""
_BRIDGE = "list_filter(tokens, lambda t: starts_with(t, 'name:') OR starts_with(t, 'email:'))"
KEPT_SQL = f"SELECT host_id, type, value, source, domain, {_BRIDGE} AS tokens FROM ({TOKENS_SQL}) WHERE NOT redacted AND len({_BRIDGE}) > 0"
_COMPONENTS = f"""WITH RECURSIVE kept AS ({KEPT_SQL}),
 e AS (SELECT DISTINCT CAST(host_id AS VARCHAR) || chr(1) || tokens[1] AS a, CAST(host_id AS VARCHAR) || chr(1) || t AS b FROM (SELECT host_id, tokens, unnest(tokens) AS t FROM kept)),
 sym AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
 reach AS (SELECT DISTINCT a AS node, a AS seen FROM sym UNION SELECT r.node, b.b FROM reach r JOIN sym b ON r.seen = b.a),
 comp AS (SELECT node, min(seen) AS component FROM reach GROUP BY node),
 member AS (SELECT k.*, component FROM kept k JOIN comp ON node = CAST(host_id AS VARCHAR) || chr(1) || tokens[1])"""
_RANK = "CASE type WHEN 'username' THEN 0 WHEN 'account' THEN 0 WHEN 'home' THEN 1 WHEN 'email' THEN 2 WHEN 'key_comment' THEN 3 WHEN 'hostname' THEN 4 WHEN 'remote' THEN 5 WHEN 'org' THEN 6 ELSE 7 END"
_plural = lambda n, w: f"CAST({n} AS VARCHAR) || ' {w}' || CASE WHEN {n} = 1 THEN '' ELSE 's' END"
_IDENTITIES = f"""{_COMPONENTS},
 grouped AS (SELECT host_id, component, count(*) AS signal_count, count(DISTINCT type) AS types, count(DISTINCT source) AS all_sources, count(DISTINCT domain) AS n_domains, list_sort(list(DISTINCT source) FILTER (WHERE source <> '')) AS sources, list_sort(list(DISTINCT domain)) AS domains,
   first(value ORDER BY {_RANK}, type, value, source) AS canonical, list(type || '=' || value ORDER BY type, value, source, domain) AS members FROM member GROUP BY host_id, component),
 ident AS (SELECT *, CAST(least(floor(100 * (0.5e0 * types / 8e0 + 0.3e0 * least(1e0, len(sources) / 3e0) + 0.2e0 * least(1e0, n_domains / 3e0)) + 0.5e0), 100) AS INTEGER) AS strength, 'ident-' || substr(sha256(array_to_string(list_concat([canonical], sources), chr(0))), 1, 12) AS id,
   'Identity ' || canonical || ' is disclosed by ' || {_plural('signal_count', 'signal')} || ' across ' || {_plural('types', 'kind')} || ' of observation, from ' || {_plural('all_sources', 'source')} || ' and ' || {_plural('n_domains', 'domain')} || '.' AS summary FROM grouped)"""


def _identities(i: Inputs, **options) -> DataFrame:
    return correlate.identities(i.view("v_signals"), **options).withColumn("host_id", c("scope").cast("long"))


query("cor-01", "SELECT host_id, count(*) FILTER (WHERE redacted) AS redacted, count(*) FILTER (WHERE NOT redacted) AS others FROM v_signals GROUP BY host_id")(lambda i: correlate.signal_counts(i.view("v_signals")).select("host_id", "redacted", (c("unlinked") + c("kept")).alias("others")))
query("cor-02", f"SELECT host_id, type, value, array_to_string(tokens, ',') AS tokens FROM ({TOKENS_SQL})")(lambda i: i.view("v_signals").select("host_id", "type", "value", F.array_join(F.transform(correlate.tokens(c("type"), c("value")), lambda t: F.concat_ws(":", t["kind"], t["token"])), ",").alias("tokens")))
query("cor-03", f"SELECT token, {_distinct_sql('token')} AS is_distinctive, count(*) AS n FROM (SELECT unnest(list_filter(string_split_regex(lower(trim(value)), '[-_. +@/]'), lambda p: p <> '')) AS token FROM v_signals) GROUP BY ALL")(
    lambda i: i.view("v_signals").select(F.explode(F.filter(F.split(F.lower(F.trim("value")), r"[-_. +@/]"), lambda p: p != "")).alias("token")).groupBy("token", correlate.distinctive(c("token")).alias("is_distinctive")).agg(F.count("*").alias("n"))
)
query("cor-04", f"SELECT host_id, count(*) FILTER (WHERE redacted) AS redacted, count(*) FILTER (WHERE NOT redacted AND len({_BRIDGE}) = 0) AS unlinked, count(*) FILTER (WHERE NOT redacted AND len({_BRIDGE}) > 0) AS kept FROM ({TOKENS_SQL}) GROUP BY host_id")(lambda i: correlate.signal_counts(i.view("v_signals")))
query("cor-05", f"SELECT DISTINCT host_id, tokens[1] AS src, unnest(tokens) AS dst FROM ({KEPT_SQL})")(
    lambda i: correlate.edges(correlate.kept_signals(i.view("v_signals"))).select(F.substring_index("src", "\x00", 1).cast("long").alias("host_id"), F.substring_index("src", "\x00", -1).alias("src"), F.substring_index("dst", "\x00", -1).alias("dst"))
)
query("cor-06", f"{_COMPONENTS} SELECT CAST(split_part(node, chr(1), 1) AS BIGINT) AS host_id, split_part(node, chr(1), 2) AS node, split_part(component, chr(1), 2) AS component FROM comp")(
    lambda i: components(correlate.edges(cut(correlate.kept_signals(i.view("v_signals"))))).select(F.substring_index("node", "\x00", 1).cast("long").alias("host_id"), F.substring_index("node", "\x00", -1).alias("node"), F.substring_index("component", "\x00", -1).alias("component"))
)
query("cor-07", f"{_IDENTITIES} SELECT host_id, split_part(component, chr(1), 2) AS component, canonical FROM ident")(lambda i: _identities(i, max_groups=1 << 30).select("host_id", F.substring_index("component", "\x00", -1).alias("component"), "canonical"))
query("cor-08", f"{_IDENTITIES} SELECT host_id, id, signal_count, types, len(sources) AS n_sources, n_domains, strength FROM ident")(lambda i: _identities(i, max_groups=1 << 30).select("host_id", "id", "signal_count", "types", F.size("sources").alias("n_sources"), "n_domains", "strength"))
query("cor-09", f"{_IDENTITIES} SELECT host_id, id, canonical, array_to_string(sources, ',') AS sources FROM ident")(lambda i: _identities(i, max_groups=1 << 30).select("host_id", "id", "canonical", F.array_join("sources", ",").alias("sources")))
query("cor-10", f"{_IDENTITIES} SELECT host_id, id, signal_count, array_to_string(members, ';') AS members, array_to_string(domains, ',') AS domains, summary FROM ident")(
    lambda i: _identities(i, max_groups=1 << 30, members=None).select("host_id", "id", "signal_count", F.array_join(F.transform("signals", lambda s: F.concat_ws("=", s["type"], s["value"])), ";").alias("members"), F.array_join("domains", ",").alias("domains"), "summary")
)
query("cor-10-members", f"{_COMPONENTS} SELECT host_id, split_part(component, chr(1), 2) AS component, row_number() OVER (PARTITION BY host_id, component ORDER BY type, value, source, domain) AS place, type, value, source, domain FROM member")(
    lambda i: correlate.identity_members(i.view("v_signals")).select(c("scope").cast("long").alias("host_id"), F.substring_index("component", "\x00", -1).alias("component"), "place", "type", "value", "source", "domain")
)
query("cor-11", f"{_IDENTITIES} SELECT host_id, id, canonical, strength, CAST(row_number() OVER (PARTITION BY host_id ORDER BY strength DESC, canonical, id) AS INTEGER) AS rank FROM ident WHERE strength >= 20 QUALIFY rank <= 3")(lambda i: _identities(i, min_strength=20, max_groups=3).select("host_id", "id", "canonical", "strength", "rank"))
_FLEET = _COMPONENTS.replace("CAST(host_id AS VARCHAR)", "''")
query("cor-06-fleet", f"{_FLEET} SELECT split_part(node, chr(1), 2) AS node, split_part(component, chr(1), 2) AS component FROM comp")(
    lambda i: components(correlate.edges(cut(correlate.kept_signals(i.view("v_signals"), scope=None)))).select(F.substring_index("node", "\x00", -1).alias("node"), F.substring_index("component", "\x00", -1).alias("component"))
)


# AGG: aggregates over the findings

_BAND = "CASE WHEN max_risk >= 90 THEN 'critical' WHEN max_risk >= 75 THEN 'high' WHEN max_risk >= 55 THEN 'elevated' WHEN max_risk >= 35 THEN 'moderate' WHEN max_risk >= 15 THEN 'low' ELSE 'minimal' END"
_SEV = "CASE severity WHEN 'critical' THEN 5 WHEN 'high' THEN 4 WHEN 'medium' THEN 3 WHEN 'low' THEN 2 ELSE 1 END"


def summary_sql(source: str) -> str:
    return f"SELECT host_id, total, max_risk, mean_risk, 0 AS correlated, {_BAND} AS risk_band FROM (SELECT host_id, count(*) AS total, max(risk_int) AS max_risk, CAST(floor(sum(risk_int) / count(*)) AS INTEGER) AS mean_risk FROM ({source}) GROUP BY host_id)"


@query("agg-01", _IDENTITIES + f", n AS (SELECT host_id, count(*) AS identity_count FROM ident GROUP BY host_id) SELECT s.*, coalesce(identity_count, 0) AS identity_count FROM ({summary_sql(FINDINGS_SQL)}) s LEFT JOIN n USING (host_id)")
def agg_01(i: Inputs) -> DataFrame:
    return report.summary(findings(i), correlate.identities(i.view("v_signals"), max_groups=1 << 30))


query("agg-02", " UNION ALL ".join(f"SELECT host_id, '{d}' AS dimension, {d} AS value, count(*) AS n FROM ({FINDINGS_SQL}) GROUP BY ALL" for d in ("severity", "category", "state")))(lambda i: report.counts(findings(i)))
query("agg-03", f"SELECT host_id, severity, count(*) AS n, 6 - {_SEV} AS place FROM ({FINDINGS_SQL}) GROUP BY ALL")(lambda i: report.severity_counts(findings(i)))
query("agg-04", f"SELECT floor, severity, count(*) AS n FROM ({FINDINGS_SQL}) JOIN (VALUES ('', 0), ('low', 0), ('medium', 3), ('high', 4)) AS f(floor, least) ON {_SEV} >= least GROUP BY ALL")(
    lambda i: report.at_each_floor(findings(i), ["", "low", "medium", "high"]).groupBy("floor", "severity").agg(F.count("*").alias("n"))
)
query("agg-05", f"SELECT host_id, bool_or({_SEV} >= 4) AS failed FROM ({FINDINGS_SQL}) GROUP BY host_id")(lambda i: report.fail_on(findings(i), "high", "low"))
_PLACED = ("host_id", "rule_id", "module_id", "category", "title", "objects", "risk_int", "fingerprint")  # of which places are made
query("agg-06", f"SELECT host_id, rule_id, objects, CAST(row_number() OVER (PARTITION BY host_id ORDER BY risk_int DESC, rule_id, module_id, title, objects, {FINGERPRINT_SQL}) AS INTEGER) AS place FROM ({FINDINGS_SQL})")(lambda i: report.finding_order(findings(i).select(*_PLACED)).select("host_id", "rule_id", F.array_join("objects", ",").alias("objects"), "place"))
query("agg-07", f"SELECT host_id, rule_id, objects, CAST(row_number() OVER (PARTITION BY host_id ORDER BY category, rule_id, title, objects, {FINGERPRINT_SQL}) AS INTEGER) AS place FROM ({FINDINGS_SQL})")(lambda i: report.match_order(findings(i).select(*_PLACED)).select("host_id", "rule_id", F.array_join("objects", ",").alias("objects"), "place"))
query("agg-08", "SELECT host_id, 'software' AS entity, name AS key, CAST(row_number() OVER (PARTITION BY host_id ORDER BY name, version) AS INTEGER) AS place FROM v_software UNION ALL SELECT host_id, 'sockets', CAST(port AS VARCHAR), CAST(row_number() OVER (PARTITION BY host_id ORDER BY port, addr, process) AS INTEGER) FROM v_sockets UNION ALL SELECT host_id, 'accounts', uid, CAST(row_number() OVER (PARTITION BY host_id ORDER BY name, uid) AS INTEGER) FROM v_accounts")(
    lambda i: report.entity_order(i.view("v_software"), "software").select("host_id", F.lit("software").alias("entity"), c("name").alias("key"), "place")
    .union(report.entity_order(i.view("v_sockets"), "sockets").select("host_id", F.lit("sockets"), c("port").cast("string"), "place"))
    .union(report.entity_order(i.view("v_accounts"), "accounts").select("host_id", F.lit("accounts"), "uid", "place"))
)
_STATUS = "SELECT *, CASE WHEN module_no % 2 = 0 THEN ['alpha', 'beta'] ELSE [] END AS unavailable FROM v_module_status"


def _status(i: Inputs) -> DataFrame:
    return i.view("v_module_status").withColumn("unavailable", F.when(c("module_no") % 2 == 0, F.array(F.lit("alpha"), F.lit("beta"))).otherwise(F.array().cast("array<string>")))


_DETAIL = "concat_ws('; ', nullif(reason, ''), CASE WHEN len(unavailable) > 0 THEN 'unavailable: ' || array_to_string(unavailable, ', ') END)"
AGG_09_SQL = f"SELECT host_id, CASE status WHEN 'skipped' THEN name || ': not assessed' || CASE WHEN reason <> '' THEN ' (' || reason || ')' ELSE '' END WHEN 'requires_privilege' THEN name || ': requires privileges this run did not have' ELSE name || ': incomplete — ' || CASE WHEN {_DETAIL} = '' THEN 'some sources could not be read' ELSE {_DETAIL} END END AS limitation FROM ({_STATUS}) WHERE status <> 'complete'"
query("agg-09", AGG_09_SQL)(lambda i: report.limitations(_status(i)))
AGG_10_SQL = f"SELECT host_id, CAST(len(ids) AS VARCHAR) || ' rule(s) not evaluated (' || reason || '): ' || array_to_string(ids[1:6], ', ') || CASE WHEN len(ids) > 6 THEN ' and ' || CAST(len(ids) - 6 AS VARCHAR) || ' more' ELSE '' END AS limitation FROM (SELECT host_id, reason, list_sort(list(rule_id)) AS ids FROM ({APPLIES_SQL}) WHERE reason <> '' GROUP BY ALL)"


def _skipped(i: Inputs) -> DataFrame:
    return engine.applicability(i.evidence("hosts")["hosts"], rules.metadata(i.spark)).where("reason <> ''")


query("agg-10", AGG_10_SQL)(lambda i: report.rule_limitations(_skipped(i)))


def limits(i: Inputs) -> DataFrame:
    return report.ordered_limitations(_status(i), _skipped(i))


query("agg-11", "SELECT o.host_id, o.module_id, o.status, coalesce(n, 0) AS assets FROM (SELECT host_id, module_id, CASE WHEN host_id % 3 = 0 THEN 'degraded' WHEN host_id % 2 = 0 THEN 'partial' ELSE 'complete' END AS status FROM v_hosts CROSS JOIN (VALUES ('tooling'), ('software'), ('network')) AS m(module_id)) o LEFT JOIN (SELECT host_id, domain AS module_id, count(*) AS n FROM v_assets GROUP BY ALL) USING (host_id, module_id)")(
    lambda i: report.module_status(i.view("v_hosts").select("host_id", F.explode(F.array(*map(F.lit, ("tooling", "software", "network")))).alias("module_id"), (c("host_id") % 3 == 0).alias("failed"), (c("host_id") % 2 == 0).alias("degraded")), i.view("v_assets")).select("host_id", "module_id", "status", "assets")
)
_SUPPORT = "CASE status WHEN 'complete' THEN 'full' WHEN 'partial' THEN 'partial' WHEN 'degraded' THEN 'limited' WHEN 'requires_privilege' THEN 'requires_privilege' ELSE 'unavailable' END"
query("agg-12", f"SELECT host_id, arg_min(support, CASE support WHEN 'full' THEN 5 WHEN 'partial' THEN 4 WHEN 'limited' THEN 3 WHEN 'requires_privilege' THEN 2 ELSE 1 END) AS support FROM (SELECT host_id, {_SUPPORT} AS support FROM v_module_status) GROUP BY host_id")(lambda i: report.weakest_support(report.capability(i.view("v_module_status"))))
query("agg-13", "SELECT host_id, module_no, CASE WHEN module_no % 2 = 0 AND host_id % 3 > 0 THEN 'partial' WHEN module_no % 2 = 0 THEN 'unavailable' WHEN host_id % 3 > 0 THEN 'full' ELSE 'limited' END AS support FROM v_module_status")(lambda i: _status(i).select("host_id", "module_no", report.support_from(c("host_id") % 3, F.size("unavailable")).alias("support")))
query("agg-14", f"SELECT host_id, module_no, {_SUPPORT} AS support, status IN ('complete', 'partial', 'degraded') AS works FROM v_module_status")(lambda i: report.capability(i.view("v_module_status")).select("host_id", "module_no", "support", "works"))
query("agg-15", f"SELECT host_id, type, location, line, rn, n, greatest(n - 5, 0) AS overflow FROM (SELECT host_id, type, location, line, CAST(row_number() OVER (PARTITION BY host_id, type ORDER BY location, line, {O._FP}) AS INTEGER) AS rn, count(*) OVER (PARTITION BY host_id, type) AS n FROM v_secrets) WHERE rn <= 5")(lambda i: report.secrets_by_type(i.evidence("secrets")["secrets"]).select("host_id", "type", "location", "line", "rn", "n", "overflow"))
query("agg-16", f"SELECT host_id, array_to_string(string_split(objects, ',')[1:5], ',') AS shown, greatest(len(string_split(objects, ',')) - 5, 0) AS overflow FROM ({O.rule_sql()['SW-002']})")(lambda i: report.with_objects(rules.matches(i.evidence("software"), ["SW-002"]).withColumn("objects", F.array_sort("objects"))).select("host_id", F.array_join("shown", ",").alias("shown"), "overflow"))
query("agg-17", "SELECT host_id, status, string_agg(name, ', ' ORDER BY name) AS modules, CASE status WHEN 'complete' THEN 1 WHEN 'partial' THEN 2 WHEN 'degraded' THEN 3 WHEN 'requires_privilege' THEN 4 ELSE 5 END AS place FROM v_module_status GROUP BY host_id, status")(lambda i: report.modules_by_status(i.view("v_module_status")))
_Z = "chr(0)"
#: Schema, framework and its version, which head a whole digest.
FRAMEWORK = ("report/v1", "posturelake", "1")
_LINE = " || ".join(f"{x} || {_Z}" for x in ("rule_id", "module_id", "title", "severity", "state", "exposure", "privilege", "sensitivity", "confidence", FINGERPRINT_SQL, "objects"))
_LINE_ALL = _LINE.replace(f"|| objects ||", f"|| array_to_string(list_sort(string_split(objects, ',')), {_Z}) ||")
_WHOLE = f"""{_IDENTITIES}, lim AS (SELECT 1 AS part, * FROM ({AGG_09_SQL}) UNION ALL SELECT 2, * FROM ({AGG_10_SQL})),
 whole AS (SELECT host_id, 0 AS k, '' AS o, CAST(depth AS VARCHAR) || {_Z} AS t FROM v_hosts
 UNION ALL SELECT host_id, 1, lpad(CAST(row_number() OVER (PARTITION BY host_id ORDER BY risk_int DESC, rule_id, module_id, title, objects, {FINGERPRINT_SQL}) AS VARCHAR), 12, '0'), {_LINE_ALL} FROM ({FINDINGS_SQL})
 UNION ALL SELECT host_id, 2, location || {_Z} || {O._FP}, location || {_Z} || {O._FP} || {_Z} FROM v_secrets
 UNION ALL SELECT host_id, 3, lpad(CAST(100 - strength AS VARCHAR), 12, '0') || id, id || {_Z} || canonical || {_Z} FROM ident
 UNION ALL SELECT host_id, 4, name, name || {_Z} || status || {_Z} FROM v_module_status
 UNION ALL SELECT host_id, 5, lpad(CAST(row_number() OVER (PARTITION BY host_id ORDER BY part, limitation) AS VARCHAR), 12, '0'), limitation || {_Z} FROM lim),
 numbered AS (SELECT host_id, t, row_number() OVER (PARTITION BY host_id ORDER BY k, o, t) - 1 AS nr FROM whole),
 {{}}"""
_HEAD = "'" + f"' || {_Z} || '".join(FRAMEWORK) + f"' || {_Z}"


def _level(n: int, below: str) -> str:
    return f"level{n} AS (SELECT host_id, nr // {report.NODE} AS nr, sha256(string_agg(t, '' ORDER BY nr)) AS t, sha256({_HEAD} || string_agg(t, '' ORDER BY nr)) AS root, {n} AS level FROM {below} GROUP BY host_id, nr // {report.NODE})"


#: Three levels are enough for a thousand million lines of a host.
_TREE = _WHOLE.replace("{}", ", ".join([_level(0, "numbered"), _level(1, "level0"), _level(2, "level1")]) + """,
 tree AS (SELECT *, count(*) OVER (PARTITION BY host_id, level) AS n FROM (FROM level0 UNION ALL FROM level1 UNION ALL FROM level2)),
 tops AS (SELECT host_id, min(level) AS top FROM tree WHERE n = 1 GROUP BY host_id)""")


def _parts(i: Inputs) -> tuple[DataFrame, ...]:
    """All five parts of every host's report, over the findings of all rules."""
    f = findings(i)
    return f, i.evidence("secrets")["secrets"], _identities(i, max_groups=1 << 30), i.view("v_module_status").withColumn("module_id", c("name")), limits(i)


@query("agg-18", f"{_TREE} SELECT host_id, 'sha256:' || root AS integrity, 'rep-' || substr(root, 1, 24) AS report_id FROM tree JOIN tops USING (host_id) WHERE level = top")
def agg_18(i: Inputs) -> DataFrame:
    return report.integrity(*_parts(i), FRAMEWORK, i.view("v_hosts"))


@query("agg-18-tree", f"{_TREE} SELECT host_id, CAST(level AS INTEGER) AS level, nr AS node, t AS part FROM tree JOIN tops USING (host_id) WHERE level <= top")
def agg_18_tree(i: Inputs) -> DataFrame:
    """The nodes of every host's hash tree."""
    return report.hash_tree(report.report_lines(*_parts(i), i.view("v_hosts"))).drop("root").withColumnRenamed("at", "node")


#: Three snapshots of every host. A finding is missing from one of them by the first digit of its fingerprint.
SNAPSHOT_TIMES = (1700000000, 1700086400, 1700172800)
_MISSING = "(instr('0123456789abcdef', substr(fingerprint, 1, 1)) - 1) % 5"
_SEEN = f"SELECT DISTINCT host_id, rule_id, fingerprint, {_MISSING} AS missing, nr FROM (SELECT host_id, rule_id, {FINGERPRINT_SQL} AS fingerprint FROM ({FINDINGS_SQL})), (VALUES (0), (1), (2)) AS n(nr)"
CHANGES_SQL = f"""SELECT host_id, rule_id, nr, change, count(*) AS n, min(fingerprint) AS least FROM (
 SELECT *, CASE WHEN missing = nr THEN 'resolved' WHEN nr = 0 OR missing = nr - 1 THEN 'new' ELSE 'unchanged' END AS change FROM ({_SEEN}) WHERE NOT (nr = 0 AND missing = 0)) GROUP BY ALL"""


def snapshots_of(i: Inputs, keep: Callable[[DataFrame], DataFrame] = stored) -> tuple[DataFrame, DataFrame]:
    """(host_id, collected_at) of three snapshots of every host, and their findings, whose fingerprints are bytes; ``keep`` is for findings that are read more than once."""
    shots = i.view("v_hosts").select("host_id", F.explode(F.array(*map(F.lit, SNAPSHOT_TIMES))).alias("at")).select("host_id", F.timestamp_seconds("at").alias("collected_at"))
    found = keep(findings(i).select("host_id", "rule_id", "fingerprint", F.expr(_MISSING).alias("missing")).withColumn("fingerprint", F.unhex("fingerprint")))
    times = F.explode(F.array(*[F.struct(F.lit(n).alias("nr"), F.timestamp_seconds(F.lit(t)).alias("collected_at")) for n, t in enumerate(SNAPSHOT_TIMES)])).alias("s")
    return shots, found.select("*", times).where("s.nr <> missing").select("host_id", "rule_id", "fingerprint", "s.collected_at")


_hex = lambda x: F.lower(F.hex(x))


def count_changes(changes: DataFrame) -> DataFrame:
    nr = F.array_position(F.array(*map(F.lit, SNAPSHOT_TIMES)), F.unix_timestamp("collected_at").cast("int")) - 1
    return changes.groupBy("host_id", "rule_id", nr.cast("int").alias("nr"), "change").agg(F.count("*").alias("n"), _hex(F.min("fingerprint")).alias("least"))


query("agg-19", CHANGES_SQL)(lambda i: count_changes(report.history(*snapshots_of(i, keep=lambda found: found))))
query("agg-19-pair", f"SELECT host_id, fingerprint, CASE WHEN missing = 0 THEN 'new' WHEN missing = 1 THEN 'resolved' ELSE 'unchanged' END AS change FROM ({_SEEN}) WHERE nr = 0")(
    lambda i: (lambda f: report.diff(*[f.where(F.unix_timestamp("collected_at") == t) for t in SNAPSHOT_TIMES[:2]]))(snapshots_of(i)[1]).withColumn("fingerprint", _hex("fingerprint"))
)


@query("agg-19-stream", f"{CHANGES_SQL} UNION ALL SELECT host_id, NULL, 1, 'late', {report.PARTS}, NULL FROM v_hosts WHERE host_id % 10 = 0")
def agg_19_stream(i: Inputs) -> DataFrame:
    """The same as the snapshots arrive, day after day, and the second one of every tenth host once more at last."""
    shots, found = snapshots_of(i)
    source, out, state, kept = (i.folder(x) for x in ("shots", "changes", "stream", "kept"))
    for n, hosts in ((0, "true"), (1, "true"), (2, "true"), (1, "host_id % 10 = 0")):
        day = report.snapshot_items(*[x.where(F.unix_timestamp("collected_at") == SNAPSHOT_TIMES[n]).where(hosts) for x in (shots, found)])
        day.write.mode("append").options(compression="zstd", **DIGESTS_PLAIN).parquet(source)
        arriving = i.spark.readStream.schema(day.schema).parquet(source)
        arriving.writeStream.foreachBatch(lambda batch, number: live.keep_last(batch, number, out, kept)).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return count_changes(i.spark.read.parquet(out))


query("agg-20", f"SELECT rule_id, count(*) AS n FROM ({FINDINGS_SQL}) WHERE rule_id NOT IN ('NET-003', 'ACC-003') GROUP BY ALL")(lambda i: report.suppress(findings(i), i.spark.createDataFrame([("NET-003",), ("ACC-003",)], "rule_id string")).groupBy("rule_id").agg(F.count("*").alias("n")))
ROLLUP_SQL = "SELECT execution_id, " + ", ".join(f"count(*) FILTER (WHERE event = '{e}') AS {n}" for e, n in (("module.started", "started"), ("module.completed", "completed"), ("module.failed", "failed"), ("module.skipped", "skipped"), ("asset.discovered", "assets"))) + ", count(*) FILTER (WHERE level = 'error') AS errors, max(ts) AS last_ts FROM v_envelope GROUP BY execution_id"
query("agg-21", ROLLUP_SQL)(lambda i: report.event_rollup(i.view("v_envelope")))
query("agg-22", "SELECT host_id, hostname, platform, user_name, cloud, container FROM v_hosts")(lambda i: report.host_summary(i.view("v_hosts")))
query("flagship", summary_sql(f"SELECT * FROM ({FINDINGS_SQL}) WHERE rule_id IN ('NET-001', 'NET-002', 'NET-004')").replace("SELECT host_id, total", "SELECT host_id, 0 AS identity_count, total", 1))(flagship)

_TOLD = f"SELECT * FROM ({FINDINGS_SQL}) WHERE {_SEV} >= 3 AND rule_id NOT IN ('NET-003', 'ACC-003')"


@query("assess", f"SELECT s.*, failed, CAST(0 AS BIGINT) AS identity_count FROM ({summary_sql(_TOLD)}) s JOIN (SELECT host_id, bool_or({_SEV} >= 4) AS failed FROM ({_TOLD}) GROUP BY host_id) USING (host_id)")
def assess_hosts(i: Inputs) -> DataFrame:
    """The summaries of a whole run over all evidence, but for two rules and without findings below medium."""
    return assess(i.evidence(*rules.TABLES), exclude=["NET-003", "ACC-003"], min_severity="medium", threshold="high").summary
