"""The rule catalogue: 52 DataFrame transformations from evidence tables to matches.

A rule that filters one table is a condition on a row; all of a table's rules run in one pass over it, to which what a rule asks of the host is joined. Rules
that aggregate build their matches from the tables, those over one table in one grouped pass. All matches have the schema MATCH.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce
from weakref import WeakKeyDictionary

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import paths as P
from ..functions import secrets as S
from ..plans.lineage import stored_by

MATCH = "host_id bigint, rule_id string, title string, impact string, objects array<string>, attributes map<string,string>"
Tables = dict[str, DataFrame]

# Services by port.
ADMIN_PORTS = {22: "Secure Shell", 23: "Telnet", 445: "SMB", 1433: "Microsoft SQL Server", 3306: "MySQL", 5432: "PostgreSQL", 5900: "VNC", 6379: "Redis", 9200: "Elasticsearch", 27017: "MongoDB", 11211: "Memcached"}
CLEAR_PORTS = {21: "FTP", 23: "Telnet", 25: "SMTP", 110: "POP3", 143: "IMAP", 389: "LDAP", 2049: "NFS", 548: "AFP", 3389: "RDP"}
CREDENTIAL_TYPES = "password api_key token cloud_credential database_credential jwt oauth_token session_token".split()
WATCHERS = "wireshark tshark tcpdump suricata snort falco osquery".split()
OBFUSCATION = ["base64 -d", "base64 --decode", "| sh", "| bash", "eval ", "exec ", "curl ", "wget "]
DISK_ENCRYPTION = "bitlocker luks disk_encryption filevault".split()
TEMP_FLOOR = 50 << 20


@dataclass(frozen=True)
class Rule:
    """Metadata of a rule, and how it matches: ``when`` a row of ``table`` fits, or what ``build`` makes of the tables. ``beside`` names what is joined from HOST_FACTS."""

    id: str
    module: str
    category: str
    severity: str
    exposure: str
    privilege: str
    sensitivity: str
    confidence: str
    title: str
    table: str = ""
    when: Callable[[], Column] | None = None
    objects: Callable[[], list[Column]] | None = None
    attributes: Callable[[], dict[str, Column]] = dict
    titled: Callable[[], Column] | None = None
    impact: Callable[[], Column] | None = None
    build: Callable[[Tables, set[str]], DataFrame] | None = None
    beside: str = ""
    platforms: tuple[str, ...] = ()
    min_depth: int = 1


c = F.col


def _map(values: dict[str, Column]) -> Column:
    if not values:
        return F.create_map().cast("map<string,string>")
    return F.create_map(*[x for k, v in sorted(values.items()) for x in (F.lit(k), F.coalesce(v.cast("string"), F.lit("")))])


def _attr(*keys: str) -> dict[str, Column]:
    return {k: at(k) for k in keys}


#: Attributes of assets that rules read.
ASSET_KEYS = """bytes category command disclosure encrypted enforcing entry_type exec_start files group_readable identity_metadata mechanism meta_author
meta_company meta_last_modified_by metadata_keys mode mode_text owner package_owned state world_readable world_writable""".split()


def at(key: str) -> Column:
    """An asset's attribute, empty if it has none; of a table made ``plain``."""
    return c(f"at_{key}")


def plain(assets: DataFrame) -> DataFrame:
    """``assets`` with a column for each of ASSET_KEYS; of the map ``attributes``, where they are not columns already."""
    if "attributes" in assets.columns:
        made = {k: F.coalesce(F.try_element_at("attributes", F.lit(k)), F.lit("")) for k in ASSET_KEYS}
        made["mode"] = P.apart(made["mode"])
        assets = assets.drop(*[f"at_{k}" for k in ASSET_KEYS])
    else:
        made = {k: F.lit("") for k in ASSET_KEYS if f"at_{k}" not in assets.columns}
    return assets.select(*[x for x in assets.columns if x != "attributes"], *[v.alias(f"at_{k}") for k, v in made.items()])


def _true(*keys: str) -> Column:
    return reduce(lambda a, b: a | b, [at(k) == "true" for k in keys])


def _port(ports: dict[int, str]) -> Column:
    out = F.lit(None).cast("string")
    for port, name in ports.items():
        out = F.when(c("port") == port, name).otherwise(out)
    return out


def _text(*parts: str | Column) -> Column:
    """Parts as one text; what is null reads ``null``, as in ``format_string``, which is slow."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("null")) for p in parts])


_readable = lambda: _true("group_readable", "world_readable")
_world = lambda: c("scope").isin("wildcard", "public")
_endpoint = lambda: [F.concat_ws(":", "addr", c("port").cast("string"))]
_process = lambda: F.when(c("process") == "", "unknown").otherwise(c("process"))
_col = lambda name: lambda: [c(name)]
_in = lambda domain: c("domain") == domain
_target = lambda: F.when(at("exec_start") != "", at("exec_start")).otherwise(at("command"))
_last_word = lambda: F.element_at(F.split(F.rtrim(at("command")), "[ \\t]+"), -1)


def _made(rule: str, fits: Column, objects: Column, attributes: dict[str, Column], title: Column | None = None, impact: Column | None = None) -> Column:
    """A match of ``rule``, null if a row does not fit."""
    text = lambda x: F.lit(None).cast("string") if x is None else x
    return F.when(fits, F.struct(F.lit(rule).alias("rule_id"), text(title).alias("title"), text(impact).alias("impact"), objects.alias("objects"), _map(attributes).alias("attributes")))


def _spread(rows: DataFrame, made: Iterable[Column], *keep: str) -> DataFrame:
    """A row for each of the structs ``made`` of a row that isn't null.

    They are listed in a projection of their own, since what stands within an explode is interpreted. Its higher-order function, which adds nothing, has Spark
    compile that projection apart, in many small methods: as one method of a whole stage, the rules of a large table are more than the JVM compiles.
    """
    made = list(made)
    nothing = F.filter(F.array(F.lit(None)), lambda m: m.isNotNull())
    listed = rows.select("host_id", *keep, F.concat(F.array(*made), nothing).alias("made"))
    # outer, since the plain form also filters by the size of the array and so makes every match twice
    return listed.select("host_id", *keep, F.explode_outer("made").alias("m")).where("m IS NOT NULL").select("host_id", *keep, "m.*")


def vpn_hosts(t: Tables) -> DataFrame:
    vpn = t["interfaces"].where((c("scope") == "vpn") | (c("kind") == "vpn"))
    return vpn.select("host_id", F.lit(True).alias("host_vpn")).distinct()


def histories(t: Tables) -> DataFrame:
    return t["hosts"].select("host_id", c("history_files").alias("host_history_files"))


#: What rules ask of a row's host: the table that it comes from, and a row for each host that it is known of.
HOST_FACTS = {"vpn": ("interfaces", vpn_hosts), "histories": ("hosts", histories)}


def sshd_rules(t: Tables, only: set[str]) -> DataFrame:
    """RMT-001: any uncommented directive decides, not the first. RMT-002: the first directive that is not "no"."""
    words = F.filter(F.split("line", r"\s+"), lambda w: w != "")
    lines = t["sshd_lines"].where(~F.ltrim("line").startswith("#")).withColumn("words", words).where(F.size("words") >= 2)
    key, value = F.lower(c("words")[0]), F.lower(c("words")[1])
    found = lines.where(key.isin("passwordauthentication", "permitrootlogin")).groupBy("host_id", "path").agg(
        F.bool_or((key == "passwordauthentication") & (value == "yes")).alias("password"), F.min_by("words", F.when((key == "permitrootlogin") & (value != "no"), c("pos"))).alias("root")
    )
    made = {"RMT-001": _made("RMT-001", c("password"), F.array("path"), {}), "RMT-002": _made("RMT-002", c("root").isNotNull(), F.array("path"), {"directive": F.array_join("root", " ")})}
    return _spread(found, [made[r] for r in sorted(only)])


def idn_003(t: Tables, only: set[str]) -> DataFrame:
    """The last name and email of a host's git configuration."""
    key, value = F.lower(F.trim(F.substring_index("line", "=", 1))), F.trim(F.substring(c("line"), F.instr("line", "=") + 1, F.char_length("line")))
    pairs = t["git_lines"].where(c("line").contains("=")).withColumns({"key": key, "value": value}).where(c("key").isin("name", "email"))
    last = pairs.groupBy("host_id", "path").agg(*[F.coalesce(F.max_by(F.when(c("key") == k, c("value")), F.when(c("key") == k, c("pos"))), F.lit("")).alias(k) for k in ("name", "email")])
    out = _spread(last, [_made("IDN-003", (c("name") != "") | (c("email") != ""), F.array("path"), {"git_name": c("name"), "git_email": c("email")})])
    return out.withColumn("attributes", F.map_filter("attributes", lambda k, v: v != ""))


def asset_rules(t: Tables, only: set[str]) -> DataFrame:
    """SEC-003: the last mode that the host's assets give for a secret's path. PST-001, PST-002: a host's first asset of the kind. One grouped pass over the assets."""
    fact = lambda rule, fits, key, value, more=F.lit(None): F.when(fits, F.struct(F.lit(rule).alias("rule"), key.alias("key"), value.alias("value"), more.cast("string").alias("more")))
    posture, none = c("kind") == "posture", F.lit("")
    facts = {
        "SEC-003": fact("SEC-003", (c("path") != "") & (at("mode") != ""), c("path"), at("mode")),
        "PST-001": fact("PST-001", posture & (c("name") == "selinux") & (at("enforcing") == "false"), none, c("name"), at("state")),
        "PST-002": fact("PST-002", posture & c("name").isin(*DISK_ENCRYPTION), none, c("name"), at("encrypted")),
    }
    rows = _spread(plain(t["assets"]), [facts[r] for r in sorted(only)], "pos")
    place = F.when(c("rule") == "SEC-003", c("pos")).otherwise(-c("pos"))
    # the last place of each value first, by a hash aggregate; max_by sorts its input
    last = rows.groupBy("host_id", "rule", "key", "value", "more").agg(F.max(place).alias("place"))
    found = last.groupBy("host_id", "rule", "key").agg(F.max_by(F.struct("value", "more"), "place").alias("of")).select("host_id", "rule", "key", "of.*")
    made = {
        "PST-001": _made("PST-001", c("rule") == "PST-001", F.array("value"), {"state": c("more")}),
        "PST-002": _made("PST-002", (c("rule") == "PST-002") & (c("more") != "true"), F.array("value"), {}),
    }
    if "SEC-003" in only:
        held = t["secrets"].select("host_id", F.lit("SEC-003").alias("rule"), c("location").alias("key"), "type", F.lit(True).alias("held"))
        found = found.join(held, ["host_id", "rule", "key"], "left").where((c("rule") != "SEC-003") | c("held"))
        made["SEC-003"] = _made("SEC-003", (c("rule") == "SEC-003") & ~P.mode_is_restricted(c("value")), F.array("key"), {"mode": c("value"), "type": c("type")})
    return _spread(found, [made[r] for r in sorted(only)])


def software_rules(t: Tables, only: set[str]) -> DataFrame:
    """SW-001: packages without an origin, where no enabled source serves their provider; a provider without an ecosystem never counts.
    SW-002: namespaces with their count and first ten names, ranked per namespace before the few are gathered.

    A source counts against each provider that it serves, so that both rules are one grouped pass over software and sources.
    """
    fact = lambda rule, fits, key, name, n, served: F.when(fits, F.struct(F.lit(rule).alias("rule"), key.alias("key"), name.cast("string").alias("name"), F.lit(n).alias("n"), F.lit(served).alias("served")))
    space = N.internal_namespace(c("name"))
    facts = {
        "SW-001": fact("SW-001", c("origin").isin("", "unknown", "local") & (F.size(N.ecosystems(c("provider"))) > 0), c("provider"), F.lit(None), 1, False),
        "SW-002": fact("SW-002", space != "", space, c("name"), 1, False),
    }
    rows = _spread(t["software"], [facts[r] for r in sorted(only)])
    if "SW-001" in only:
        served = t["package_sources"].where(c("enabled") & c("provider").isNotNull()).select("host_id", F.explode(N.served_providers(c("provider"))).alias("key")).distinct()
        rows = rows.unionByName(_spread(served, [fact("SW-001", F.lit(True), c("key"), F.lit(None), 0, True)]))
    counts = rows.groupBy("host_id", "rule", "key", "name").agg(F.sum("n").alias("n"), F.bool_or("served").alias("served")).where("n > 0 AND NOT served")
    earlier = Window.partitionBy("host_id", "rule", "key").orderBy("name").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    few = F.array_repeat("name", F.least("n", 10 - c("before")).cast("int"))
    found = counts.groupBy("host_id", "rule", "key").agg(F.sum("n").alias("n"), F.flatten(F.array_sort(F.collect_list(F.when(c("before") < 10, few)))).alias("names"))
    made = {
        "SW-001": _made("SW-001", c("rule") == "SW-001", F.array("key"), {"provider": c("key"), "count": c("n")}),
        "SW-002": _made("SW-002", c("rule") == "SW-002", F.concat(F.array("key"), F.array_sort("names")), {"namespace": c("key"), "count": c("n")}),
    }
    return _spread(found, [made[r] for r in sorted(only)])


# Identifiers, modules, ratings and titles of the rules, since they enter scores and fingerprints.
RULES: tuple[Rule, ...] = (
    Rule("ACC-001", "accounts", "account", "medium", "local", "user", "internal", "confirmed", "Interactive login shell for a service account", "accounts",
         lambda: ~c("no_login") & (c("shell") != "") & N.interactive_shell(N.basename(c("shell"))) & N.service_identity(c("service"), c("classification"), c("name"), c("uid")),
         _col("name"), lambda: {"shell": c("shell"), "uid": c("uid")}, impact=lambda: F.concat(F.lit("Shell "), c("shell"), F.lit(" permits direct login as "), c("name"))),
    Rule("ACC-002", "accounts", "account", "high", "local", "elevated", "sensitive", "observed", "Privileged account with authorized SSH keys", "accounts",
         lambda: c("privileged") & (c("authorized_keys") != 0), _col("name"), lambda: {"authorized_keys": c("authorized_keys"), "uid": c("uid")}),
    Rule("ACC-003", "accounts", "account", "low", "local", "user", "internal", "possible", "Account with no last-login record", "accounts",
         lambda: ~c("service") & ~c("no_login") & c("last_login").isNull() & ~((N.basename(c("shell")) == "bash") & (c("uid") == "0")), _col("name"), lambda: {"shell": c("shell"), "home": c("home")}),
    Rule("ACC-004", "accounts", "metadata", "low", "local", "user", "internal", "observed", "Account with a human name in the GECOS field", "accounts",
         lambda: c("gecos").rlike("[ \\t]") & ~N.looks_like_role(c("gecos")), _col("name"), lambda: {"gecos": c("gecos")}),
    Rule("NET-001", "network", "network", "high", "wildcard", "none", "internal", "observed", "Service listening on a wildcard address", "sockets",
         _world, _endpoint, lambda: {"port": c("port"), "process": _process(), "pid": c("pid"), "proto": c("proto")}, titled=lambda: _text("Service ", _process(), " listening on all interfaces, port ", c("port"))),
    Rule("NET-002", "network", "remote_access", "high", "wildcard", "none", "internal", "observed", "Administrative service exposed beyond this host", "sockets",
         lambda: _world() & c("port").isin(*ADMIN_PORTS), _endpoint, lambda: {"service": _port(ADMIN_PORTS), "port": c("port"), "process": _process()}, titled=lambda: _text(_port(ADMIN_PORTS), " exposed on port ", c("port"))),
    Rule("NET-003", "network", "exposure", "informational", "loopback", "user", "public", "observed", "Service reachable only from this host", "sockets",
         lambda: c("scope") == "loopback", _endpoint, lambda: {"port": c("port"), "process": _process()}, min_depth=2),
    Rule("NET-004", "network", "authentication", "high", "wildcard", "none", "sensitive", "observed", "Service carrying credentials in the clear", "sockets",
         lambda: _world() & c("port").isin(*CLEAR_PORTS), _endpoint, lambda: {"service": _port(CLEAR_PORTS), "port": c("port")}, titled=lambda: _text(_port(CLEAR_PORTS), " exposed without transport encryption")),
    Rule("NET-005", "network", "network", "medium", "vpn", "user", "internal", "observed", "Listener on a VPN or virtual interface", "sockets",
         lambda: (c("scope") == "vpn") & c("host_vpn"), _endpoint, lambda: {"port": c("port")}, beside="vpn"),
    Rule("RMT-001", "remote-access", "remote_access", "high", "lan", "none", "internal", "observed", "Password authentication permitted for SSH", build=sshd_rules, platforms=("linux", "darwin", "termux")),
    Rule("RMT-002", "remote-access", "remote_access", "high", "lan", "none", "internal", "observed", "PermitRootLogin is not disabled", build=sshd_rules, platforms=("linux", "termux")),
    Rule("IDN-001", "host-identity", "identity", "low", "lan", "none", "internal", "observed", "Hostname discloses a name or identifier", "hosts",
         lambda: ~F.lower("hostname").rlike("^(localhost$|desktop-|laptop-)|-pc$") & N.identity_shaped(c("hostname")), _col("hostname"), lambda: {"hostname": c("hostname")}),
    Rule("IDN-002", "environment", "metadata", "informational", "local", "user", "internal", "observed", "Login name disclosed in the environment", "hosts",
         lambda: N.identity_shaped(c("user_name")), _col("user_name"), lambda: {"user": c("user_name")}),
    Rule("IDN-003", "developer-identity", "git", "medium", "public", "user", "internal", "observed", "Git author identity configured", build=idn_003),
    Rule("SEC-001", "secret-material", "secrets", "critical", "local", "user", "secret", "confirmed", "Private key material present", "secrets",
         lambda: c("type").isin("private_key", "ssh_key"), _col("location"), lambda: {"fingerprint": c("fingerprint"), "type": c("type"), "line": c("line")}),
    Rule("SEC-002", "secret-material", "credentials", "high", "local", "user", "secret", "confirmed", "Credential material present", "secrets",
         lambda: c("type").isin(*CREDENTIAL_TYPES), _col("location"), lambda: {"fingerprint": c("fingerprint"), "type": c("type")}),
    Rule("SEC-003", "secret-material", "filesystem", "high", "local", "user", "secret", "observed", "Secret material readable by other local users", build=asset_rules),
    Rule("PRV-001", "provenance", "provenance", "high", "local", "user", "internal", "observed", "Executable in a system path with no package owner", "provenance",
         lambda: c("state") == "unowned", _col("path"), lambda: {"state": c("state"), "source": c("source")}),
    Rule("PRV-002", "binary-integrity", "integrity", "critical", "local", "elevated", "sensitive", "observed", "System binary modified relative to its package", "provenance",
         lambda: (c("state") == "hash_mismatch") | c("modified"), _col("path"), lambda: {"state": c("state"), "owner": c("package_owner")}),
    Rule("PRV-003", "package-sources", "software", "medium", "local", "elevated", "internal", "observed", "Third-party package source configured", "package_sources",
         lambda: c("trust") != "official", _col("id"), lambda: {"uri": c("uri"), "trust": c("trust"), "keys": c("keys")}),
    Rule("PRV-004", "package-sources", "provenance", "high", "lan", "elevated", "sensitive", "observed", "Package source configured without a signing key", "package_sources",
         lambda: c("enabled") & (c("keys") == 0) & (c("trust") == "unknown"), _col("id"), lambda: {"uri": c("uri")}),
    Rule("FS-001", "filesystem-exposure", "filesystem", "high", "local", "user", "sensitive", "observed", "World-writable file in a sensitive directory", "assets",
         lambda: P.file_asset(c("kind"), at("entry_type")) & _true("world_writable") & P.sensitive_path(c("path")), _col("path"), lambda: _attr("mode")),
    Rule("FS-002", "filesystem-exposure", "filesystem", "high", "local", "user", "secret", "observed", "Secret-material directory readable by other accounts", "assets",
         lambda: P.dir_asset(c("kind"), at("entry_type")) & _readable() & P.credential_dir(c("path")), _col("path"), lambda: _attr("mode")),
    Rule("SHL-001", "shell-terminal", "shell", "medium", "local", "user", "sensitive", "observed", "Shell history readable beyond its owner", "assets",
         lambda: P.file_asset(c("kind"), at("entry_type")) & _readable() & F.array_contains("host_history_files", c("path")), _col("path"), lambda: _attr("mode"), beside="histories"),
    Rule("SHL-002", "shell-terminal", "shell", "high", "local", "user", "secret", "possible", "Credential-shaped content in shell history", "secrets",
         lambda: P.history_path(c("location")), lambda: [F.concat_ws(":", "location", c("line").cast("string"))], lambda: {"type": c("type")}),
    Rule("CLD-001", "cloud-identity", "cloud", "low", "local", "user", "internal", "observed", "Cloud provider configuration present", "hosts",
         lambda: c("cloud") != "", _col("cloud"), lambda: {"provider": c("cloud")}),
    Rule("CLD-002", "cloud-identity", "credentials", "high", "local", "user", "secret", "confirmed", "Cloud credential file present", "secrets",
         lambda: c("type") == "cloud_credential", _col("location"), lambda: {"fingerprint": c("fingerprint")}),
    Rule("PST-001", "os-posture", "configuration", "medium", "local", "user", "internal", "observed", "Mandatory access control not enforcing", build=asset_rules, platforms=("linux",)),
    Rule("PST-002", "os-posture", "exposure", "high", "local", "system", "sensitive", "possible", "Full disk encryption not confirmed", build=asset_rules),
    Rule("ART-001", "artifacts-logs", "logging", "medium", "local", "user", "sensitive", "observed", "Log or artifact directory readable beyond its owner", "assets",
         lambda: P.dir_asset(c("kind"), at("entry_type")) & P.artifact_dir(c("path")) & _readable(), _col("path"), lambda: _attr("mode")),
    Rule("ART-002", "os-posture", "exposure", "low", "container", "user", "internal", "observed", "Container environment exposes the host's identity", "hosts",
         lambda: c("container"), _col("container_kind"), lambda: {"kind": c("container_kind")}),
    Rule("SW-001", "software", "software", "low", "local", "user", "internal", "observed", "Installed package records a generic or absent origin", build=software_rules),
    Rule("SW-002", "software", "software", "low", "local", "user", "internal", "observed", "Installed software is associated with a development project or employer", build=software_rules),
    Rule("SW-003", "software", "software", "low", "local", "user", "internal", "probable", "Software installed outside the system package manager", "assets",
         lambda: _in("software") & (at("package_owned") == "false"), _col("path"), lambda: _attr("mode", "owner")),
    Rule("PRC-001", "process-service", "process", "high", "local", "user", "secret", "observed", "Process command line exposes credentials or tokens", "processes",
         lambda: S.args_hold_credential(c("args")), _col("name"), lambda: {"pid": c("pid"), "user": c("user"), "executable": c("exe")}),
    Rule("PRC-002", "process-service", "process", "medium", "local", "user", "internal", "observed", "Process running with an unexpected working directory", "processes",
         lambda: P.temporary_path(c("cwd")), _col("name"), lambda: {"pid": c("pid"), "user": c("user"), "cwd": c("cwd")}),
    Rule("PRC-003", "process-service", "process", "medium", "local", "user", "sensitive", "observed", "Enabled service runs as an interactive-capable account", "services",
         lambda: ((F.lower("state") == "running") | (c("enabled") == "enabled")) & N.interactive_shell(N.basename(c("user"))), _col("name"), lambda: {"user": c("user"), "kind": c("kind"), "exec_start": c("exec_start")}),
    Rule("PRC-004", "process-service", "process", "high", "local", "system", "sensitive", "observed", "Service definition references a path outside the standard locations", "services",
         lambda: P.user_writable_path(c("exec_start")), _col("name"), lambda: {"exec_start": c("exec_start"), "user": c("user"), "kind": c("kind")}),
    Rule("PER-001", "persistence", "persistence", "high", "local", "user", "sensitive", "observed", "Startup entry runs a command from a user-writable location", "assets",
         lambda: _in("persistence") & P.user_writable_path(_target()), _col("path"), lambda: {"mechanism": at("mechanism"), "target": _target()}, min_depth=3),
    Rule("PER-002", "persistence", "persistence", "medium", "local", "user", "sensitive", "probable", "Shell profile sources an external or generated file", "assets",
         lambda: _in("persistence") & at("command").rlike(r"^(\.|source)") & _last_word().startswith("/") & P.user_writable_path(_last_word()), _col("path"), lambda: _attr("command", "mechanism"), min_depth=3),
    Rule("PER-003", "persistence", "persistence", "high", "local", "user", "sensitive", "observed", "Startup entry runs a hidden or obfuscated command", "assets",
         lambda: _in("persistence") & reduce(lambda a, b: a | b, [F.lower(F.concat_ws(" ", at("command"), at("exec_start"))).contains(x) for x in OBFUSCATION]), _col("path"),
         lambda: {"mechanism": at("mechanism"), "command": F.trim(F.concat_ws(" ", at("command"), at("exec_start")))}, min_depth=3),
    Rule("TOOL-001", "tooling", "tooling", "medium", "local", "user", "internal", "observed", "Offensive security tooling is installed on this host", "assets",
         lambda: _in("tooling") & (at("category") == "offensive"), _col("name"), lambda: {"kind": at("disclosure")}),
    Rule("TOOL-002", "tooling", "tooling", "low", "local", "system", "sensitive", "observed", "Packet capture or intrusion detection tooling can observe all traffic", "assets",
         lambda: _in("tooling") & (at("category") == "defensive") & c("name").isin(*WATCHERS), _col("name"), lambda: {"kind": at("disclosure")}),
    Rule("APP-001", "browser-apps", "privacy", "low", "local", "user", "internal", "observed", "Browser profile data is present on this host", "assets",
         lambda: _in("browser-apps"), _col("name"), lambda: {"path": c("path"), "bytes": at("bytes")}),
    Rule("APP-002", "browser-apps", "privacy", "low", "local", "user", "internal", "observed", "Messenger or mail client data is present on this host", "assets",
         lambda: _in("browser-apps") & at("category").isin("mail", "messenger"), _col("name"), lambda: {"path": c("path"), "bytes": at("bytes")}),
    Rule("PERM-001", "file-permissions", "filesystem", "high", "local", "user", "secret", "observed", "Private key file is readable by another account", "assets",
         lambda: _in("file-permissions") & P.private_key_file(c("path")) & _readable(), _col("path"), lambda: _attr("mode", "owner")),
    Rule("PERM-002", "file-permissions", "filesystem", "high", "local", "user", "secret", "observed", "Credential or secret file is readable by another account", "assets",
         lambda: _in("file-permissions") & ~P.private_key_file(c("path")) & P.credential_file(c("path")) & _readable(), _col("path"), lambda: _attr("mode", "owner")),
    Rule("PERM-003", "file-permissions", "filesystem", "high", "local", "user", "sensitive", "observed", "Sensitive file is world-writable", "assets",
         lambda: _in("file-permissions") & _true("world_writable") & P.sensitive_path(c("path")), _col("path"), lambda: _attr("mode", "owner")),
    Rule("TMP-001", "temp-cache", "privacy", "low", "local", "user", "internal", "observed", "Temporary directory holds a large volume of unreviewed data", "assets",
         lambda: _in("temp-cache") & (P.rule_bytes(at("bytes")) >= TEMP_FLOOR), _col("path"), lambda: _attr("bytes", "files")),
    Rule("TMP-002", "temp-cache", "privacy", "medium", "local", "user", "sensitive", "observed", "Temporary directory is readable by other accounts", "assets",
         lambda: _in("temp-cache") & _readable(), _col("path"), lambda: _attr("mode")),
    Rule("META-001", "metadata", "privacy", "medium", "local", "user", "internal", "observed", "Document embeds author or organisation metadata", "assets",
         lambda: _in("metadata") & _true("identity_metadata"), _col("path"),
         lambda: {"keys": at("metadata_keys"), "author": at("meta_author"), "last_modified_by": at("meta_last_modified_by"), "company": at("meta_company")}, min_depth=3),
    Rule("META-002", "metadata", "privacy", "medium", "local", "user", "internal", "observed", "Document with embedded identity metadata is readable by other accounts", "assets",
         lambda: _in("metadata") & _true("identity_metadata") & P.readable_text(at("mode_text")), _col("path"), lambda: {"mode": at("mode_text"), "author": at("meta_author")}, min_depth=3),
)
BY_ID = {r.id: r for r in RULES}
TABLES = ("hosts", "accounts", "sockets", "interfaces", "processes", "services", "software", "package_sources", "provenance", "secrets", "assets", "sshd_lines", "git_lines")


#: Tables that a rule with ``build`` reads.
BUILT_FROM = {
    "RMT-001": ("sshd_lines",), "RMT-002": ("sshd_lines",), "IDN-003": ("git_lines",), "SEC-003": ("assets", "secrets"), "PST-001": ("assets",), "PST-002": ("assets",),
    "SW-001": ("software", "package_sources"), "SW-002": ("software",),
}


def needs(only: Iterable[str] | None = None) -> set[str]:
    """The tables that the rules (all by default) read."""
    chosen = [BY_ID[i] for i in only] if only is not None else RULES
    return {t for r in chosen for t in (BUILT_FROM[r.id] if r.build else (r.table, HOST_FACTS[r.beside][0]) if r.beside else (r.table,))}


def runs_on(rule: Rule, platform: Column, depth: Column, authorized: Column) -> Column:
    """Whether a rule runs on a host (ENG-01), with the rule's side as constants; what is not known of a host does not keep a rule from running."""
    known = lambda x: F.coalesce(x, F.lit(True))
    wide = known(authorized) & known(depth >= rule.min_depth)
    return wide & known(platform.isin(*rule.platforms)) if rule.platforms else wide


#: Columns of rules by the gateway that they belong to: a rule is some hundred calls to the JVM, which a plan need not make again.
_COLUMNS: WeakKeyDictionary = WeakKeyDictionary()


def _match(rule: Rule, gated: bool) -> Column:
    """What ``rule`` makes of a row, null if it does not fit; ``gated``, also if the rule does not run on the row's host (host_platform, host_depth, host_authorized)."""
    known = _COLUMNS.setdefault(SparkContext._gateway, {})
    if (rule, gated) not in known:
        text = lambda made: None if made is None else made()
        fits = runs_on(rule, c("host_platform"), c("host_depth"), c("host_authorized")) & rule.when() if gated else rule.when()
        known[rule, gated] = _made(rule.id, fits, F.array(*rule.objects()), rule.attributes(), text(rule.titled), text(rule.impact))
    return known[rule, gated]


#: Slots of a flat match: its object (filter rules have one) and the values of its attributes, by key.
SLOTS = 6


def _flat(rule: Rule) -> tuple[Column, tuple[str, ...]]:
    """As ``_match``, gated, but with plain columns ``v0`` to ``v5``; and the keys of the attributes."""
    known = _COLUMNS.setdefault(SparkContext._gateway, {})
    if (rule, "flat") not in known:
        text = lambda made: F.lit(None).cast("string") if made is None else made()
        (thing,), attributes = rule.objects(), sorted(rule.attributes().items())
        values = [thing.cast("string"), *[F.coalesce(v.cast("string"), F.lit("")) for _, v in attributes]]
        values += [F.lit(None).cast("string")] * (SLOTS - len(values))
        fits = runs_on(rule, c("host_platform"), c("host_depth"), c("host_authorized")) & rule.when()
        made = F.struct(F.lit(rule.id).alias("rule_id"), text(rule.titled).alias("title"), text(rule.impact).alias("impact"), *[v.alias(f"v{n}") for n, v in enumerate(values)])
        known[rule, "flat"] = F.when(fits, made), tuple(k for k, _ in attributes)
    return known[rule, "flat"]


def layout(spark: SparkSession, rules: Iterable[Rule]) -> DataFrame:
    """(rule_id, k1 to k5, after): the keys by which the slots of a rule's flat matches go, and the first slot whose key comes after the attributes ``risk_...``, 0 if none."""
    rows = []
    for r in rules:
        keys = _flat(r)[1]
        after = next((n for n, k in enumerate(keys, 1) if k > "risk_"), 0)
        padded = [*keys, *[None] * (SLOTS - 1 - len(keys))]
        rows.append(F.struct(F.lit(r.id).alias("rule_id"), *[F.lit(k).cast("string").alias(f"k{n}") for n, k in enumerate(padded, 1)], F.lit(after).alias("after")))
    return spark.range(1).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def one_pass(rows: DataFrame, rules: Iterable[Rule], gated: bool = False) -> DataFrame:
    """Matches of all filter rules of one table, from a single scan; ``gated``, where they run on the row's host."""
    return _spread(rows, [_match(r, gated) for r in rules])


def known_hosts(tables: Tables, names: Iterable[str], facts: Iterable[str]) -> Tables:
    """For each of the evidence tables ``names`` the hosts that it has rows of, with what rules ask of them.

    Evidence often lies on few of many hosts. They are written once, so that Spark knows how few: those are broadcast, and a table is dealt by its hosts only where they are many.
    """
    hosts = tables["hosts"].select("host_id", *[c(x).alias(f"host_{x}") for x in ("platform", "depth", "authorized")])
    for fact in facts:
        hosts = hosts.join(HOST_FACTS[fact][1](tables), "host_id", "left")
    seen = reduce(DataFrame.union, [tables[t].select(F.lit(t).alias("evidence"), "host_id").distinct() for t in names])
    return stored_by(seen.join(hosts, "host_id"), "evidence", names)


def _rows(tables: Tables, chosen: list[Rule], applicable: bool) -> list[tuple[DataFrame, list[Rule]]]:
    """Each table that filter rules read, with its rules, joined to what they ask of the host."""
    mine = {t: rules for t in TABLES if (rules := [r for r in chosen if r.table == t])}
    facts = {t: sorted({r.beside for r in rules if r.beside}) for t, rules in mine.items()}
    beside = [t for t in mine if t != "hosts"]
    hosts = known_hosts(tables, beside, sorted({f for x in facts.values() for f in x})) if applicable and beside else {}
    out = []
    for t, rules in mine.items():
        rows = plain(tables[t]) if t == "assets" else tables[t]
        if applicable:
            rows = rows.join(hosts[t], "host_id") if t in hosts else rows.withColumns({f"host_{x}": c(x) for x in ("platform", "depth", "authorized")})
        for fact in facts[t] if t not in hosts else ():
            rows = rows.join(HOST_FACTS[fact][1](tables), "host_id", "left")
        out.append((rows, rules))
    return out


def chosen_rules(tables: Tables, only: Iterable[str] | None = None) -> list[Rule]:
    """The rules (all by default) whose tables are given."""
    return [r for r in ([BY_ID[i] for i in only] if only is not None else RULES) if needs([r.id]) <= tables.keys()]


def built(tables: Tables, chosen: list[Rule], applicable: bool = False) -> DataFrame | None:
    """Matches of the rules among ``chosen`` that aggregate or join tables."""
    made = [r for r in chosen if r.build]
    if not made:
        return None
    out = reduce(DataFrame.unionByName, [build(tables, {r.id for r in made if r.build == build}) for build in dict.fromkeys(r.build for r in made)])
    if applicable:
        runs = lambda r: runs_on(r, c("host_platform"), c("host_depth"), c("host_authorized"))
        here = reduce(lambda a, b: a | b, [(c("rule_id") == r.id) & runs(r) for r in made])
        hosts = tables["hosts"].select("host_id", *[c(x).alias(f"host_{x}") for x in ("platform", "depth", "authorized")])
        out = out.join(hosts, "host_id").where(here).drop("host_platform", "host_depth", "host_authorized")
    return out


def matches(tables: Tables, only: Iterable[str] | None = None, applicable: bool = False) -> DataFrame:
    """ENG-04: matches of the rules (all by default) over the tables that are given; a rule whose table is missing is left out, and no rule gives no row.

    With ``applicable`` only where the rule runs on its host (table ``hosts``, a row per host): each evidence table is joined to its hosts once and what runs
    is a part of each rule's condition, so that no table of hosts times rules is made and what does not apply is dropped in the scan.
    """
    chosen = chosen_rules(tables, only)
    parts = [one_pass(rows, rules, applicable) for rows, rules in _rows(tables, chosen, applicable)]
    if (rest := built(tables, chosen, applicable)) is not None:
        parts.append(rest)
    if not parts:  # no table that a chosen rule reads
        return next(iter(tables.values())).where("false").selectExpr("host_id", "'' AS rule_id", "'' AS title", "'' AS impact", "array('') AS objects", "map('', '') AS attributes")
    return reduce(DataFrame.unionByName, parts)


def flat_matches(tables: Tables, chosen: list[Rule]) -> DataFrame | None:
    """Matches of the filter rules among ``chosen`` that run on their host, each once: (host_id, rule_id, title, impact, v0 to v5) by ``layout``.

    Plain columns are told apart at a fraction of what arrays and maps cost; those are made of what is left.
    """
    parts = [_spread(rows, [_flat(r)[0] for r in rules]) for rows, rules in _rows(tables, chosen, True)]
    return reduce(DataFrame.unionByName, parts).distinct() if parts else None


def metadata(spark: SparkSession) -> DataFrame:
    """The catalogue as a small table."""
    cols = "rule_id module_id category severity exposure privilege sensitivity confidence default_title".split()
    rows = [(r.id, r.module, r.category, r.severity, r.exposure, r.privilege, r.sensitivity, r.confidence, r.title, list(r.platforms), r.min_depth) for r in RULES]
    return spark.createDataFrame(rows, ", ".join(f"{x} string" for x in cols) + ", platforms array<string>, min_depth int")
