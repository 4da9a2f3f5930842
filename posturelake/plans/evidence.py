"""Canonical evidence tables, made from the fixture views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions.secrets import secret_fingerprint
from .views import view

#: (id, name, platforms, least depth) of the assessment modules; POSIX marks those that Windows has no source for.
POSIX = ["linux", "darwin", "termux"]
MODULES = (
    ("host-identity", "Host Identity", 1), ("accounts", "User and Account Audit", 1), ("remote-access", "SSH and Remote Access", 1), ("network", "Network Exposure", 1),
    ("software", "Software Inventory", 1), ("provenance", "Software Provenance", 2), ("binary-integrity", "Binary Integrity", 3), ("package-sources", "Package Source Audit", 2),
    ("filesystem-exposure", "Filesystem Exposure", 2), ("secret-material", "Secret Detection", 2), ("shell-terminal", "Shell and Terminal Exposure", 2), ("environment", "Environment Variables", 1),
    ("developer-identity", "Git and Developer Identity", 2), ("cloud-identity", "Cloud and Infrastructure Identity", 2), ("process-service", "Process and Service Audit", 2), ("persistence", "Persistence and Startup", 3),
    ("tooling", "Development and Security Tooling", 2), ("artifacts-logs", "Logging and Local Artifacts", 2), ("browser-apps", "Browser and User Application Exposure", 2), ("os-posture", "OS Security Posture", 2),
    ("file-permissions", "File Permissions", 2), ("temp-cache", "Temporary and Cache Data", 2), ("metadata", "Metadata Exposure", 3),
)


def modules(spark: SparkSession) -> DataFrame:
    rows = [(i, n, POSIX if i == "shell-terminal" else [*POSIX, "windows"], d, True) for i, n, d in MODULES]
    return spark.createDataFrame(rows, "module_id string, name string, platforms array<string>, min_depth int, implemented boolean")


def normalise_assets(raw: DataFrame) -> DataFrame:
    """Assets with what rules ask of their attributes as columns (``rules.at``), since a map of them costs more than all rules; permission flags come from the octal ``mode`` (PRS-33), ``enforcing`` and ``encrypted`` from ``value``."""
    text = lambda col: F.coalesce(col.cast("string"), F.lit(""))
    raw = raw.withColumn("bits", P.octal(F.col("mode")))  # parsed once for all flags
    flags = P.bits_flags(F.col("bits"))
    values = {**{k: text(v) for k, v in flags.items()}, "mode": P.apart(text(F.col("mode"))), "mode_text": text(P.bits_text(F.col("bits"))), "enforcing": text(F.col("value") == "Enforcing"), "encrypted": text(F.col("value").isin("On", "True", "1")), "state": text(F.col("value"))}
    values |= {k: text(F.col(k)) for k in ("entry_type", "category", "command", "bytes", "identity_metadata", "package_owned")}
    return raw.select("host_id", "pos", "kind", "domain", "name", "path", *[v.alias(f"at_{k}") for k, v in values.items()])


def evidence(spark: SparkSession, sf_dir: str, only: set[str] | None = None) -> dict[str, DataFrame]:
    """The tables that rules read, from the views; sshd and git lines are derived from the hosts."""
    v = lambda name: view(spark, sf_dir, name)
    null = F.lit("")
    make = {
        "hosts": lambda: v("v_hosts").withColumns({"depth": F.col("depth").cast("int"), "container_kind": F.when(F.col("container"), "docker").otherwise(""), "history_files": F.array(F.lit("/home/a/.bash_history"))}),
        "accounts": lambda: v("v_accounts").withColumn("last_login", F.timestamp_seconds("last_login_epoch")),
        "sockets": lambda: v("v_sockets"),
        "interfaces": lambda: v("v_interfaces").withColumn("scope", F.col("kind")),
        "processes": lambda: v("v_processes").withColumns({"user": null, "exe": null}),
        "services": lambda: v("v_services").withColumn("kind", F.lit("systemd")).withColumnRenamed("user_name", "user"),
        "software": lambda: v("v_software"),
        "package_sources": lambda: v("v_sources"),
        "provenance": lambda: v("v_provenance").withColumn("source", null),
        "secrets": lambda: v("v_secrets").withColumn("fingerprint", secret_fingerprint(F.col("location"), F.col("line"), F.col("type"))),
        "assets": lambda: normalise_assets(v("v_assets").withColumn("mode", F.lpad(F.conv("mode_bits", 10, 8), 4, "0"))),
        "sshd_lines": lambda: lines(v("v_hosts").select("host_id"), "/etc/ssh/sshd_config", SSHD_LINES),
        "git_lines": lambda: lines(v("v_hosts").select("host_id"), "/home/a/.gitconfig", GIT_LINES),
    }
    return {name: f() for name, f in make.items() if only is None or name in only}


#: Lines of a host's configuration by the remainder of its id; the number is the line's position.
SSHD_LINES = ((1, "'#PasswordAuthentication yes'"), (2, "CASE host_id % 3 WHEN 0 THEN 'PasswordAuthentication no' WHEN 1 THEN 'passwordauthentication yes' ELSE 'Port 22' END"), (3, "CASE host_id % 4 WHEN 0 THEN 'PermitRootLogin no' WHEN 1 THEN 'PermitRootLogin prohibit-password' ELSE '  PermitRootLogin yes' END"), (4, "CASE host_id % 5 WHEN 0 THEN 'PasswordAuthentication yes' ELSE 'PermitRootLogin without-password' END"))
GIT_LINES = ((1, "'[user]'"), (2, "CASE host_id % 3 WHEN 0 THEN 'name = Op One' WHEN 1 THEN 'name=' ELSE 'signingkey = X' END"), (3, "CASE host_id % 4 WHEN 0 THEN 'email = op@corp.example' ELSE 'autocrlf = input' END"), (4, "CASE host_id % 6 WHEN 0 THEN 'name = Op Two' ELSE '[core]' END"))


def lines(hosts: DataFrame, path: str, texts: tuple[tuple[int, str], ...]) -> DataFrame:
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("pos"), F.expr(sql).alias("line")) for n, sql in texts])).alias("r")
    return hosts.select("host_id", F.lit(path).alias("path"), rows).select("host_id", "path", "r.*")


def lines_sql(path: str, texts: tuple[tuple[int, str], ...]) -> str:
    """The same lines in DuckDB SQL."""
    return " UNION ALL ".join(f"SELECT host_id, '{path}' AS path, {n} AS pos, {sql} AS line FROM v_hosts" for n, sql in texts)
