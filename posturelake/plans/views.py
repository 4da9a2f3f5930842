"""Evidence views over the driver's tables, in SQL that Spark and DuckDB read alike (after FIXTURES.md, section 4).

Hosts, their interfaces, package sources and module status are derived from ``customer``, so that the fleet grows with the
tables; the other views spread their evidence over the first 25 hosts, which makes those hot.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS: dict[str, str] = {
    "v_hosts": """
SELECT CAST(c_custkey AS BIGINT) AS host_id,
  CASE c_custkey % 5 WHEN 0 THEN 'windows' WHEN 1 THEN 'darwin' WHEN 2 THEN 'termux' ELSE 'linux' END AS platform,
  1 + c_custkey % 3 AS depth, c_custkey % 11 <> 10 AS authorized,
  CASE c_custkey % 7 WHEN 0 THEN 'fatima-zahra' WHEN 1 THEN 'build-07' WHEN 2 THEN 'desktop-a1b2' WHEN 3 THEN 'sara-thinkpad' WHEN 4 THEN 'localhost' WHEN 5 THEN 'web-server' ELSE 'omar' END AS hostname,
  CASE c_custkey % 6 WHEN 0 THEN 'aisha' WHEN 1 THEN 'root' WHEN 2 THEN '' ELSE 'svc' END AS user_name,
  CASE c_custkey % 4 WHEN 0 THEN 'aws' WHEN 1 THEN 'gcp' ELSE '' END AS cloud,
  c_custkey % 6 = 0 AS container FROM customer
""",
    "v_sockets": """
SELECT l_suppkey % 25 AS host_id, 'tcp' AS proto,
  CASE l_linenumber % 6 WHEN 0 THEN '0.0.0.0' WHEN 1 THEN '127.0.0.1' WHEN 2 THEN '10.8.0.5' WHEN 3 THEN '::' WHEN 4 THEN '192.168.1.9' ELSE '100.64.0.1' END AS addr,
  CASE l_linenumber % 6 WHEN 0 THEN 'wildcard' WHEN 1 THEN 'loopback' WHEN 2 THEN 'vpn' WHEN 3 THEN 'public' ELSE 'lan' END AS scope,
  CASE l_partkey % 8 WHEN 0 THEN 22 WHEN 1 THEN 23 WHEN 2 THEN 5432 WHEN 3 THEN 3389 WHEN 4 THEN 25 WHEN 5 THEN 8080 WHEN 6 THEN 443 ELSE 6379 END AS port,
  CASE l_returnflag WHEN 'A' THEN 'sshd' WHEN 'N' THEN '' ELSE 'postgres' END AS process,
  l_orderkey AS pid FROM lineitem
""",
    "v_interfaces": """
SELECT CAST(c_custkey AS BIGINT) AS host_id, CASE c_custkey % 3 WHEN 0 THEN 'wg0' WHEN 1 THEN 'eth0' ELSE 'docker0' END AS name,
  CASE c_custkey % 3 WHEN 0 THEN 'vpn' WHEN 1 THEN 'lan' ELSE 'container' END AS kind FROM customer
""",
    "v_accounts": """
SELECT c_custkey % 25 AS host_id,
  CASE c_custkey % 6 WHEN 0 THEN 'deploy-svc' WHEN 1 THEN 'redis' ELSE 'user' || CAST(c_custkey AS STRING) || 'x' END AS name,
  CAST(c_custkey % 1500 AS STRING) AS uid,
  CASE c_nationkey % 4 WHEN 0 THEN '/bin/bash' WHEN 1 THEN '/usr/sbin/nologin' WHEN 2 THEN '/bin/zsh' ELSE '' END AS shell,
  '/home/user' || CAST(c_custkey AS STRING) AS home,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'Fatima Zahra' WHEN 'MACHINERY' THEN 'System Administrator' WHEN 'HOUSEHOLD' THEN 'root' ELSE '' END AS gecos,
  c_custkey % 50 = 0 AS privileged, c_nationkey % 4 = 1 AS no_login, c_custkey % 7 = 0 AS service,
  CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 1700000000 + c_custkey END AS last_login_epoch,
  c_custkey % 3 AS authorized_keys,
  CASE c_custkey % 9 WHEN 0 THEN 'service' WHEN 1 THEN 'dormant' ELSE 'standard' END AS classification FROM customer
""",
    "v_processes": """
SELECT user_id % 25 AS host_id, event_id AS pid, event_type AS name,
  CASE event_id % 6 WHEN 0 THEN 'app --token=abcd1234efgh' WHEN 1 THEN 'app --password changeme' WHEN 2 THEN 'psql postgres://u:s3cretpw@db/x' WHEN 3 THEN 'ssh -p 22' ELSE 'app' END AS args,
  CASE event_id % 4 WHEN 0 THEN '/tmp/build' WHEN 1 THEN '/home/a' WHEN 2 THEN '' ELSE '/srv' END AS cwd, ts AS started FROM events
""",
    "v_services": """
SELECT s_suppkey % 25 AS host_id, s_name AS name, CASE s_suppkey % 3 WHEN 0 THEN 'running' ELSE 'exited' END AS state,
  CASE s_suppkey % 4 WHEN 0 THEN 'enabled' ELSE 'disabled' END AS enabled,
  CASE s_suppkey % 5 WHEN 0 THEN '/home/a/run.sh' WHEN 1 THEN '/usr/bin/x' WHEN 2 THEN '/tmp/y' ELSE '' END AS exec_start,
  CASE s_suppkey % 6 WHEN 0 THEN 'bash' ELSE 'root' END AS user_name FROM supplier
""",
    "v_software": """
SELECT p_partkey % 25 AS host_id,
  CASE p_size % 4 WHEN 0 THEN 'corp.tool' WHEN 1 THEN 'team_tool' || CAST(p_size AS STRING) WHEN 2 THEN 'myorg-MyService' ELSE 'libpkg' || CAST(p_partkey AS STRING) END AS name,
  CASE p_size % 6 WHEN 0 THEN 'dpkg' WHEN 1 THEN 'rpm' WHEN 2 THEN 'brew-cask' WHEN 3 THEN 'pkgutil' WHEN 4 THEN 'pacman' ELSE 'pip' END AS provider,
  CASE p_partkey % 4 WHEN 0 THEN 'unknown' WHEN 1 THEN 'official' WHEN 2 THEN '' ELSE 'third_party' END AS origin, p_brand AS version FROM part
""",
    "v_sources": """
SELECT CAST(c_custkey AS BIGINT) AS host_id, 'src#' || CAST(c_custkey AS STRING) AS id,
  CASE c_custkey % 5 WHEN 0 THEN 'apt' WHEN 1 THEN 'dnf' WHEN 2 THEN 'brew' WHEN 3 THEN 'pip' ELSE 'pacman' END AS provider,
  CASE c_custkey % 4 WHEN 0 THEN 'http://archive.ubuntu.com/ubuntu' WHEN 1 THEN 'https://deb.debian.org/debian' WHEN 2 THEN 'https://mirror.uni.edu/x' ELSE 'https://ppa.example.net/y' END AS uri,
  CASE c_custkey % 4 WHEN 0 THEN 'unsigned' WHEN 1 THEN 'official' WHEN 2 THEN 'unknown' ELSE 'third_party' END AS trust,
  c_custkey % 2 AS keys, c_custkey % 3 <> 0 AS enabled FROM customer
""",
    "v_provenance": """
SELECT p_partkey % 25 AS host_id, '/usr/bin/p' || CAST(p_partkey AS STRING) AS path,
  CASE p_size % 4 WHEN 0 THEN 'unowned' WHEN 1 THEN 'package_owned' WHEN 2 THEN 'hash_mismatch' ELSE 'unverifiable' END AS state,
  p_brand AS package_owner, p_partkey % 10 = 0 AS modified FROM part
""",
    "v_assets": """
SELECT o_custkey % 25 AS host_id, o_orderkey AS pos,
  CASE o_orderkey % 9 WHEN 0 THEN 'filesystem-exposure' WHEN 1 THEN 'file-permissions' WHEN 2 THEN 'temp-cache' WHEN 3 THEN 'metadata' WHEN 4 THEN 'persistence' WHEN 5 THEN 'tooling' WHEN 6 THEN 'browser-apps' WHEN 7 THEN 'os-posture' ELSE 'software' END AS domain,
  CASE WHEN o_orderkey % 9 <= 2 THEN 'file_exposure' WHEN o_orderkey % 9 = 7 THEN 'posture' ELSE 'artifact' END AS kind,
  CASE o_orderkey % 2 WHEN 0 THEN 'file' ELSE 'directory' END AS entry_type,
  CASE o_orderkey % 7 WHEN 0 THEN '/etc/passwd' WHEN 1 THEN '/home/a/.ssh/id_rsa' WHEN 2 THEN '/home/a/.aws' WHEN 3 THEN '/home/a/.bash_history' WHEN 4 THEN '/var/logs' WHEN 5 THEN '/home/a/.env' ELSE '/home/a/.aws/credentials' END AS path,
  o_orderkey % 512 AS mode_bits,
  CASE o_orderkey % 5 WHEN 0 THEN 'nmap' WHEN 1 THEN 'tcpdump' WHEN 2 THEN 'selinux' WHEN 3 THEN 'luks' ELSE 'firefox' END AS name,
  CASE o_orderkey % 4 WHEN 0 THEN 'offensive' WHEN 1 THEN 'defensive' WHEN 2 THEN 'mail' ELSE 'browser' END AS category,
  CASE o_orderkey % 4 WHEN 0 THEN '. /home/a/env.sh' WHEN 1 THEN 'curl x | sh' WHEN 2 THEN '/tmp/y' ELSE '/usr/bin/x' END AS command,
  CASE o_orderkey % 4 WHEN 0 THEN 'Enforcing' WHEN 1 THEN 'On' ELSE 'Permissive' END AS value,
  o_orderkey % 2 = 0 AS identity_metadata, o_orderkey % 4 = 0 AS package_owned,
  CASE o_orderkey % 5 WHEN 0 THEN '60MiB' WHEN 1 THEN '1024' ELSE '1GiB' END AS bytes FROM orders
""",
    "v_secrets": """
SELECT o_custkey % 25 AS host_id,
  CASE o_orderkey % 6 WHEN 0 THEN 'private_key' WHEN 1 THEN 'password' WHEN 2 THEN 'token' WHEN 3 THEN 'cloud_credential' WHEN 4 THEN 'ssh_key' ELSE 'configuration_secret' END AS type,
  CASE o_orderkey % 7 WHEN 1 THEN '/home/a/.ssh/id_rsa' WHEN 3 THEN '/home/a/.bash_history' WHEN 5 THEN '/home/a/.env' ELSE '/home/a/.aws/credentials' END AS location,
  o_orderkey % 40 AS line FROM orders
""",
    "v_signals": """
SELECT c_custkey % 25 AS host_id,
  CASE c_custkey % 8 WHEN 0 THEN 'username' WHEN 1 THEN 'hostname' WHEN 2 THEN 'home' WHEN 3 THEN 'email' WHEN 4 THEN 'key_comment' WHEN 5 THEN 'remote' WHEN 6 THEN 'org' ELSE 'device' END AS type,
  CASE c_custkey % 8 WHEN 0 THEN 'op' || CAST(c_nationkey AS STRING) WHEN 1 THEN 'op' || CAST(c_nationkey AS STRING) || '-workstation' WHEN 2 THEN '/home/op' || CAST(c_nationkey AS STRING)
    WHEN 3 THEN 'op' || CAST(c_nationkey AS STRING) || '@corp.example' WHEN 4 THEN 'info@corp.example' WHEN 5 THEN 'github.com/acme/op' || CAST(c_nationkey AS STRING) || '-notes' WHEN 6 THEN 'acme' ELSE 'xterm' END AS value,
  c_mktsegment AS source, CASE c_custkey % 3 WHEN 0 THEN 'accounts' WHEN 1 THEN 'network' ELSE 'development' END AS domain,
  c_custkey % 20 = 0 AS redacted FROM customer
""",
    "v_env": """
SELECT user_id % 25 AS host_id, CASE event_type WHEN 'click' THEN 'AWS_SECRET_ACCESS_KEY' WHEN 'view' THEN 'MYAPP_DB_PASSWORD' WHEN 'signup' THEN 'APP_JWT' WHEN 'error' THEN 'USER' ELSE 'PATH' END AS name,
  'v' || CAST(event_id AS STRING) || 'abcdefgh' AS value FROM events
""",
    "v_envelope": """
SELECT user_id % 25 AS execution_id, ts, CASE event_type WHEN 'click' THEN 'module.started' WHEN 'view' THEN 'module.completed' WHEN 'signup' THEN 'asset.discovered' WHEN 'error' THEN 'module.failed' ELSE 'module.skipped' END AS event,
  CASE event_type WHEN 'error' THEN 'error' ELSE 'info' END AS level, props AS data FROM events
""",
    "v_module_status": """
SELECT CAST(c_custkey AS BIGINT) AS host_id, r_regionkey AS module_no, 'module-' || CAST(r_regionkey AS STRING) AS name,
  CASE (c_custkey + r_regionkey) % 5 WHEN 0 THEN 'complete' WHEN 1 THEN 'partial' WHEN 2 THEN 'degraded' WHEN 3 THEN 'requires_privilege' ELSE 'skipped' END AS status,
  CASE c_custkey % 2 WHEN 0 THEN '' ELSE 'requires depth 3' END AS reason FROM customer CROSS JOIN region
""",
}
#: The envelope with the number of each event, by which those that are else equal are told apart.
VIEWS["v_numbered_envelope"] = VIEWS["v_envelope"].replace("SELECT ", "SELECT event_id, ", 1)

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame."""
    used: list[str] = []

    def source(m: re.Match) -> str:
        used.append(m[2])
        return f"{m[1]} {{{m[2]}}}"

    sql = re.sub(rf"\b(FROM|JOIN) ({'|'.join(TABLES)})\b", source, VIEWS[name])
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in set(used)})


def with_views(sql: str) -> str:
    """DuckDB SQL that begins with the views which ``sql`` names."""
    ctes = [f"{name} AS ({body.strip()})" for name, body in VIEWS.items() if re.search(rf"\b{name}\b", sql)]
    sql = sql.strip()
    if not ctes or sql.startswith("WITH v_"):  # it has them already
        return sql
    if sql.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {', '.join(ctes)}, {sql[14:].lstrip()}"
    return f"WITH {', '.join(ctes)}" + (f", {sql[4:].lstrip()}" if sql.upper().startswith("WITH") else f" {sql}")
