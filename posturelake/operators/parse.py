"""Parsing jobs over recorded text lines (host_id, source, path, pos, line): accounts, network, processes, software, services (PRS-01 to PRS-14).

Every parser is a chain of column expressions; ``pos`` is the line's place in its file.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import basename

c = F.col

# Groups that administer, shells that do not log in, vendors and unit states.
ADMIN_GROUPS = ["sudo", "wheel", "admin", "Administrators", "root"]
NO_LOGIN = ["nologin", "false", "sync"]
SERVICE_SHELLS = [*NO_LOGIN, "shutdown", "halt", "games"]
VENDORS = ["fedora", "red hat", "centos", "redhat", "suse", "suse linux", "debian", "ubuntu", "canonical", "alpine", "arch linux", "almalinux", "rocky linux", "amazon", "photon", "opensuse"]
UNIT_STATES = ["enabled", "enabled-runtime", "static", "indirect", "disabled", "masked", "masked-runtime", "generated", "transient", "bad"]
INTERFACE_NAMES = (("loopback", "^(lo|lo0)$|^loopback"), ("vpn", "^(wg|tun|tap|ppp)|vpn|utun"), ("container", "^(docker|br-|veth|virbr|cni|flannel|podman|kube)"), ("virtual", "^(vmnet|vboxnet|vnic|hyper-v)"))


def words(line: Column) -> Column:
    return F.filter(F.split(line, r"\s+"), lambda w: w != "")


def _word(ws: Column, n: int) -> Column:
    return F.coalesce(F.get(ws, F.lit(n)), F.lit(""))


def passwd(lines: DataFrame, groups: DataFrame | None = None, admins: DataFrame | None = None, keys: DataFrame | None = None, logins: DataFrame | None = None) -> DataFrame:
    """PRS-01: accounts from passwd lines, with what PRS-02 to PRS-04 found for them."""
    f = F.split("line", ":")
    rows = lines.where(~F.ltrim("line").startswith("#")).withColumn("f", f).where(F.size("f") >= 7)
    rows = rows.select("host_id", *[c("f")[i].alias(n) for i, n in enumerate(("name", "__pw", "uid", "gid", "gecos", "home", "shell"))]).drop("__pw")
    base = basename(c("shell"))
    rows = rows.withColumns({"no_login": base.isin(*NO_LOGIN), "service": base.isin(*SERVICE_SHELLS), "privileged": c("uid").try_cast("long") == 0})
    rows = rows.withColumn("privileged", F.coalesce("privileged", F.lit(False)) | (c("gid") == "0"))
    if groups is not None:
        rows = rows.join(groups, ["host_id", "name"], "left").withColumn("groups", F.coalesce("groups", F.array().cast("array<string>")))
    if admins is not None:
        rows = rows.join(admins.select("host_id", "gid").distinct().withColumn("__admin", F.lit(True)), ["host_id", "gid"], "left").withColumn("privileged", c("privileged") | c("__admin").isNotNull()).drop("__admin")
    if keys is not None:
        rows = rows.join(keys, ["host_id", "home"], "left").withColumn("authorized_keys", F.coalesce("authorized_keys", F.lit(0)))
    return rows.join(logins, ["host_id", "name"], "left") if logins is not None else rows


def _group_rows(lines: DataFrame) -> DataFrame:
    clean = F.trim("line")
    return lines.where((clean != "") & ~clean.startswith("#")).withColumn("f", F.split(clean, ":")).where(F.size("f") >= 4)


def memberships(lines: DataFrame) -> DataFrame:
    """PRS-02: (host_id, name, groups), in the order of the lines."""
    one = _group_rows(lines).select("host_id", "pos", c("f")[0].alias("grp"), F.explode(F.split(c("f")[3], ",")).alias("m")).withColumn("name", F.trim("m")).where("name <> ''")
    return one.groupBy("host_id", "name").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "grp"))), lambda x: x["grp"]).alias("groups"))


def admin_gids(lines: DataFrame) -> DataFrame:
    """PRS-02: (host_id, gid) of administering groups; gid 0 administers everywhere."""
    return _group_rows(lines).where(c("f")[0].isin(*ADMIN_GROUPS)).select("host_id", c("f")[2].alias("gid")).distinct()


def authorized_keys(lines: DataFrame) -> DataFrame:
    """PRS-03: keys per home; ``path`` is the key file's."""
    clean = F.trim("line")
    home = F.regexp_replace("path", "/\\.ssh/authorized_keys$", "")
    return lines.where((clean != "") & ~clean.startswith("#")).groupBy("host_id", home.alias("home")).agg(F.count("*").cast("int").alias("authorized_keys"))


def last_logins(lines: DataFrame) -> DataFrame:
    """PRS-04: (host_id, name, last_login) from ``name epoch`` lines; only positive epochs count."""
    ws = words(c("line"))
    epoch = _word(ws, 1).try_cast("long")
    return lines.where(epoch > 0).select("host_id", _word(ws, 0).alias("name"), F.timestamp_seconds(epoch).alias("last_login"))


def strip_zone(addr: Column) -> Column:
    return F.when(F.instr(addr, "%") > 1, F.regexp_replace(addr, "%[^%]*$", "")).otherwise(addr)


def addr_port(text: Column) -> dict[str, Column]:
    """PRS-06: address and port of ``a:1``, ``[v6]:1`` and bare addresses (port 0)."""
    clean = F.trim(text)
    bracket = r"^\[([^\]]+)\]:?(.*)$"
    host, tail = F.regexp_extract(clean, r"^(.*):([^:]*)$", 1), F.regexp_extract(clean, r"^(.*):([^:]*)$", 2)
    number = lambda t: F.coalesce(F.when(t.rlike(r"^[+-]?[0-9]+$"), t.try_cast("int")), F.lit(0))
    bare = (F.instr(clean, ":") == 0) | host.contains(":")
    addr = F.when(clean.rlike(bracket), strip_zone(F.regexp_extract(clean, bracket, 1))).when(bare, strip_zone(clean)).otherwise(strip_zone(host))
    port = F.when(clean.rlike(bracket), number(F.regexp_extract(clean, bracket, 2))).when(bare, 0).otherwise(number(tail))
    return {"addr": addr, "port": port.cast("int")}


def address_scope(addr: Column) -> dict[str, Column]:
    """PRS-07: scope of a bound address and whether it is a wildcard; whatever is neither wildcard nor loopback counts as LAN."""
    a = F.lower(strip_zone(F.trim(addr)))
    wild = a.isin("", "0.0.0.0", "::", "[::]", "*")
    return {"scope": F.when(wild, "wildcard").when(a.isin("127.0.0.1", "::1", "[::1]", "localhost") | a.startswith("127."), "loopback").otherwise("lan"), "wildcard": wild}


def private_ipv4(addr: Column) -> Column:
    """PRS-07: private and carrier-grade addresses."""
    p = F.split(addr, "\\.")
    n = [F.coalesce(F.get(p, F.lit(i)).try_cast("int"), F.lit(-1)) for i in range(4)]
    valid = (F.size(p) == 4) & reduce(lambda a, b: a & b, [x.between(0, 255) for x in n])
    return valid & ((n[0] == 10) | ((n[0] == 172) & n[1].between(16, 31)) | ((n[0] == 192) & (n[1] == 168)) | ((n[0] == 100) & n[1].between(64, 127)))


def interface_kind(name: Column, addrs: Column) -> Column:
    """PRS-08: loopback by address, then by name, else LAN if it has an address."""
    low, out = F.lower(name), F.when(F.size(addrs) > 0, "lan").otherwise("unknown")
    for kind, pattern in reversed(INTERFACE_NAMES):
        out = F.when(low.rlike(pattern), kind).otherwise(out)
    return F.when(F.arrays_overlap(addrs, F.array(F.lit("127.0.0.1"), F.lit("::1"))), "loopback").otherwise(out)


def merge_addresses(interfaces: DataFrame, lines: DataFrame) -> DataFrame:
    """PRS-09: appends the addresses of ``ip -o addr`` lines to known interfaces and classifies anew."""
    ws = words(c("line"))
    found = lines.where(F.size(ws) >= 4).select("host_id", "pos", ws[1].alias("name"), F.substring_index(ws[3], "/", 1).alias("addr"))
    more = found.groupBy("host_id", "name").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "addr"))), lambda x: x["addr"]).alias("more"))
    out = interfaces.join(more, ["host_id", "name"], "left").withColumn("addrs", F.concat("addrs", F.coalesce("more", F.array().cast("array<string>")))).drop("more")
    return out.withColumn("kind", interface_kind(c("name"), c("addrs"))).withColumn("scope", c("kind"))


def sockets(lines: DataFrame) -> DataFrame:
    """PRS-05: sockets from ``ss`` and ``lsof`` listings (``source`` tells which)."""
    ws = words(c("line"))
    proto = F.upper(_word(ws, 0))
    ss = lines.where((c("source") == "ss") & (F.size(ws) >= 4))
    local = F.when(proto.contains("TCP") & (F.size(ws) > 4), _word(ws, 2)).otherwise(_word(ws, 1))
    ss = ss.select("host_id", proto.alias("proto"), local.alias("local"), F.regexp_extract("line", r'\("([^"]+)"', 1).alias("process"), F.coalesce(F.regexp_extract("line", r"pid=([0-9]+)", 1).try_cast("long"), F.lit(0).cast("long")).alias("pid"))
    lsof = lines.where((c("source") == "lsof") & (F.size(ws) >= 9)).select("host_id", F.lit("TCP").alias("proto"), _word(ws, 8).alias("local"), _word(ws, 0).alias("process"), F.lit(0).cast("long").alias("pid"))
    out = ss.unionByName(lsof).withColumns(addr_port(c("local"))).drop("local")
    return out.withColumns(address_scope(c("addr")))


def processes_ps(lines: DataFrame) -> DataFrame:
    """PRS-10: ``ps`` lines ``pid ppid user state name``; lines whose pid is no number are skipped."""
    ws = words(c("line"))
    rows = lines.withColumn("w", ws).where((F.size("w") >= 5) & _word(c("w"), 0).rlike("^[0-9]+$"))
    number = lambda n: F.coalesce(_word(c("w"), n).try_cast("long"), F.lit(-1).cast("long"))
    return rows.select("host_id", number(0).alias("pid"), number(1).alias("ppid"), _word(c("w"), 2).alias("user"), _word(c("w"), 3).alias("state"), _word(c("w"), 4).alias("name"))


def processes_csv(lines: DataFrame) -> DataFrame:
    """PRS-10: a listing as CSV whose first line names the columns, in any order and case."""
    fields = lines.withColumn("f", F.split(F.trim("line"), ","))
    header = fields.groupBy("host_id").agg(F.min_by("f", "pos").alias("h"), F.min("pos").alias("first"))
    rows = fields.join(header, "host_id").where((c("pos") > c("first")) & (F.size("f") >= F.size("h")))
    named = F.map_from_entries(F.transform("h", lambda x, i: F.struct(F.concat(F.upper(F.trim(x)), F.lit("")).alias("k"), F.trim(F.get(c("f"), i)).alias("v"))))
    get = lambda k: F.coalesce(F.try_element_at(c("m"), F.lit(k)), F.lit(""))
    number = lambda k: F.coalesce(get(k).try_cast("long"), F.lit(-1).cast("long"))
    return rows.withColumn("m", named).select("host_id", number("PROCESSID").alias("pid"), number("PARENTPROCESSID").alias("ppid"), get("NAME").alias("name"), get("COMMANDLINE").alias("args"), get("EXECUTABLEPATH").alias("exe"))


def csv_fields(line: Column) -> Column:
    """PRS-10: fields of a CSV line with quoted parts."""
    raw = F.regexp_extract_all(F.concat(line, F.lit(",")), F.lit(r'((?:"(?:[^"]|"")*"|[^,"])*),'), F.lit(1))
    return F.transform(raw, lambda x: F.replace(F.regexp_replace(F.replace(x, F.lit('""'), F.lit("\x00")), '"', ""), F.lit("\x00"), F.lit('"')))


def with_user_names(processes: DataFrame, accounts: DataFrame) -> DataFrame:
    """PRS-11: the name behind a numeric user, or the number."""
    names = accounts.where("uid <> ''").groupBy("host_id", c("uid").alias("user")).agg(F.max("name").alias("__name"))
    return processes.join(names, ["host_id", "user"], "left").withColumn("user", F.coalesce("__name", "user")).drop("__name")


def vendor_origin(vendor: Column) -> Column:
    low = F.lower(F.trim(vendor))
    return F.when(low.isin(*VENDORS), "official").when(low == "", "unknown").otherwise("third_party")


def packages(lines: DataFrame) -> DataFrame:
    """PRS-12: software from package listings; ``source`` is the provider."""
    tab, ws, clean = F.split(F.trim("line"), "\t"), words(c("line")), F.trim("line")
    t = lambda n: F.trim(_word(tab, n))
    tabbed, spaced = c("source").isin("dpkg", "rpm"), c("source").isin("pacman", "termux-pkg")
    rest = F.substring(clean, F.instr(clean, "-r") + 1, F.char_length(clean))
    has = F.instr(clean, "-r") > 0
    name = F.when(tabbed, _word(tab, 0)).when(spaced | (c("source") == "brew"), _word(ws, 0)).when((c("source") == "apk") & has, F.substring_index(clean, "-r", 1)).otherwise(clean)
    version = F.when(tabbed, t(1)).when(spaced, _word(ws, 1)).when(c("source") == "brew", F.array_join(F.slice(ws, 2, F.greatest(F.size(ws), F.lit(1))), " ")).when((c("source") == "apk") & has, F.substring_index(rest, "-", 1)).otherwise("")
    arch = F.when(tabbed, t(2)).when((c("source") == "apk") & has & (F.instr(rest, "-") > 0), F.substring(rest, F.instr(rest, "-") + 1, F.char_length(rest))).otherwise("")
    origin = F.when(c("source") == "rpm", vendor_origin(t(3))).when(c("source").isin("dpkg", "pkgutil"), "unknown").when(c("source") == "brew-cask", "third_party").otherwise("official")
    valid = (name != "") & F.when(tabbed, F.size(tab) >= 2).when(spaced, F.size(ws) >= 2).when(c("source") == "apk", ~clean.startswith("WARNING")).otherwise(True)
    return lines.where(valid).select("host_id", name.alias("name"), version.alias("version"), arch.alias("arch"), c("source").alias("provider"), origin.alias("origin"))


def systemd_services(files: DataFrame, units: DataFrame) -> DataFrame:
    """PRS-13: unit files with the state of the unit of the same name; of several states the last line's."""
    ws = words(c("line"))
    unit = lambda: F.regexp_replace(_word(ws, 0), "\\.service$", "")
    enabled = F.when(_word(ws, 1).isin(*UNIT_STATES), _word(ws, 1)).otherwise("unknown")
    defined = files.where(F.size(ws) >= 2).select("host_id", unit().alias("name"), enabled.alias("enabled"), F.lit("systemd").alias("kind"), _word(ws, 0).alias("unit_file"))
    states = units.where(F.size(ws) >= 4).groupBy("host_id", unit().alias("name")).agg(F.max_by(_word(ws, 2), "pos").alias("state"))
    return defined.join(states, ["host_id", "name"], "left").withColumn("state", F.coalesce("state", F.lit("")))


def launchd_services(lines: DataFrame) -> DataFrame:
    """PRS-14: ``launchctl list`` lines and files on disk (``source`` launchctl, plist or sysv)."""
    ws = words(c("line"))
    state = F.when(_word(ws, 0) == "-", "not-running").otherwise("running")
    loaded = lines.where((c("source") == "launchctl") & (F.size(ws) >= 3)).select("host_id", _word(ws, 2).alias("name"), state.alias("state"), F.lit("launchd").alias("kind"), F.lit("unknown").alias("enabled"), F.lit("").alias("unit_file"))
    disk = lines.where(c("source") == "plist").select("host_id", F.regexp_replace(basename(c("line")), "\\.plist$", "").alias("name"), F.lit("not-loaded").alias("state"), F.lit("launchd").alias("kind"), F.lit("on-disk").alias("enabled"), c("line").alias("unit_file"))
    sysv = lines.where(c("source") == "sysv").select("host_id", basename(c("line")).alias("name"), F.lit("installed").alias("state"), F.lit("sysv").alias("kind"), F.lit("unknown").alias("enabled"), c("line").alias("unit_file"))
    return loaded.unionByName(disk).unionByName(sysv)
