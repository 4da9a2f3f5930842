"""Parsing jobs over configuration lines and entities (PRS-15 to PRS-31, PRS-34 to PRS-37)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import basename
from ..plans.numbering import carried
from .parse import words

c = F.col

# Hosts, variables, escapes, tools and metadata names.
OFFICIAL_HOSTS = """archive.ubuntu.com security.ubuntu.com ports.ubuntu.com deb.debian.org security.debian.org deb.debian.org. ftp.debian.org
snapshot.debian.org dl.fedoraproject.org mirror.fedoraproject.org download.fedoraproject.org mirror.centos.org repo.almalinux.org vault.centos.org
mirror.rockylinux.org dl.rockylinux.org mirror.archlinux.org archlinux.org dl-cdn.alpinelinux.org security.alpinelinux.org pkg.freebsd.org
packages.debian.org developer.download.windowsupdate.com packages.microsoft.com""".split()
PROMPT_ESCAPES = {"\\u": "username", "\\h": "hostname", "\\H": "fqdn", "\\w": "working_directory", "\\W": "working_directory_basename", "\\n": "username", "\\d": "date", "\\T": "time", "\\s": "shell", "\\v": "shell_version", "\\@": "time", "\\[`": "command_output"}
HISTORY_KEYS = "HISTFILE HISTCONTROL HISTSIZE HISTFILESIZE HISTTIMEFORMAT".split()
CREDENTIAL_VARIABLES = {
    "AWS_SECRET_ACCESS_KEY": "cloud_credential", "AWS_ACCESS_KEY_ID": "cloud_credential", "AWS_SESSION_TOKEN": "cloud_credential", "AZURE_CLIENT_SECRET": "cloud_credential",
    "GOOGLE_APPLICATION_CREDENTIALS": "cloud_credential", "GITHUB_TOKEN": "token", "GH_TOKEN": "token", "GL_TOKEN": "token", "NPM_TOKEN": "token", "DOCKER_PASSWORD": "password",
    "OPENAI_API_KEY": "api_key", "ANTHROPIC_API_KEY": "api_key", "SLACK_TOKEN": "token", "DATABASE_URL": "database_credential", "DB_PASSWORD": "password", "SSH_AUTH_SOCK": "configuration_secret",
}
CREDENTIAL_ENDINGS = "_TOKEN _PASSWORD _PASSWD _SECRET _API_KEY _SECRET_KEY _ACCESS_KEY _JWT".split()
IDENTITY_VARIABLES = """USER USERNAME LOGNAME HOSTNAME COMPUTERNAME HOME HOMEPATH USERPROFILE PWD OLDPWD SHELL TERM TERM_PROGRAM GIT_AUTHOR_EMAIL
GIT_COMMITTER_EMAIL EMAIL KUBECONFIG AWS_PROFILE CONTAINER KUBERNETES_SERVICE_HOST AWS_REGION AWS_DEFAULT_REGION GOOGLE_CLOUD_PROJECT GIT_WORK_TREE
SSH_CONNECTION SSH_CLIENT SSH_TTY DISPLAY LANG EDITOR""".split()
CLOUD_KEYS = "aws_access_key_id aws_profile account project subscription tenant client_id".split()
TOOLS = {
    "offensive": {"nmap": "network scanner", "masscan": "network scanner", "metasploit": "exploitation framework", "msfconsole": "exploitation framework", "hydra": "credential brute-forcer", "john": "password cracker", "hashcat": "password cracker", "sqlmap": "injection tool", "nikto": "web vulnerability scanner", "gobuster": "content discovery", "ffuf": "web fuzzer", "aircrack-ng": "wireless auditing", "burpsuite": "web proxy", "bettercap": "network attack tool", "responder": "network poisoning tool", "mimikatz": "credential extraction", "impacket": "network protocol toolkit", "cobaltstrike": "command and control"},
    "defensive": {"wireshark": "packet analyser", "tshark": "packet analyser", "tcpdump": "packet capture", "suricata": "intrusion detection", "snort": "intrusion detection", "falco": "runtime security", "osquery": "host query tool", "lynis": "security auditing", "chkrootkit": "rootkit detection", "rkhunter": "rootkit detection"},
    "development": {"git": "version control", "docker": "container runtime", "kubectl": "kubernetes client", "terraform": "infrastructure as code", "ansible": "configuration management"},
    "cloud": {"aws": "aws command line", "gcloud": "google cloud cli", "az": "azure cli", "gh": "github cli"},
}
METADATA_ELEMENTS = {"creator": "author", "lastModifiedBy": "last_modified_by", "Company": "company", "Manager": "manager", "Application": "application", "initialCreator": "author", "meta:last_modified_by": "last_modified_by"}
GENERIC_VALUES = ["microsoft word", "microsoft office word", "microsoft excel", "microsoft powerpoint", "libreoffice", "openoffice.org", "adobe photoshop", "adobe acrobat", "sketch", "affinity photo", "gimp", "imagemagick", "exiftool", "canva", "figma", "windows photo editor", "picasa", "snapseed", "unknown", "samsung", "apple", "google", "samsung electronics"]
IDENTITY_KEYS = ["author", "last_modified_by", "company", "manager"]

_FILE = ("host_id", "path")


def _cut(line: Column) -> tuple[Column, Column]:
    """Lower-cased key and value around the first ``=``."""
    return F.lower(F.trim(F.substring_index(line, "=", 1))), F.trim(F.substring(line, F.instr(line, "=") + 1, F.char_length(line)))


def _number(lines: DataFrame) -> DataFrame:
    """``line_no``: the line's number among the non-blank lines of its file, from 1."""
    return carried(lines.where(F.trim("line") != ""), [c("pos")], _FILE, total={"line_no": F.lit(1)})


def registry_blocks(lines: DataFrame) -> DataFrame:
    """PRS-15: a map per registry key of a query's text; a name that is repeated in sequence has its values joined. A file is many tasks' work, a block is one row."""
    clean = F.trim("line")
    head = clean.startswith("HKEY_") | clean.startswith("\\")
    pattern = r"^(.*?)    REG_\S*\s+(.*)$"
    name = F.when(~head & clean.rlike(pattern), F.nullif(F.trim(F.regexp_extract(clean, pattern, 1)), F.lit("")))
    value = F.regexp_replace(F.trim(F.regexp_extract(clean, pattern, 2)), '^"(.*)"$', "$1")
    rows = lines.where(clean != "").select(*_FILE, "pos", head.alias("head"), name.alias("name"), value.alias("value"))
    rows = carried(rows, [c("pos")], _FILE, last={"headed": F.when(c("head"), c("pos"))}, before={"previous": F.when(c("name").isNotNull(), F.struct("pos", "name"))}, total={"block": c("head").cast("int")})
    goes_on = (c("previous.name") == c("name")) & F.coalesce(c("previous.pos") > c("headed"), F.lit(True))
    named = rows.where("name IS NOT NULL").withColumn("fresh", ~F.coalesce(goes_on, F.lit(False)))
    named = carried(named.select(*_FILE, "pos", "block", "name", "value", "fresh"), [c("pos")], _FILE, last={"run": F.when(c("fresh"), c("pos"))})
    joined = named.groupBy(*_FILE, "block", "run", "name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]), "; ").alias("value"))
    last = joined.groupBy(*_FILE, "block", "name").agg(F.max_by("value", "run").alias("value"))
    return last.groupBy(*_FILE, "block").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("values"))


def source_trust(uri: Column) -> Column:
    """PRS-19."""
    host = F.lower(F.regexp_extract(F.regexp_replace(uri, "^.*?://", ""), "^([^/:]*)", 1))
    official = host.isin(*OFFICIAL_HOSTS) | host.rlike(r"(\.edu|\.gov|\.ac\.uk)$")
    return F.when(uri.rlike("^(http|ftp)://"), "unsigned").when(official, "official").otherwise("third_party")


def _source_id() -> Column:
    return F.concat(basename(c("path")), F.lit("#"), c("line_no").cast("string"))


def repository_lines(lines: DataFrame, provider: str = "apt", kind: str = "deb") -> DataFrame:
    """PRS-16: the first URI of a line, and its ``[options]`` as the count of keys."""
    ws = words(c("line"))
    uri = F.get(F.filter(ws, lambda w: w.rlike("^(https?|ftp|rsync|file)://")), F.lit(0))
    keys = F.size(F.filter(ws, lambda w: w.rlike(r"^\[.+\]$")))
    rows = _number(lines).where(~F.trim("line").startswith("#")).withColumns({"uri": uri, "keys": keys}).where("uri IS NOT NULL")
    note = F.when(source_trust(c("uri")) == "unsigned", "source is not served over TLS").otherwise("")
    return rows.select("host_id", _source_id().alias("id"), F.lit(provider).alias("provider"), F.lit(kind).alias("kind"), "uri", source_trust(c("uri")).alias("trust"), "keys", F.lit(True).alias("enabled"), note.alias("note"))


def repository_files(lines: DataFrame, provider: str = "dnf") -> DataFrame:
    """PRS-17: ``baseurl`` of each section; the section's first ``gpgcheck`` tells whether it is signed."""
    clean = F.trim("line")
    name = F.when(clean.rlike(r"^\[.*\]$"), F.btrim(clean, F.lit("[]")))
    rows = carried(lines.where(clean != ""), [c("pos")], _FILE, last={"section": name}, total={"line_no": F.lit(1)}).withColumn("section", F.coalesce("section", F.lit("")))
    key, value = _cut(clean)
    rows = rows.where(~clean.startswith("#") & clean.contains("=") & ~clean.startswith("[")).withColumns({"key": key, "value": value})
    checks = rows.where("key = 'gpgcheck'").groupBy(*_FILE, "section").agg(F.min_by(c("value").eqNullSafe("1") | (F.lower("value") == "true"), "pos").alias("checked"))
    urls = rows.where("key = 'baseurl'").join(checks, [*_FILE, "section"], "left")
    off = c("checked").isNotNull() & ~c("checked")
    return urls.select("host_id", _source_id().alias("id"), F.lit(provider).alias("provider"), c("section").alias("kind"), c("value").alias("uri"), F.when(off, "unsigned").otherwise(source_trust(c("value"))).alias("trust"), F.when(c("checked").isNotNull(), 1).otherwise(0).alias("keys"), F.lit(True).alias("enabled"), F.when(off, "gpgcheck is disabled for this repository").otherwise("").alias("note"))


def server_lines(lines: DataFrame) -> DataFrame:
    """PRS-18: what follows ``Server`` at a line's start."""
    clean = F.trim("line")
    uri = F.trim(F.regexp_replace(clean, "^Server", ""))
    rows = _number(lines).where(clean.startswith("Server") & (uri != ""))
    return rows.select("host_id", _source_id().alias("id"), F.lit("pacman").alias("provider"), F.lit("repository").alias("kind"), uri.alias("uri"), source_trust(uri).alias("trust"), F.lit(1).alias("keys"), F.lit(True).alias("enabled"))


def sshd_settings(lines: DataFrame) -> DataFrame:
    """PRS-20: (host_id, key, value): the first occurrence of a key wins. Included files' lines follow the including line by ``pos``."""
    ws = words(c("line"))
    rows = lines.where(~F.ltrim("line").startswith("#") & (F.size(ws) >= 1)).select("host_id", "pos", F.lower(ws[0]).alias("key"), F.array_join(F.slice(ws, 2, F.greatest(F.size(ws), F.lit(1))), " ").alias("value"))
    return rows.where("key <> 'include'").groupBy("host_id", "key").agg(F.min_by("value", "pos").alias("value"))


def git_settings(lines: DataFrame) -> DataFrame:
    """PRS-21: (host_id, path, pos, setting, value) of name, email and remote url; the key is qualified with the carried section."""
    clean = F.trim("line")
    section = F.when(clean.startswith("["), F.lower(F.regexp_extract(clean, r"^\[\s*([A-Za-z0-9.-]*)", 1)))
    rows = carried(lines, [c("pos")], _FILE, last={"section": section})
    key, value = _cut(clean)
    rows = rows.where(clean.contains("=") & ~clean.startswith("[")).withColumns({"setting": F.concat_ws(".", "section", key), "value": value})
    value = F.when(c("setting") == "remote.url", strip_url_credentials(c("value"))).otherwise(c("value"))
    return rows.where(c("setting").isin("user.name", "user.email", "remote.url") & (c("value") != "")).select(*_FILE, "pos", "setting", value.alias("value"))


def strip_url_credentials(url: Column) -> Column:
    """PRS-22: without what stands before ``@`` in the authority; of the scp form only ``user:password@`` goes."""
    schemed = F.regexp_replace(url, r"^(.*?://)[^/]*@", "$1")
    at, colon, slash = (F.instr(url, x) for x in "@:/")
    keep = (at == 0) | (colon == 0) | (colon > at) | ((slash > 0) & (colon > slash))
    return F.when(F.instr(url, "://") > 0, schemed).when(keep, url).otherwise(F.substring(url, at + 1, F.char_length(url)))


def remote_parts(url: Column) -> Column:
    """PRS-23: struct (host, path) of a remote URL, null without a host and a path."""
    rest = F.regexp_replace(url, "^.*?://", "")
    rest = F.when(rest.contains("/"), F.regexp_replace(rest, "^[^/]*@", "")).otherwise(F.regexp_replace(rest, "^[^@]*@", ""))
    scp = (F.instr(url, "://") == 0) & rest.contains(":") & ~rest.contains("//")
    host = F.when(scp, F.substring_index(rest, ":", 1)).otherwise(F.substring_index(rest, "/", 1))
    path = F.when(scp, F.regexp_replace(F.substring(rest, F.instr(rest, ":") + 1, F.char_length(rest)), "^/", "")).otherwise(F.when(rest.contains("/"), F.substring(rest, F.instr(rest, "/") + 1, F.char_length(rest))).otherwise(""))
    return F.when((host != "") & (path != ""), F.struct(host.alias("host"), path.alias("path")))


def prompt_disclosures(prompt: Column) -> Column:
    """PRS-24: names of what a prompt shows, one for each escape, sorted."""
    found = F.array_compact(F.array(*[F.when(prompt.contains(e), n) for e, n in PROMPT_ESCAPES.items()]))
    return F.array_join(F.array_sort(found), ",")


def shell_settings(lines: DataFrame) -> DataFrame:
    """PRS-24: per startup file the first prompt's disclosures and the last value of each history setting."""
    clean = F.trim("line")
    rows = _number(lines).withColumn("clean", clean)
    prompt = F.when(c("clean").rlike("^(PS1|PROMPT)="), c("clean"))
    history = [F.max_by(F.when(c("clean").startswith(k), F.trim(F.substring(c("clean"), len(k) + 1, 10_000))), F.when(c("clean").startswith(k), c("pos"))).alias(k.lower()) for k in HISTORY_KEYS]
    first = rows.groupBy(*_FILE).agg(F.min_by(prompt, F.when(prompt.isNotNull(), c("pos"))).alias("__prompt"), F.min(F.when(prompt.isNotNull(), c("line_no"))).alias("prompt_line"), F.count("*").alias("lines"), *history)
    return first.withColumn("prompt", prompt_disclosures(c("__prompt"))).drop("__prompt")


def variable_class(name: Column) -> Column:
    """PRS-25: secret type of a variable's name, ``identity``, or null."""
    up, exact = F.upper(name), F.lit(None).cast("string")
    for variable, kind in CREDENTIAL_VARIABLES.items():
        exact = F.when(up == variable, kind).otherwise(exact)
    ends = up.rlike(f"^.+({'|'.join(CREDENTIAL_ENDINGS)})$")
    guess = F.when(up.rlike("AWS|AZURE|GCP|GOOGLE"), "cloud_credential").when(up.rlike("DB|DATABASE|POSTGRES|MYSQL|MONGO"), "database_credential").when(up.contains("JWT"), "jwt").otherwise("token")
    return F.coalesce(exact, F.when(ends, guess), F.when(up.isin(*IDENTITY_VARIABLES), "identity"))


def environment(variables: DataFrame, placeholder: Column | None = None) -> DataFrame:
    """PRS-25: secret records of credential variables of at least 8 bytes, and identity variables; no secret's value is kept.

    ``variables`` has host_id, machine, name and value.
    """
    kind = variable_class(c("name"))
    secret = kind.isNotNull() & (kind != "identity") & (F.octet_length("value") >= 8)
    if placeholder is not None:
        secret &= ~placeholder
    rows = variables.withColumns({"class": kind, "secret": secret}).where(c("secret") | (c("name").isNotNull() & F.upper("name").isin(*IDENTITY_VARIABLES) & (c("value") != "")))
    mark = F.substring(F.sha2(F.concat_ws(":", "machine", "name", "value"), 256), 1, 12)
    return rows.select("host_id", "name", F.when(c("secret"), c("class")).otherwise("identity").alias("class"), F.when(c("secret"), mark).alias("fingerprint"), F.when(c("secret"), F.octet_length("value")).alias("length"), F.when(~c("secret"), c("value")).alias("value"))


def cloud_accounts(lines: DataFrame) -> DataFrame:
    """PRS-26: account signals from ``key=value`` lines of cloud configurations."""
    key, value = _cut(c("line"))
    rows = lines.where(c("line").contains("=")).withColumns({"key": key, "value": F.btrim(value, F.lit("\"',"))})
    return rows.where(c("key").isin(*CLOUD_KEYS) & (c("value") != "")).select("host_id", F.lit("account").alias("type"), "value", c("path").alias("source"), F.lit("cloud-identity").alias("domain"))


def persistence_assets(services: DataFrame, startup: DataFrame) -> DataFrame:
    """PRS-27: enabled services and the commands of startup files."""
    on = services.where("enabled = 'enabled'").select("host_id", "name", c("unit_file").alias("path"), c("kind").alias("mechanism"), F.lit(None).cast("int").alias("line"), "exec_start", F.lit("").alias("command"))
    clean = F.trim("line")
    commands = _number(startup).where(~clean.startswith("#")).select("host_id", c("source").alias("name"), "path", c("source").alias("mechanism"), c("line_no").alias("line"), F.lit("").alias("exec_start"), clean.alias("command"))
    return on.unionByName(commands)


def tool_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, k, d) for k, tools in TOOLS.items() for n, d in tools.items()], "name string, category string, disclosure string")


def known_tools(commands: DataFrame) -> DataFrame:
    """PRS-28: commands on a host that are in the fixed table of tools."""
    return commands.join(F.broadcast(tool_table(commands.sparkSession)), "name").dropDuplicates(["host_id", "name"])


def package_owner(line: Column) -> Column:
    """PRS-30: struct (path, owner) of ``path: owner``, null for other lines."""
    at = F.instr(line, ": ")
    return F.when(at > 1, F.struct(F.trim(F.substring(line, F.lit(1), at - 1)).alias("path"), F.trim(F.substring(line, at + 2, F.char_length(line))).alias("owner")))


def provenance(paths: DataFrame, owners: DataFrame, software: DataFrame, support: DataFrame) -> DataFrame:
    """PRS-29: state of each path by its owner, and the owner's version; a host without owner lookup cannot verify."""
    def short(name: Column) -> Column:
        for mark in (":", "."):
            name = F.when(F.instr(name, mark) > 1, F.regexp_replace(name, f"[{mark}][^{mark}]*$", "")).otherwise(name)
        return name

    versions = software.select("host_id", short(c("name")).alias("package_owner"), c("version").alias("v")).where("package_owner <> ''").groupBy("host_id", "package_owner").agg(F.max("v").alias("package_version"))
    rows = paths.join(owners.withColumnRenamed("owner", "package_owner"), ["host_id", "path"], "left").join(support, "host_id", "left").join(versions, ["host_id", "package_owner"], "left")
    state = F.when(F.coalesce("package_owner", F.lit("")) != "", "package_owned").when(~F.coalesce("owner_lookup", F.lit(True)), "unverifiable").otherwise("unowned")
    return rows.select("host_id", "path", state.alias("state"), F.coalesce("package_owner", F.lit("")).alias("package_owner"), F.coalesce("package_version", F.lit("")).alias("package_version"))


def verification_problems(lines: DataFrame) -> DataFrame:
    """PRS-31: problem lines of package verification; ``source`` is debsums, rpm or pacman."""
    ws, clean = words(c("line")), F.trim("line")
    bad = F.when(c("source") == "debsums", c("line").startswith("DEBCHECK")).when(c("source") == "rpm", (F.size(ws) >= 4) & F.coalesce(F.get(ws, F.lit(3)), F.lit("")).contains("5")).when(c("source") == "pacman", c("line").rlike("modified|unexpected")).otherwise(False)
    return lines.where(bad).select("host_id", "source", F.when(c("source") == "rpm", F.array_join(ws, " ")).otherwise(clean).alias("problem"))


def tree_sizes(files: DataFrame, roots: DataFrame, max_depth: int) -> DataFrame:
    """PRS-34: files and bytes under each root down to ``max_depth`` folders; ``files`` has host_id, path and size.

    Each file is joined on its own ancestor folders, not by a range.
    """
    parts = F.split(F.regexp_replace("path", "/[^/]*$", ""), "/")
    folders = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, 1, i), "/").alias("root"), (F.size(parts) - i).alias("depth")))
    up = files.select("host_id", "size", F.explode(folders).alias("f")).select("host_id", "size", "f.*").where(c("depth") <= max_depth)
    found = up.join(roots.select("host_id", "root").distinct(), ["host_id", "root"]).groupBy("host_id", "root").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
    return found


def clean_metadata(value: Column) -> Column:
    """PRS-35: without outer blanks, at most 256 characters; empty for generic values."""
    v = F.substring(F.trim(F.btrim(F.trim(value), F.lit("\x00"))), 1, 256)
    return F.when(F.lower(F.trim(v)).isin(*GENERIC_VALUES), "").otherwise(v)


def document_metadata(text: Column, elements: dict[str, str] | None = None) -> Column:
    """PRS-35: array of (key, value), up to two of each element name of a document's XML."""
    fields = []
    for name, key in (elements or METADATA_ELEMENTS).items():
        tag = rf"(?:[A-Za-z0-9_.\-]+:)?{name}"
        values = F.slice(F.regexp_extract_all(text, F.lit(rf"(?s)<{tag}\b[^>]*>(.*?)</{tag}>"), F.lit(1)), 1, 2)
        fields.append(F.arrays_zip(F.array_repeat(F.lit(key), F.size(values)).alias("key"), F.transform(values, clean_metadata).alias("value")))
    return F.filter(F.concat(*fields), lambda f: f["value"] != "")


def has_identity(fields: Column) -> Column:
    return F.exists(fields, lambda f: f["key"].isin(*IDENTITY_KEYS))


def entity_signals(accounts: DataFrame, hosts: DataFrame, homes: DataFrame) -> DataFrame:
    """PRS-36: identity signals from accounts, hosts and home folders."""
    one = lambda df, kind, value, source, domain: df.select("host_id", F.lit(kind).alias("type"), value.alias("value"), F.lit(source).alias("source"), F.lit(domain).alias("domain"))
    parts = [one(accounts, "username", c("name"), "accounts", "accounts"), one(hosts, "hostname", c("hostname"), "host", "host-identity"), one(hosts, "username", c("user_name"), "host", "host-identity"), one(homes, "home", basename(c("home")), "homes", "filesystem-exposure")]
    return reduce(DataFrame.unionByName, parts).where("value <> ''")


def as_assets(df: DataFrame, kind: str, domain: str, name: str, path: str | None = None, attributes: tuple[str, ...] = ()) -> DataFrame:
    """PRS-37: any entity table as generic assets, its other columns as attributes; empty ones are left out."""
    pairs = [x for a in attributes for x in (F.lit(a), F.coalesce(c(a).cast("string"), F.lit("")))]
    made = F.map_filter(F.create_map(*pairs), lambda k, v: v != "") if pairs else F.create_map().cast("map<string,string>")
    return df.select("host_id", F.lit(kind).alias("kind"), F.lit(domain).alias("domain"), c(name).alias("name"), (c(path) if path else F.lit("")).alias("path"), made.alias("attributes"))
