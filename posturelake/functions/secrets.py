"""Secret detection and redaction (SEC-SCAN, SEC-REC, SEC-SHAPE, SEC-KEY, RED-01 to RED-03, FN-12). No column made here holds a secret's value."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

REDACTED = "<redacted>"
MAX_LINE_BYTES = 4096

# Shapes of secret values and names.
VALUE_PREFIXES = "-----begin ghp_ gho_ ghu_ ghs_ ghr_ github_pat_ glpat- sk_live_ pk_live_ sk_test_ pk_test_ xoxb- xoxp- xoxa- xoxs- ya29. eyj akia asia".split()
#: Shapes of values, each after the texts (in lower case) one of which a value of that shape holds.
VALUE_SHAPES = (
    (("akia",), r"\bAKIA[0-9A-Z]{16}\b"),
    (("asia",), r"\bASIA[0-9A-Z]{16}\b"),
    (("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), r"\b(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{36}\b"),
    (("github_pat_",), r"\bgithub_pat_[A-Za-z0-9_]{50,}\b"),
    (("glpat-",), r"\bglpat-[A-Za-z0-9_-]{16,}\b"),
    (("-----begin ",), r"-----BEGIN (?:RSA |DSA |EC |OPENSSH |PGP |ENCRYPTED )?PRIVATE KEY-----"),
    (("eyj",), r"\beyJ[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]{5,}"),
    (("aiza",), r"\bAIza[0-9A-Za-z_-]{35}\b"),
    (("xox",), r"\bxox[baprs]-[A-Za-z0-9-]{10,}\b"),
    (("_live_", "_test_"), r"\b(?:sk|pk|rk)_(?:live|test)_[A-Za-z0-9]{16,}\b"),
    (("ya29.",), r"\bya29\.[A-Za-z0-9_-]{20,}\b"),
    (("-----begin ",), r"-----BEGIN CERTIFICATE-----"),
)
ASSIGNMENT = r"(?i)\b(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|secret[_-]?access[_-]?key|client[_-]?secret|private[_-]?key|auth[_-]?token|bearer)\b\s*[=:]\s*"
#: Texts in lower case one of which a named assignment holds.
ASSIGNED = ("passw", "pwd", "secret", "token", "key", "bearer")
KEY_PREFIXES = "secret token password passwd key credential private auth".split()
KEY_PARTS = "secret password credential apikey".split()
FLAGS = "--password -p --pass --token --secret --api-key --apikey --access-key --auth-token --client-secret".split()
PLACEHOLDER_WORDS = "true false none null prompt ask - -- 0 1".split()
PLACEHOLDER_PARTS = "changeme example redacted your".split()

#: Named patterns of a line, the first that fits decides: (type, texts in lower case one of which such a line holds, pattern with the groups field and value). RE2-safe.
LINE_PATTERNS = (
    ("private_key", ("-----begin ",), r"((-----BEGIN (?:RSA |DSA |EC |OPENSSH |PGP |ENCRYPTED )?PRIVATE KEY-----))"),
    ("cicd_credential", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), r"((?:ghp|gho|ghu|ghs|ghr)_)([A-Za-z0-9]{36})"),
    ("cicd_credential", ("github_pat_",), r"(github_pat_)([A-Za-z0-9_]{50,})"),
    ("cicd_credential", ("glpat-",), r"(glpat-)([A-Za-z0-9_-]{16,})"),
    ("jwt", ("eyj",), r"(eyJ[A-Za-z0-9_-]{5,})\.([A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]{5,})"),
    ("cloud_credential", ("akia", "asia"), r"(AKIA|ASIA)([0-9A-Z]{16})"),
    ("database_credential", ("://",), r"([A-Za-z0-9_]+)\s*[=:]\s*[\"']?(?:postgres|postgresql|mysql|mongodb|redis|amqp)(?:\+[a-z]+)?://[^:/@\s]*:([^@\s]{6,})@"),
    ("cloud_credential", ("aws_s", "azure_client_secret", "gcp_private_key"), r"(?i)(aws_secret_access_key|aws_session_token|azure_client_secret|gcp_private_key)[\"']?\s*[=:]\s*[\"']?([^\s\"']+)"),
    ("password", ("passw", "pwd"), r"(?i)([a-z0-9_-]*(?:password|passwd|pwd))[\"']?\s*[=:]\s*[\"']?([^\s\"']+)"),
    ("api_key", ("api",), r"(?i)([a-z0-9_-]*(?:api[_-]?key|apikey))[\"']?\s*[=:]\s*[\"']?([^\s\"']+)"),
    ("token", ("token", "secret"), r"(?i)([a-z0-9_-]*(?:token|secret))[\"']?\s*[=:]\s*[\"']?([^\s\"']+)"),
)
#: How the patterns of named values begin, of which a placeholder does not count.
NAMED = "(?i)"


def _any(value: Column, how: str, parts: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [getattr(value, how)(p) for p in parts])


def secret_key_name(name: Column) -> Column:
    """SEC-KEY."""
    low = F.lower(name)
    return _any(low, "startswith", KEY_PREFIXES) | _any(low, "contains", KEY_PARTS)


def secret_shaped(value: Column) -> Column:
    """SEC-SHAPE: a known prefix, a known shape, or a named assignment with at least 8 bytes left.

    A pattern is only tried where a plain text that it needs stands in the value.
    """
    low = F.lower(value)
    start = _any(F.ltrim(low), "startswith", VALUE_PREFIXES)
    shape = reduce(lambda a, b: a | b, [_any(low, "contains", texts) & value.rlike("(?is)" + pattern) for texts, pattern in VALUE_SHAPES])
    rest = F.regexp_extract(value, "(?s)" + ASSIGNMENT + r"(.*)$", 1)
    rest = F.trim(F.ltrim(rest, F.lit("\"'` \t")))
    named = (low.contains("=") | low.contains(":")) & _any(low, "contains", ASSIGNED) & (F.octet_length(rest) >= 8)
    return (low != "") & (value != REDACTED) & (start | shape | named)  # asked of ``low`` first, so that a projection makes it once


def placeholder(value: Column) -> Column:
    low = F.lower(value)
    return low.isin(*PLACEHOLDER_WORDS) | _any(low, "contains", PLACEHOLDER_PARTS)


def args_hold_credential(args: Column) -> Column:
    """FN-12: the value after the first place of a flag is long enough and no placeholder, or a URL holds a password."""
    low, found = F.lower(args), F.lit(False)
    for flag in FLAGS:
        for sep in ("=", " "):
            at = F.instr(low, flag + sep)
            value = F.regexp_extract(F.substring(args, at + len(flag + sep), F.char_length(args)), "^([^ \\t]*)", 1)
            # by cases, since what parts of a conjunction have in common is worked out for every row
            found |= F.when(at > 0, (F.octet_length(value) >= 8) & ~placeholder(value)).otherwise(False)
    before = F.substring_index(args, "@", 1)
    password = F.substring_index(before, ":", -1)
    url = args.contains("://") & args.contains("@") & (F.instr(before, ":") > 1) & (F.octet_length(password) >= 6)
    return found | url


def _weak(value: Column) -> Column:
    """Placeholders of the line scan: too short, one repeated character, a plain count, a reference, or a telling word."""
    low = F.lower(value)
    one = (F.char_length(F.replace(value, F.substring(value, 1, 1), F.lit(""))) == 0) | low.rlike("^(0123456789|123456789?0?)$")
    return (F.octet_length(value) < 8) | one | value.rlike(r"^(\$|<|%|\{\{)") | low.rlike("changeme|your[_-]|^example|redacted|placeholder") | low.isin(*PLACEHOLDER_WORDS)


def may_match(line: Column) -> Column:
    """Whether a line holds a plain text that one of the patterns needs."""
    low = F.lower(line)
    return (F.octet_length(line) <= MAX_LINE_BYTES) & _any(low, "contains", sorted({t for _, texts, _ in LINE_PATTERNS for t in texts}))


def match_line(line: Column) -> Column:
    """SEC-SCAN of one line: a struct (type, field, length), null if nothing fits. Named values that are placeholders do not count."""
    found, low = F.lit(None).cast("struct<type:string,field:string,length:int>"), F.lower(line)
    for kind, texts, pattern in reversed(LINE_PATTERNS):
        got = F.regexp_extract(line, pattern, 2)  # never empty where the pattern fits
        here = _any(low, "contains", texts) & (got != "")
        if pattern.startswith(NAMED):
            here &= ~_weak(got)
        found = F.when(here, F.struct(F.lit(kind).alias("type"), F.lower(F.regexp_extract(line, pattern, 1)).alias("field"), F.octet_length(got).cast("int").alias("length"))).otherwise(found)
    return F.when(F.octet_length(line) <= MAX_LINE_BYTES, found)


def scan_lines(lines: DataFrame, path: str = "path", line_no: str = "line_no", text: str = "line") -> DataFrame:
    """SEC-SCAN and SEC-REC: a record for each line that holds a credential; the line itself is dropped."""
    held = F.explode_outer(F.array(match_line(F.col(text)))).alias("__hit")  # from an array of one: a filter on it is not pushed below, so that a line is matched once
    others = [c for c in lines.columns if c not in (path, line_no, text)]
    hit = lines.where(may_match(F.col(text))).select(*others, F.col(path).alias("location"), F.col(line_no).alias("line"), held).where("__hit IS NOT NULL")
    hit = hit.select(*others, "location", "line", "__hit.*")
    return hit.withColumn("fingerprint", secret_fingerprint(F.col("location"), F.col("line"), F.col("type")))


def secret_fingerprint(location: Column, line: Column, kind: Column) -> Column:
    """SEC-REC: identifies the place of a secret, not its value."""
    return F.substring(F.sha2(F.concat_ws(":", location, line.cast("string"), kind), 256), 1, 12)


#: Texts in lower case one of which every name or value holds that RED-01 redacts; those that hold another one are left out.
TELLING = {*KEY_PREFIXES, *KEY_PARTS, *VALUE_PREFIXES, *ASSIGNED, *[t for texts, _ in VALUE_SHAPES for t in texts]}
TELLING = sorted(x for x in TELLING if not any(y != x and y in x for y in TELLING))


def redact_attributes(attributes: Column) -> Column:
    """RED-01. Within a higher-order function each test makes its texts anew, so that entries are tested one by one only where all of them together hold a telling text."""
    together = F.lower(F.concat_ws("\n", F.map_keys(attributes), F.map_values(attributes)))
    redacted = F.transform_values(attributes, lambda k, v: F.when(secret_key_name(k) | secret_shaped(v), REDACTED).otherwise(v))
    return F.when(_any(together, "contains", TELLING), redacted).otherwise(attributes)


def redact_evidence(evidence: Column) -> Column:
    """RED-02: array of structs with data, mode and reason. Each value is tested once."""

    def one(x: Column) -> Column:
        pick = lambda new, old: F.when(x["bad"], new).otherwise(x["e"][old])
        return x["e"].withField("data", pick(REDACTED, "data")).withField("mode", pick("full", "mode")).withField("reason", pick("secret-shaped value stripped at render", "reason"))

    tested = F.transform(evidence, lambda e: F.struct(e.alias("e"), secret_shaped(e["data"]).alias("bad")))
    return F.transform(tested, one)


def _texts(kind: T.DataType, path: str) -> list[tuple[str, Callable[[Column], Column]]]:
    """Every place that a value of type ``kind`` has texts in: its path, and an array of the texts that a value has there."""
    none = F.array().cast("array<string>")
    within = lambda part, f: lambda x: F.coalesce(F.flatten(F.transform(part(x), f)), none)
    if isinstance(kind, T.StringType):
        return [(path, lambda x: F.array(x))]
    if isinstance(kind, T.StructType):
        return [(at, (lambda f, name: lambda x: f(x[name]))(f, field.name)) for field in kind.fields for at, f in _texts(field.dataType, f"{path}.{field.name}")]
    if isinstance(kind, T.ArrayType):
        return [(at, within(lambda x: x, f)) for at, f in _texts(kind.elementType, f"{path}[]")]
    if isinstance(kind, T.MapType):
        return [(at, within(F.map_keys, f)) for at, f in _texts(kind.keyType, f"{path}{{key}}")] + [(at, within(F.map_values, f)) for at, f in _texts(kind.valueType, f"{path}{{}}")]
    return []


def retained_secrets(df: DataFrame) -> DataFrame:
    """RED-03: (column_name, retained), how many values look like secrets in each place that has texts; all counts must be 0.

    Texts are looked for at any depth: ``a.b`` is a field, ``a[]`` the elements of an array, ``a{key}`` and ``a{}`` the keys and values of a map. A row's equal texts are
    tested once, in rows of their own, since within arrays a test is interpreted.
    """
    places = [(at, f(F.col(f"`{field.name}`"))) for field in df.schema.fields for at, f in _texts(field.dataType, field.name)]
    if not places:
        return df.where("false").select(F.lit("").alias("column_name"), F.lit(0).cast("long").alias("retained"))
    row = df.select(F.array(*[texts for _, texts in places]).alias("texts"))
    each = row.select("texts", F.explode(F.array_distinct(F.flatten("texts"))).alias("text"))
    # a higher-order function has Spark compile the projection apart from a whole stage, where the test is too large a method
    tested = each.select(F.transform("texts", lambda x: x).alias("texts"), "text", secret_shaped(F.col("text")).alias("bad"))
    times = lambda k: F.size(F.filter(F.col("texts")[k], lambda x: x == F.col("text")))
    counts = tested.agg(*[F.coalesce(F.sum(F.when(F.col("bad"), times(k))), F.lit(0)).cast("long").alias(f"c{k}") for k in range(len(places))])
    told = [F.struct(F.lit(at).alias("column_name"), F.col(f"c{k}").alias("retained")) for k, (at, _) in enumerate(places)]
    return counts.select(F.inline(F.array(*told)))
