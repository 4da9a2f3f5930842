"""Recorded snapshots: strict loading, defaults, and one table per entity (SRC-01 to SRC-04)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import stored

SCHEMA_VERSION = "1.0"
#: Entities of a snapshot and their fields.
ENTITIES = {
    "accounts": "name string, uid string, gid string, groups array<string>, shell string, home string, gecos string, privileged boolean, service boolean, no_login boolean, locked boolean, last_login timestamp, classification string, authorized_keys int, source string",
    "sockets": "proto string, addr string, port int, scope string, process string, pid bigint, wildcard boolean",
    "interfaces": "name string, addrs array<string>, mac string, up boolean, kind string, scope string",
    "processes": "pid bigint, ppid bigint, name string, user string, args string, exe string, cwd string, started string, state string",
    "services": "name string, state string, enabled string, kind string, unit_file string, user string, exec_start string, source string",
    "software": "name string, version string, arch string, provider string, origin string",
    "package_sources": "id string, provider string, kind string, uri string, trust string, keys int, enabled boolean, note string",
    "provenance": "path string, state string, package_owner string, package_version string, modified boolean, source string",
    "secrets": "type string, location string, line int, field string, fingerprint string, length int, source string, redaction string",
    "signals": "type string, value string, source string, domain string, module_id string, redacted boolean, at timestamp",
    "assets": "pos bigint, id string, kind string, domain string, name string, path string, source string, attributes map<string,string>",
    "module_status": "module_id string, name string, status string, assets int, reason string, unavailable array<string>",
}
ENV = "platform string, hostname string, user_name string, cloud string, container boolean, container_kind string, history_files array<string>"
TARGET = "id bigint, name string, type string, authorized boolean"
SCHEMA = f"schema string, name string, description string, snapshot struct<target:struct<{TARGET.replace(' ', ':').replace(',:', ',')}>,env:struct<{ENV.replace(' ', ':').replace(',:', ',')}>,collected_at:timestamp,depth:int," + ",".join(f"{k}:array<struct<{v.replace(' ', ':').replace(',:', ',')}>>" for k, v in ENTITIES.items()) + ">"


MOST_BYTES = 64 << 20
_TYPED = f"{SCHEMA}, _bad string"
#: How ``schema_of_variant`` may describe a field of each type; a null fits all.
_SHAPES = {"string": "STRING", "timestamp": "STRING", "int": "BIGINT", "bigint": "BIGINT", "boolean": "BOOLEAN", "array<string>": "ARRAY<(STRING|VOID)>", "map<string,string>": "OBJECT<(?!.*: (BIGINT|BOOLEAN|DOUBLE|DECIMAL|ARRAY|OBJECT|VARIANT)).*>", "object": "OBJECT<.*>", "objects": "ARRAY<(VOID|OBJECT<.*>)>"}
_OBJECT = "map<string,variant>"


def _fields(ddl: str) -> dict[str, str]:
    return dict(field.strip().split(" ") for field in ddl.split(", "))


def _faults(path: str, held: Column, fields: dict[str, str]) -> Column:
    """What is wrong with an object that ``held`` has as a map: fields that ``fields`` does not know, or values of another type."""
    shape = F.create_map(*[x for name, kind in fields.items() for x in (F.lit(name), F.lit(f"^({_SHAPES[kind]}|VOID)$"))])

    def fault(entry: Column) -> Column:
        want = F.try_element_at(shape, entry["key"])
        at = F.concat(F.lit(path), entry["key"])
        return F.when(want.isNull(), F.concat(F.lit("unknown field "), at)).when(~F.regexp_like(F.schema_of_variant(entry["value"]), want), F.concat(F.lit("wrong type of "), at))

    return F.coalesce(F.array_compact(F.transform(F.map_entries(held), fault)), F.array().cast("array<string>"))


def _sound() -> str:
    """A pattern of what ``schema_of_variant`` tells of a snapshot without any of the faults that ``_all_faults`` knows. Types of an array's elements are told as one, which is among these only if each of them is."""
    kinds = _SHAPES | {"array<string>": "ARRAY<(?:STRING|VOID)>", "map<string,string>": r"OBJECT<(?:\w++: (?:STRING|VOID)(?:, |(?=>)))*+>"}
    held = lambda fields: "OBJECT<(?:(?:" + "|".join(f"{name}: (?:{kind}|VOID)" for name, kind in fields.items()) + ")(?:, |(?=>)))*+>"
    typed = lambda ddl: held({name: kinds[kind] for name, kind in _fields(ddl).items()})
    rows = {name: f"ARRAY<(?:{typed(ddl)}|VOID)>" for name, ddl in ENTITIES.items()}
    shot = held({"target": typed(TARGET), "env": typed(ENV), "collected_at": "STRING", "depth": "BIGINT"} | rows)
    return "^" + held(dict.fromkeys(("schema", "name", "description"), "STRING") | {"snapshot": shot}) + "$"


def _all_faults(v: Column) -> Column:
    """Faults of a whole snapshot, the outermost first."""
    held = lambda path, kind=_OBJECT: F.try_variant_get(v, path, kind)
    parts = [
        _faults("", held("$"), {"schema": "string", "name": "string", "description": "string", "snapshot": "object"}),
        _faults("snapshot.", held("$.snapshot"), {"target": "object", "env": "object", "collected_at": "timestamp", "depth": "int"} | dict.fromkeys(ENTITIES, "objects")),
        _faults("snapshot.target.", held("$.snapshot.target"), _fields(TARGET)),
        _faults("snapshot.env.", held("$.snapshot.env"), _fields(ENV)),
    ]
    for name, ddl in ENTITIES.items():
        rows = held(f"$.snapshot.{name}", f"array<{_OBJECT}>")
        parts.append(F.coalesce(F.flatten(F.transform(rows, lambda row: _faults(f"snapshot.{name}.", row, _fields(ddl)))), F.array().cast("array<string>")))  # noqa: B023  used at once
    return F.concat(*parts)


def load(spark: SparkSession, folder: str, lines: bool = False, most_bytes: int = MOST_BYTES, parts: bool = False) -> DataFrame:
    """SRC-01: (schema, name, description, snapshot, file, reject) of every recorded snapshot; ``reject`` is the reason against it or empty. A rejected one has no snapshot, and harms no other.

    A file is one snapshot, or one to a line with ``lines``, which lets large files be split; blank lines and empty files are none. Reasons, the first of which counts: larger than ``most_bytes`` (such a file
    is not read, only listed), no JSON object, a field that the schema does not know or of another type, an unknown schema, no target type, no environment. Names of fields are told
    apart by case, and an object that has one twice is no JSON object here.

    With ``parts`` a line is the snapshot's name, a tab and a JSON object; lines of one name are parts of one snapshot, each with its target and environment and some rows of its entities, so that a snapshot of any
    size is no large row. The name is told as ``part_of``; ``verdicts`` and ``entities`` take a snapshot with a rejected part as rejected.
    """
    lines |= parts
    if lines:
        text = spark.read.text(folder).where(F.trim("value") != "").select(F.col("_metadata.file_path").alias("file"), F.octet_length("value").cast("long").alias("bytes"), "value")
        if parts:
            tab = F.instr("value", "\t")
            text = text.withColumns({"part_of": F.substring_index("value", "\t", 1), "value": F.when(tab > 0, F.substr("value", tab + 1)).otherwise("")})
        text = text.withColumns({"value": F.when(F.col("bytes") <= most_bytes, F.col("value")), "deal": F.xxhash64("value")})
        text = text.hint("rebalance", "deal").drop("deal")  # a compressed file is one task's, and some MB of it are hundreds of MB to parse
    else:  # this source reads no content of files that its filter on the length leaves out
        files = spark.read.format("binaryFile").load(folder)
        listed = lambda rows, value: rows.select(F.col("path").alias("file"), F.col("length").alias("bytes"), value.cast("string").alias("value"))
        text = listed(files.where(F.col("length") <= most_bytes), F.col("content")).union(listed(files.where(F.col("length") > most_bytes), F.lit(None)))
    text = text.withColumn("value", F.make_valid_utf8("value"))
    parsed = text.withColumns({"v": F.try_parse_json("value"), "typed": F.from_json("value", _TYPED, {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"})})
    faults = F.when(F.regexp_like("types", F.lit(_sound())), F.array().cast("array<string>")).otherwise(_all_faults(F.col("v")))  # field by field only where there are any
    reject = (
        F.when(F.col("bytes") > most_bytes, "too large")
        .when(F.col("v").isNull() | ~F.col("types").startswith("OBJECT<"), "malformed")
        .when(F.size("faults") > 0, F.try_element_at("faults", F.lit(1)))
        .when(F.col("typed._bad").isNotNull(), "malformed")
        .when(F.coalesce("typed.schema", F.lit("")) != SCHEMA_VERSION, "unknown schema")
        .when(F.coalesce("typed.snapshot.target.type", F.lit("")) == "", "no target type")
        .when(F.col("typed.snapshot.env").isNull(), "no environment")
        .otherwise("")
    )
    judged = parsed.withColumn("types", F.schema_of_variant("v")).withColumn("faults", faults).withColumn("reject", reject)
    return judged.select("typed.schema", "typed.name", "typed.description", F.when(F.col("reject") == "", F.col("typed.snapshot")).alias("snapshot"), "file", "reject", *(["part_of"] if parts else []))


def verdicts(loaded: DataFrame) -> DataFrame:
    """(part_of, reject, kept) of each snapshot that was loaded in parts: it is kept whole or, for the last reason in order of its text, not at all."""
    found = loaded.groupBy("part_of").agg(F.max("reject").alias("reject"))
    return found.withColumn("kept", F.col("reject") == "")


def with_defaults(snapshots: DataFrame) -> DataFrame:
    """SRC-02: depth below 1 is 1, a missing time is the epoch, an empty target type is a simulation."""
    depth = F.greatest(F.coalesce("depth", F.lit(1)), F.lit(1))
    when = F.coalesce("collected_at", F.timestamp_seconds(F.lit(0)))
    kind = F.coalesce(F.nullif("target_type", F.lit("")), F.lit("simulation"))
    return snapshots.withColumns({"depth": depth, "collected_at": when, "target_type": kind})


def hosts(loaded: DataFrame) -> DataFrame:
    """The host table of the snapshots that were not rejected."""
    ok = loaded.where("reject = ''").select(F.col("snapshot.target.id").alias("host_id"), F.col("snapshot.target.type").alias("target_type"), F.coalesce("snapshot.target.authorized", F.lit(False)).alias("authorized"), "snapshot.collected_at", "snapshot.depth", "snapshot.env.*")
    text = {n: F.coalesce(n, F.lit("")) for n in ("hostname", "user_name", "cloud", "container_kind")}
    return with_defaults(ok).withColumns(text | {"container": F.coalesce("container", F.lit(False)), "history_files": F.coalesce("history_files", F.array().cast("array<string>"))})


def _rows_apart(loaded: DataFrame) -> DataFrame:
    """``loaded`` with a row for each place in the lists of entities, and one at least: ``at`` is the place, from 0 or null, ``e`` has what each entity's list holds there, null where it ends."""
    def listed(name: str, ddl: str) -> Column:
        rows, kind = F.col(f"snapshot.{name}"), f"struct<{ddl.replace(' ', ':').replace(',:', ',')}>"
        empty = F.struct(*[F.lit(None).cast(k).alias(x) for x, k in _fields(ddl).items()])  # a null element is a row whose fields are missing
        whole = F.when(F.exists(rows, lambda e: e.isNull()), F.transform(rows, lambda e: F.coalesce(e, empty))).otherwise(rows)
        return F.coalesce(whole, F.array().cast(f"array<{kind}>")).alias(name)

    known = [x for x in ("part_of", "reject") if x in loaded.columns]
    shot = F.struct(*[F.col(f"snapshot.{x}") for x in ("target", "env", "collected_at", "depth")]).alias("snapshot")
    lists = loaded.select(*known, shot, *[listed(name, ddl) for name, ddl in ENTITIES.items()])
    return lists.select(*known, "snapshot", F.posexplode_outer(F.arrays_zip(*ENTITIES)).alias("at", "e"))


def entities(loaded: DataFrame) -> dict[str, DataFrame]:
    """SRC-03: a table per entity, keyed by host. Missing texts are empty, missing flags false, missing numbers 0; only times stay null. The snapshots are parsed once for all tables, and kept as rows of
    entities, since lists would be read some thousand at a time."""
    ok = stored(_rows_apart(loaded))  # a table reads its own columns of it
    if "part_of" in loaded.columns:
        ok = ok.join(stored(ok.where("reject <> ''").select("part_of").distinct()), "part_of", "left_anti")  # stored, so that Spark knows its size
    ok = ok.where("reject = ''")
    first = ok.where("coalesce(at, 0) = 0")
    out = {"hosts": hosts(first).distinct() if "part_of" in loaded.columns else hosts(first)}
    for name in ENTITIES:
        rows = ok.where(F.col(f"e.{name}").isNotNull()).select(F.col("snapshot.target.id").alias("host_id"), f"e.{name}.*")
        fill = {"string": F.lit(""), "boolean": F.lit(False), "int": F.lit(0), "bigint": F.lit(0)}
        out[name] = rows.withColumns({c: F.coalesce(c, fill[k].cast(k)) for c, k in rows.dtypes if k in fill and c != "host_id"} | {c: F.coalesce(c, F.create_map().cast(k)) for c, k in rows.dtypes if k.startswith("map")})
    return out


def fold(parts: list[DataFrame]) -> DataFrame:
    """SRC-04: module results as one table; nothing is replaced, duplicates stay."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
