"""Identity correlation: signals to tokens to connected components to scored identities (COR-01 to COR-11).

Tokens and signals form a bipartite graph, so that a token that many signals share costs one edge each and no pairs. The scope is a host; with
``scope=None`` the same rules run over the fleet.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut
from ..plans.numbering import number_rows
from .components import components

# Words that tell nobody apart, endings that make a word generic, and public domain endings.
COMMON_WORDS = """admin administrator all api app apps bin build builder cache cd ci client cloud code common computer core data default deploy
desktop dev developer devops dist docker docs downloads etc example git group guest home host hostname info internal lab lib local log logs
machine mail main media mnt my new node office opt private project public root run sbin server service services shared shell srv ssh src sys
system task temp test tmp usr var user users web win work workstation www prod production staging qa uat cluster k8s kube vagrant vm virtualbox
hyperv console terminal ubuntu debian fedora centos arch alpine kali mint windows apple macbook macos android iphone pc notebook imac external
backup edge primary secondary node1 node2 srv1 srv2 web1 web2 app1 app2 api1 db1""".split()
GENERIC_ENDINGS = """server servers service services host hosts node nodes cache proxy gateway ingress controller daemon client clients worker
workers machine machines device devices database container cluster runtime instance instances""".split()
PUBLIC_SUFFIXES = """com org net io dev git co edu gov mil int ac me app ai sh cloud uk de fr jp cn us ca eu info biz local localhost internal lan
home corp""".split()
TYPE_RANK = {"username": 0, "account": 0, "home": 1, "email": 2, "key_comment": 3, "hostname": 4, "remote": 5, "org": 6, "project": 7, "device": 7}
BRIDGES = ("name", "email")
MAX_GROUPS = 50

_TOKEN = "array<struct<kind:string,token:string>>"


def distinctive(token: Column) -> Column:
    """COR-03: over two bytes, not only digits, no common word and no generic ending."""
    return (F.octet_length(token) > 2) & ~token.rlike("^[0-9]*$") & ~token.isin(*COMMON_WORDS) & ~token.rlike(f"^(?s:.+)({'|'.join(GENERIC_ENDINGS)})$")


def tokens(kind: Column, value: Column) -> Column:
    """COR-02: array of (kind, token) of a signal; email, hostname and the like give several."""
    low = F.lower(F.trim(value))
    parts = F.filter(F.split(low, r"[-_. +@\\/]"), lambda p: p != "")
    one = lambda k, t: F.array(F.struct(F.lit(k).alias("kind"), t.alias("token")))
    none = F.array().cast(_TOKEN)
    if_distinct = lambda k, t: F.when(distinctive(t), one(k, t)).otherwise(none)
    all_of = lambda k, ps: F.transform(F.filter(ps, distinctive), lambda p: F.struct(F.lit(k).alias("kind"), p.alias("token")))
    leaf = F.substring_index(F.replace(low, F.lit("\\"), F.lit("/")), "/", -1)
    local, domain = F.substring_index(low, "@", 1), F.substring(low, F.instr(low, "@") + 1, F.char_length(low))
    mail = F.when((F.instr(low, "@") > 1), F.concat(one("email", low), if_distinct("name", local), if_distinct("org", domain))).otherwise(none)
    own = F.filter(parts, lambda p: ~p.isin(*PUBLIC_SUFFIXES))
    remote = F.concat(F.when(F.size(own) >= 2, one("org", F.get(own, F.lit(1)))).otherwise(none), all_of("name", F.slice(own, 3, F.greatest(F.size(own), F.lit(1)))))
    return (
        F.when(kind.isin("username", "account"), if_distinct("name", low))
        .when(kind == "home", if_distinct("name", leaf))
        .when(kind.isin("email", "key_comment"), mail)
        .when(kind == "hostname", all_of("name", parts))
        .when(kind == "remote", remote)
        .when(kind == "org", if_distinct("org", low))
        .when(kind == "project", all_of("proj", parts))
        .when(kind == "device", all_of("device", parts))
        .otherwise(none)
    )


def kept_signals(signals: DataFrame, scope: str | None = "host_id") -> DataFrame:
    """COR-01 and COR-04: signals that aren't redacted and have tokens that bridge, with ``tokens``, ``scope`` and ``signal``, a key of equal signals."""
    bridging = F.filter(tokens(F.col("type"), F.col("value")), lambda t: t["kind"].isin(*BRIDGES))
    at = F.col(scope).cast("string") if scope else F.lit("")
    s = signals.where("NOT redacted").withColumn("tokens", F.transform(bridging, lambda t: F.concat_ws(":", t["kind"], t["token"]))).withColumn("scope", at)
    return s.where(F.size("tokens") > 0)


def signal_counts(signals: DataFrame, scope: str = "host_id") -> DataFrame:
    """COR-01 and COR-04: redacted, unlinked and kept signals per scope."""
    linked = F.exists(tokens(F.col("type"), F.col("value")), lambda t: t["kind"].isin(*BRIDGES))
    return signals.groupBy(scope).agg(F.count_if("redacted").alias("redacted"), F.count_if(~F.col("redacted") & ~linked).alias("unlinked"), F.count_if(~F.col("redacted") & linked).alias("kept"))


def edges(kept: DataFrame) -> DataFrame:
    """COR-05: tokens of one signal are linked to its first; equal tokens are one node."""
    node = lambda t: F.concat(F.col("scope"), F.lit("\x00"), t)
    return kept.select(node(F.col("tokens")[0]).alias("src"), F.explode("tokens").alias("t"), "scope").select("src", node(F.col("t")).alias("dst")).distinct()


def components_of(kept: DataFrame) -> DataFrame:
    """COR-06: ``kept`` with ``component``, the least node of its component."""
    roots = components(edges(kept))
    return kept.withColumn("node", F.concat(F.col("scope"), F.lit("\x00"), F.col("tokens")[0])).join(roots, "node").drop("node")


def _rank() -> Column:
    out = F.lit(99)
    for kind, rank in TYPE_RANK.items():
        out = F.when(F.col("type") == kind, rank).otherwise(out)
    return out


def _members(kept: DataFrame) -> DataFrame:
    rows = kept.select("scope", "component", "type", "value", "source", "domain")
    return number_rows(rows, [F.col(x) for x in ("type", "value", "source", "domain")], within=["scope", "component"], out="place").withColumn("place", F.col("place") + 1)


def identity_members(signals: DataFrame, scope: str | None = "host_id") -> DataFrame:
    """COR-10: (scope, component, place, type, value, source, domain), the signals of every identity as rows, by their place from 1. An identity of any size is numbered by many tasks."""
    return _members(components_of(cut(kept_signals(signals, scope))))


def identities(signals: DataFrame, scope: str | None = "host_id", min_strength: int = 0, max_groups: int = MAX_GROUPS, members: int | None = 0) -> DataFrame:
    """COR-07 to COR-11: identities of each scope, the strongest first; ``rank`` counts from 1 up to ``max_groups``.

    ``members`` adds ``signals``, the first so many of an identity's signals or, with None, all of them in one row; ``identity_members`` has them as rows.
    """
    kept = components_of(cut(kept_signals(signals, scope)))
    listed = members != 0
    kept = cut(kept) if listed else kept
    order = F.struct(_rank().alias("rank"), "type", "value", "source")
    plural = lambda n, word: F.concat(F.col(n).cast("string"), F.lit(" " + word), F.when(F.col(n) == 1, "").otherwise("s"))
    lists = [F.array_sort(F.collect_set(F.when(F.col("source") != "", F.col("source")))).alias("sources"), F.array_sort(F.collect_set("domain")).alias("domains")]
    out = kept.groupBy("scope", "component").agg(
        F.coalesce(F.min_by(F.when(_rank() < 99, F.col("value")), F.when(_rank() < 99, order)), F.lit("")).alias("canonical"), F.count("*").alias("signal_count"),
        F.count_distinct("type").alias("types"), F.count_distinct("source").alias("all_sources"), F.count_distinct("domain").alias("n_domains"), *lists)
    share = lambda n: F.least(F.lit(1.0), n / 3.0)
    strength = F.least(F.floor(100 * (0.5 * F.col("types") / 8.0 + 0.3 * share(F.size("sources")) + 0.2 * share(F.col("n_domains"))) + 0.5), F.lit(100))
    ident = F.concat(F.lit("ident-"), F.substring(F.sha2(F.array_join(F.concat(F.array("canonical"), F.col("sources")), "\x00"), 256), 1, 12))
    summary = F.concat(F.lit("Identity "), "canonical", F.lit(" is disclosed by "), plural("signal_count", "signal"), F.lit(" across "), plural("types", "kind"), F.lit(" of observation, from "), plural("all_sources", "source"), F.lit(" and "), plural("n_domains", "domain"), F.lit("."))
    out = out.withColumns({"strength": strength.cast("int"), "id": ident, "summary": summary}).where(F.col("strength") >= min_strength)
    if listed:
        told = _members(kept) if members is None else _members(kept).where(F.col("place") <= members)
        told = told.groupBy("scope", "component").agg(F.array_sort(F.collect_list(F.struct("place", "type", "value", "source", "domain"))).alias("signals"))
        out = out.join(told, ["scope", "component"])
    rank = F.row_number().over(Window.partitionBy("scope").orderBy(F.desc("strength"), "canonical", "id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= max_groups)
