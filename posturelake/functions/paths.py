"""Predicates on paths, modes and sizes (FN-06 to FN-10, FN-13 to FN-15, FN-19, PRS-32, PRS-33)."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .names import basename

# Places and names that decide.
SENSITIVE = ["/etc/", "/usr/bin/", "/usr/sbin/", "/usr/lib/", "/bin/", "/sbin/", "/lib/", "/boot/", "/opt/", "/usr/local/bin/", "/usr/local/sbin/"]
SENSITIVE_WINDOWS = ["c:/windows/", "c:/program files/", "c:/programdata/", "c:/users/"]
CREDENTIAL_DIRS = ["/.ssh", "/.aws", "/.azure", "/.gnupg", "/.kube", "/.docker", "/.config/gcloud", "/.termux", "/.password-store", "/credentials", "/.netrc"]
ARTIFACT_DIRS = ["logs", "log", "target", "build", "dist", "out", "output", "reports", "coverage", "tmp", "cache", ".next", "node_modules", "vendor"]
TEMPORARY = ["/tmp/", "/var/tmp/", "/dev/shm/", "/private/var/folders/"]
USER_WRITABLE = ["/home/", "/users/", "/export/home/", "/var/folders/"]
KEY_NAMES = ["id_rsa", "id_ed25519", "id_ecdsa", "id_dsa"]
CREDENTIAL_NAMES = ["credentials", "secrets", ".netrc", ".pgpass", ".git-credentials", "access_tokens"]
SIZE_UNITS = {"TiB": 2.0**40, "GiB": 2.0**30, "MiB": 2.0**20, "KiB": 2.0**10, "TB": 1e12, "GB": 1e9, "MB": 1e6, "KB": 1e3, "T": 2.0**40, "G": 2.0**30, "M": 2.0**20, "K": 2.0**10, "B": 1.0}
RULE_UNITS = ("KiB", "MiB", "GiB")


def _starts(value: Column, prefixes: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [value.startswith(p) for p in prefixes])


def _holds(value: Column, parts: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [value.contains(p) for p in parts])


def _ends(value: Column, suffixes: list[str]) -> Column:
    return value.rlike("(" + "|".join(map(re.escape, suffixes)) + ")$")


def apart(value: Column) -> Column:
    """``value``, by a higher-order function that adds nothing: Spark compiles a projection that has one in many small methods, not as one of a whole stage, which can be more than the JVM compiles."""
    return F.get(F.filter(F.array(value), lambda x: x.isNotNull()), F.lit(0))


def octal(mode: Column) -> Column:
    """The bits of an octal mode; null for what is none."""
    clean = F.trim(mode)
    return F.when(clean.rlike("^[0-7]{1,20}$"), F.conv(clean, 8, 10).cast("long"))


def mode_is_restricted(mode: Column) -> Column:
    """FN-06: nobody but the owner has a right; false for an empty or bad mode."""
    return F.when(F.trim(mode) == "0", mode != "").otherwise(F.coalesce(octal(mode).bitwiseAND(0o077) == 0, F.lit(False)))


def mode_flags(mode: Column) -> dict[str, Column]:
    """PRS-33: rights of group and others from an octal mode; null for a bad one."""
    return bits_flags(octal(mode))


def bits_flags(bits: Column) -> dict[str, Column]:
    """PRS-33 from the mode's number, for callers that have parsed it once."""
    return {name: bits.bitwiseAND(mask) != 0 for name, mask in (("group_readable", 0o040), ("group_writable", 0o020), ("world_readable", 0o004), ("world_writable", 0o002))}


def mode_text(mode: Column) -> Column:
    """PRS-33: an octal mode as ``rwxr-x---``."""
    return bits_text(octal(mode))


def bits_text(bits: Column) -> Column:
    """PRS-33 from the mode's number."""
    return F.concat(*[F.when(bits.bitwiseAND(1 << (8 - i)) != 0, "rwx"[i % 3]).otherwise("-") for i in range(9)])


def text_mode(text: Column) -> Column:
    """PRS-33, back: ``rwxr-x---`` as an octal mode of four digits."""
    digit = lambda g: sum((F.when(F.substring(text, 3 * g + 1 + i, 1) != "-", 4 >> i).otherwise(0) for i in range(3)), F.lit(0))
    return F.concat(F.lit("0"), *[digit(g).cast("string") for g in range(3)])


def readable_text(mode: Column) -> Column:
    """A mode of exactly nine letters that lets group or others read."""
    return (F.char_length(mode) == 9) & ((F.substring(mode, 4, 1) != "-") | (F.substring(mode, 7, 1) != "-"))


def sensitive_path(path: Column) -> Column:
    """FN-07."""
    low = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    return _starts(low, SENSITIVE + SENSITIVE_WINDOWS + ["/" + p for p in SENSITIVE_WINDOWS])


def credential_dir(path: Column) -> Column:
    """FN-08."""
    return _ends(F.lower(path), CREDENTIAL_DIRS)


def history_path(path: Column) -> Column:
    """FN-09."""
    return F.lower(basename(path)).rlike(r"(hist|history|history\.txt)$")


def artifact_dir(path: Column) -> Column:
    """FN-10."""
    low = F.lower(path)
    return basename(low).isin(*ARTIFACT_DIRS) | low.endswith("/logs") | low.endswith("/.logs")


def temporary_path(path: Column) -> Column:
    """FN-13."""
    low = F.lower(path)
    return _starts(low, [*TEMPORARY, "c:\\windows\\temp"]) | low.contains("\\temp\\")


def user_writable_path(path: Column) -> Column:
    """FN-13."""
    low = F.lower(path)
    return temporary_path(path) | _starts(low, [*USER_WRITABLE, "c:\\users\\"]) | low.contains("appdata\\") | low.contains("appdata/")


def private_key_file(path: Column) -> Column:
    """FN-14."""
    low = F.lower(basename(path))
    beside = path.contains("/.ssh/") & ~low.contains(".pub") & (low.contains("_key") | ~low.contains("config"))
    return _holds(low, KEY_NAMES) | low.startswith("ssh_host_") | beside


def credential_file(path: Column) -> Column:
    """FN-14."""
    low = F.lower(basename(path))
    return _holds(low, CREDENTIAL_NAMES) | low.isin(".npmrc", ".pypirc", ".env") | low.startswith(".env.")


def file_asset(kind: Column, entry_type: Column) -> Column:
    """FN-15."""
    return (kind == "file_exposure") & (entry_type == "file")


def dir_asset(kind: Column, entry_type: Column) -> Column:
    """FN-15."""
    return (kind == "file_exposure") & (entry_type == "directory")


def size_bytes(size: Column) -> Column:
    """PRS-32: bytes of ``1.5 MiB``, ``12kb`` and the like; units in any case, null for what is no size."""
    clean = F.trim(size)
    pattern = rf"(?i)^([0-9]+(?:\.[0-9]+)?)\s*({'|'.join(SIZE_UNITS)})?$"
    factor = F.lit(1.0)
    for unit, times in SIZE_UNITS.items():
        factor = F.when(F.lower(F.regexp_extract(clean, pattern, 2)) == unit.lower(), times).otherwise(factor)
    return F.floor(F.regexp_extract(clean, pattern, 1).try_cast("double") * factor).cast("long")


def rule_bytes(size: Column) -> Column:
    """PRS-32 as rules read it: whole numbers, with KiB, MiB or GiB or without a unit; 0 for anything else."""
    pattern = rf"^([0-9]{{1,15}})\s*({'|'.join(RULE_UNITS)})?$"
    clean, factor = F.trim(size), F.lit(1).cast("long")
    for unit in RULE_UNITS:
        factor = F.when(F.regexp_extract(clean, pattern, 2) == unit, int(SIZE_UNITS[unit])).otherwise(factor)
    return F.coalesce(F.regexp_extract(clean, pattern, 1).try_cast("long") * factor, F.lit(0)).cast("long")


BYTE_UNITS = ("KiB", "MiB", "GiB", "TiB", "PiB", "EiB")


def human_bytes(size: Column, largest: str = "EiB") -> Column:
    """FN-19: powers of 1024 with one decimal up to the ``largest`` unit; plain bytes below."""
    out = F.concat(size.cast("string"), F.lit(" B"))
    for power, unit in enumerate(BYTE_UNITS[: BYTE_UNITS.index(largest) + 1], 1):
        out = F.when(size >= 1024**power, F.concat(F.format_string("%.1f", F.bround(size / float(1024**power), 1)), F.lit(" " + unit))).otherwise(out)
    return out
