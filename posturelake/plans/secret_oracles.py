"""DuckDB SQL for the secret scan and the tests of values and keys, stated apart from the column functions that it checks."""

from __future__ import annotations

LINES = "SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents"

_SET = r"""["'']?\s*[=:]\s*["'']?([^\s"'']+)"""
#: (type, whether placeholders do not count, pattern of field and value), in the order in which they decide.
_CASES = (
    ("private_key", False, r"((-{5}BEGIN ((RSA|DSA|EC|OPENSSH|PGP|ENCRYPTED) )?PRIVATE KEY-{5}))"),
    ("cicd_credential", False, r"(gh[pousr]_)([[:alnum:]]{36})"),
    ("cicd_credential", False, r"(github_pat_)(\w{50,})"),
    ("cicd_credential", False, r"(glpat-)([\w-]{16,})"),
    ("jwt", False, r"(eyJ[\w-]{5,})\.([\w-]{5,}\.[\w-]{5,})"),
    ("cloud_credential", False, r"(A[KS]IA)([0-9A-Z]{16})"),
    ("database_credential", False, r"""(\w+)\s*[=:]\s*["'']?(?:postgres|postgresql|mysql|mongodb|redis|amqp)(?:\+[a-z]+)?://[^:/@\s]*:([^@\s]{6,})@"""),
    ("cloud_credential", True, r"(?i)(aws_secret_access_key|aws_session_token|azure_client_secret|gcp_private_key)" + _SET),
    ("password", True, r"(?i)([\w-]*(?:passw(?:or)?d|pwd))" + _SET),
    ("api_key", True, r"(?i)([\w-]*api[_-]?key)" + _SET),
    ("token", True, r"(?i)([\w-]*(?:token|secret))" + _SET),
)


def _weak(v: str) -> str:
    return (
        f"(strlen({v}) < 8 OR replace({v}, left({v}, 1), '') = '' OR regexp_matches({v}, '^(0123456789|123456789?0?)$') OR regexp_matches({v}, '^([$<%]|[{{]{{2}})') "
        f"OR regexp_matches(lower({v}), 'changeme|your[_-]|^example|redacted|placeholder') OR lower({v}) IN ('true', 'false', 'none', 'null', 'prompt', 'ask', '-', '--', '0', '1'))"
    )


def _scan() -> str:
    tried = ", ".join(f"regexp_extract(line, '{p}', 1) AS f{n}, regexp_extract(line, '{p}', 2) AS v{n}" for n, (_, _, p) in enumerate(_CASES))
    arms = [(f"WHEN v{n} <> ''" + (f" AND NOT {_weak(f'v{n}')}" if named else ""), n, kind) for n, (kind, named, _) in enumerate(_CASES)]
    kind, field, length = (" ".join(f"{when} THEN {give(n, k)}" for when, n, k in arms) for give in (lambda n, k: f"'{k}'", lambda n, k: f"lower(f{n})", lambda n, k: f"strlen(v{n})"))
    return f"SELECT * FROM (SELECT doc_id, line_no AS line, CASE {kind} END AS type, CASE {field} END AS field, CAST(CASE {length} END AS INTEGER) AS length FROM (SELECT doc_id, line_no, {tried} FROM ({LINES}) WHERE strlen(line) <= 4096)) WHERE type IS NOT NULL"


SCAN = _scan()


def shaped(v: str) -> str:
    """SQL that tells whether a value looks like a secret."""
    starts = r"^ *(-{5}begin|gh[pousr]_|github_pat_|glpat-|[sp]k_(live|test)_|xox[bpas]-|ya29[.]|eyj|a[ks]ia)"
    forms = "|".join((
        r"\ba[ks]ia[0-9a-z]{16}\b", r"\bgh[pousr]_[0-9a-z]{36}\b", r"\bgithub_pat_\w{50,}\b", r"\bglpat-[\w-]{16,}\b", r"-{5}begin ((rsa|dsa|ec|openssh|pgp|encrypted) )?private key-{5}",
        r"\beyj[\w-]{5,}[.][\w-]{5,}", r"\baiza[\w-]{35}\b", r"\bxox[abprs]-[0-9a-z-]{10,}\b", r"\b[spr]k_(live|test)_[0-9a-z]{16,}\b", r"\bya29[.][\w-]{20,}\b", "-{5}begin certificate-{5}",
    ))
    named = r"(?is)\b(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|secret[_-]?access[_-]?key|client[_-]?secret|private[_-]?key|auth[_-]?token|bearer)\b\s*[=:]\s*(.*)$"
    left = f"trim(ltrim(regexp_extract({v}, '{named}', 1), '\"''` ' || chr(9)))"
    return f"({v} <> '' AND {v} <> '<redacted>' AND (regexp_matches({v}, '(?i){starts}') OR regexp_matches({v}, '(?is){forms}') OR strlen({left}) >= 8))"


def key_name(v: str) -> str:
    return f"regexp_matches(lower({v}), '^(token|passw(or)?d|key|private|auth)|secret|password|credential|apikey')"
