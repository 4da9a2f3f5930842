"""Predicates on account, host and package names (FN-01 to FN-05, FN-11, FN-16, FN-20)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names and words that decide.
SHELLS = "bash sh zsh ksh ksh93 csh tcsh fish dash ash busybox powershell pwsh cmd".split()
DAEMONS = """nobody daemon bin sys sync games man lp mysql redis nginx apache postgres postgresql mongodb rabbitmq elasticsearch tomcat jenkins
git svn www-data sshd nogroup tcpdump audit nfsnobody docker lxd systemd-network avahi cups mail news uucp proxy list irc gnats backup operator""".split()
DAEMON_SUFFIXES = "nologin _svc -svc svc _service -service service dovecot sshd messagebus systemd- _user -user".split()
ROLE_WORDS = """admin administrator system sys sysadmin root user users account accounts unprivileged privileged service daemon nobody operator
support build builder ci cd deploy deployment devops bot server web www www-data mail ftp dns dhcp database postgres postgresql mysql redis
elasticsearch shell session login default guest test info network security audit log logs video audio games proxy list irc gnats backup sync man
lp public private shared local""".split()
HOST_WORDS = """pc laptop desktop workstation server srv host node vm vbox kvm ec2 gcp azure aws local build dev prod test staging ci runner cijob
ubuntu debian kali fedora mac win apple windows linux android termux docker k8s kube minikube raspberrypi pi wsl vagrant qemu vmware oracle user
admin root tmp temp sys system""".split()
GIVEN_NAMES = """amir ali anna ben sara sarah mary john james peter david michael yusuf fatima zainab khadija maryam ibrahim hassan hussain umar
usman aisha layla omar karim noor""".split()
#: Repository ecosystems of a package provider, where they differ from it; no ecosystem exempts the provider.
ECOSYSTEMS = {"dpkg": ["apt"], "rpm": ["dnf", "yum"], "brew": ["brew"], "brew-cask": ["brew"], "termux-pkg": ["termux"], "pkgutil": [], "port": []}


def basename(path: Column) -> Column:
    return F.substring_index(F.regexp_replace(path, "/+$", ""), "/", -1)


def interactive_shell(base: Column) -> Column:
    """FN-01."""
    return base.isin(*SHELLS)


def daemon_name(name: Column) -> Column:
    """FN-03: a known name, a known ending, or a digit at the end."""
    low = F.lower(name)
    return low.isin(*DAEMONS) | low.rlike(f"({'|'.join(DAEMON_SUFFIXES)}|[0-9])$")


def service_identity(service: Column, classification: Column, name: Column, uid: Column) -> Column:
    """FN-02."""
    number = uid.try_cast("long")
    return service | classification.isin("service", "dormant", "unexpected") | daemon_name(name) | F.coalesce((number > 0) & (number < 500), F.lit(False))


def looks_like_role(text: Column) -> Column:
    """FN-04: every word is a role word, once its outer punctuation is off; no word is no role."""
    words = F.filter(F.split(F.lower(text), "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "")
    return (F.size(words) > 0) & F.forall(words, lambda w: F.btrim(w, F.lit(",;()[]")).isin(*ROLE_WORDS))


def identity_shaped(token: Column) -> Column:
    """FN-05: no digit, a part that is no host word, and either two parts or a given name."""
    low = F.lower(F.trim(token))
    parts = F.filter(F.split(low, "[^a-z0-9]+"), lambda p: p != "")
    own = F.filter(parts, lambda p: ~p.isin(*HOST_WORDS))
    return ~low.rlike("[0-9]") & (F.size(own) > 0) & ((F.size(parts) >= 2) | F.coalesce(F.get(own, F.lit(0)).isin(*GIVEN_NAMES), F.lit(False)))


def internal_namespace(name: Column) -> Column:
    """FN-11: the first part in upper case, or else what stands before a dot or an underscore; empty if there is none."""
    capital = F.get(F.filter(F.split(name, "[-_.]"), lambda p: p.rlike("^[A-Z]")), F.lit(0))
    labels = F.split(name, "\\.")
    dotted = F.when((F.size(labels) >= 2) & F.element_at(labels, -1).rlike("^[A-Za-z]{2,24}$") & (labels[0] != ""), labels[0])
    under = F.when(F.instr(name, "_") > 1, F.substring_index(name, "_", 1))
    return F.coalesce(capital, dotted, under, F.lit(""))


def ecosystems(provider: Column) -> Column:
    """FN-16: the ecosystems whose sources serve a package provider."""
    out = F.array(provider)
    for name, kinds in ECOSYSTEMS.items():
        out = F.when(provider == name, F.array(*map(F.lit, kinds)).cast("array<string>")).otherwise(out)
    return out


def served_providers(source: Column) -> Column:
    """FN-16 the other way: the package providers that a source of this ecosystem serves."""
    known = [F.when(source.isin(*kinds), F.lit(name)) for name, kinds in ECOSYSTEMS.items() if kinds]
    return F.array_compact(F.array(*known, F.when(~source.isin(*ECOSYSTEMS), source)))


def normalize_token(value: Column) -> Column:
    """FN-20."""
    return F.lower(F.trim(value))


def unique(values: Column) -> Column:
    """FN-20: first-seen values, empty ones dropped."""
    return F.array_distinct(F.filter(values, lambda v: v != ""))
