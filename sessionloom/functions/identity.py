"""Personal identity in text: home paths, email addresses, known user names."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from sessionloom.functions.secrets import redact_secrets
from sessionloom.functions.text import let

USER = "[USER]"
EMAIL = "[EMAIL]"
MIN_USERNAME_LENGTH = 4
PROJECT_KEY_PREFIX = "_project-"

# Logins that name a system, not a person.
DEFAULT_LOGINS = (
    "ubuntu", "ec2-user", "admin", "administrator", "root", "user", "users",
    "shared", "dev", "node", "app", "runner", "vagrant", "pi", "centos",
    "debian", "fedora", "azureuser", "cloud-user", "opc", "git", "guest",
)
# Endings of internal host names, which are not addresses.
INTERNAL_ENDINGS = ("internal", "local", "localdomain", "lan", "arpa")

# What a home path, an encoded home path and an address look like.
_LOGIN = "[A-Za-z0-9][A-Za-z0-9._-]*"
_LOGIN_CHARS = "[A-Za-z0-9._-]"
# The address is taken whole or not at all: the atomic group keeps an internal
# host from being cut back to a shorter address that would pass.
_ADDRESS = (
    r"(?<![A-Za-z0-9._%+\-\\@])(?>[A-Za-z0-9][A-Za-z0-9._%+\-]*@[A-Za-z0-9.\-]+\.[A-Za-z]{2,24})"
    rf"(?<!\.(?i:{'|'.join(INTERNAL_ENDINGS)}))"
)


def kept_logins(extra: Iterable[str] = ()) -> tuple[str, ...]:
    """Default logins plus the caller's own stop-list, lower case."""
    added = {name.strip().lower() for name in extra if name.strip()}
    return DEFAULT_LOGINS + tuple(sorted(added - set(DEFAULT_LOGINS)))


def usable_usernames(names: Iterable[str], stoplist: Iterable[str] = ()) -> tuple[str, ...]:
    """Names worth replacing as bare words: long enough, not a default login, longest first."""
    kept = set(kept_logins(stoplist))
    fit = {n for n in names if n and len(n) >= MIN_USERNAME_LENGTH and n.lower() not in kept}
    return tuple(sorted(fit, key=lambda n: (-len(n), n)))


def _one_of(words: Sequence[str]) -> str:
    return "|".join(re.escape(word) for word in words)


def _home_path(logins: Sequence[str]) -> str:
    return rf"(/(?:home|Users)/)(?!(?i:{_one_of(logins)})(?!{_LOGIN_CHARS})){_LOGIN}"


def _replace_counted(text: Column, worth_trying: Column, regex: str, replacement: str) -> Column:
    """struct(text, n) for one expression; texts that cannot match skip the expression."""
    return F.when(
        worth_trying,
        F.struct(
            F.regexp_replace(text, regex, replacement).alias("text"), F.regexp_count(text, F.lit(regex)).alias("n")
        ),
    ).otherwise(F.struct(text.alias("text"), F.lit(0).alias("n")))


def redact_emails(text: Column) -> Column:
    """struct(text, n) with every address replaced."""
    return _replace_counted(text, text.contains("@"), _ADDRESS, EMAIL)


def redact_home_paths(text: Column, stoplist: Iterable[str] = ()) -> Column:
    """struct(text, n) with the login in every home path replaced, default logins kept."""
    likely = text.contains("/home/") | text.contains("/Users/")
    return _replace_counted(text, likely, _home_path(kept_logins(stoplist)), "$1[USER]")


def _redact_names(found: Column, names: Sequence[str]) -> Column:
    """Whole-word user names in the given order; a fold keeps the plan small for any number of names.

    The expression starts with the name itself, which the regex engine can search
    for; what stands before it is tested afterwards.
    """
    edge = "[A-Za-z0-9_]"
    table = F.array(
        *[
            F.struct(
                F.lit(n).alias("name"), F.lit(rf"{re.escape(n)}(?<!{edge}{re.escape(n)})(?!{edge})").alias("regex")
            )
            for n in names
        ]
    )

    def step(state: Column, entry: Column) -> Column:
        text = state["text"]
        shrink = F.octet_length(entry["name"]) - len(USER)

        def counted(done: Column) -> Column:
            # Every replacement changes the length alike, so the lengths give the count.
            by_length = ((F.octet_length(text) - F.octet_length(done)) / shrink).cast("int")
            n = F.when(shrink != 0, by_length).otherwise(F.regexp_count(text, entry["regex"]))
            return F.struct(done.alias("text"), (state["n"] + n).alias("n"))

        replaced = let(F.regexp_replace(text, entry["regex"], F.lit(USER)), counted)
        return F.when(text.contains(entry["name"]), replaced).otherwise(state)

    return F.aggregate(table, found, step)


def redact_identity(text: Column, usernames: Sequence[str] = (), stoplist: Iterable[str] = ()) -> Column:
    """struct(text, n): home paths, then addresses, then bare user names, longest first."""
    stop = tuple(stoplist)
    names = usable_usernames(usernames, stop)

    def addresses(homes: Column) -> Column:
        return let(
            redact_emails(homes["text"]),
            lambda m: F.struct(m["text"].alias("text"), (homes["n"] + m["n"]).alias("n")),
        )

    found = let(redact_home_paths(text, stop), addresses)
    return _redact_names(found, names) if names else found


def redact_text(
    text: Column, salt: bytes, usernames: Sequence[str] = (), stoplist: Iterable[str] = ()
) -> Column:
    """struct(text, secrets, identity): secrets first, then personal identity, with both counts."""
    return let(
        redact_secrets(text, salt),
        lambda s: let(
            redact_identity(s["text"], usernames, stoplist),
            lambda i: F.struct(
                i["text"].alias("text"), F.size(s["spans"]).alias("secrets"), i["n"].alias("identity")
            ),
        ),
    )


def redact_path_token(token: Column, usernames: Sequence[str] = (), stoplist: Iterable[str] = ()) -> Column:
    """struct(text, n) for a storage or project field, including dash-encoded home paths."""
    logins = _one_of(kept_logins(stoplist))
    encoded = rf"(^|-)(home|Users)-(?!(?i:{logins})(?=-|$)|\[USER\](?=-|$))[^-]+"

    def dashed(plain: Column) -> Column:
        done = _replace_counted(plain["text"], ~plain["text"].startswith(PROJECT_KEY_PREFIX), encoded, "$1$2-[USER]")
        return let(done, lambda d: F.struct(d["text"].alias("text"), (plain["n"] + d["n"]).alias("n")))

    return let(redact_identity(token, usernames, stoplist), dashed)
