"""Row predicates shared by the detectors.

Every predicate takes a *lower-cased* text column (``msg`` of the prepared log frame)
unless it says otherwise, stays inside whole-stage codegen, and treats null as no match.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The keyword lists that decide which log lines a detector counts.
LOGIN_WORDS = ("login", "accepted")
FAILED_LOGIN_TARGETS = ("login", "password")
SUCCESS_WORDS = ("accepted", "successful")
ERROR_WORDS = ("error", "fail", "exception", "denied", "forbidden")
COMMAND_WORDS = ("sudo", "exec", "command", "shell", "bash")
SUSPICIOUS_COMMANDS = ("rm -rf", "chmod 777", "wget", "curl", "nc ", "netcat")
PRIVILEGE_WORDS = ("sudo", "su ", "runas", "elevated", "privilege", "admin")
OFF_HOURS_WORDS = ("login", "access", "file", "command", "execute")
FILE_WORDS = ("file", "open", "read", "write", "access")
NETWORK_WORDS = ("connection", "connect", "network", "tcp", "udp", "http", "https", "dns", "port")
NETWORK_KEYS = ("protocol", "source_port", "dest_port")
WEB_PORTS = (80, 443, 8080, 8443)


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def any_contains(text: Column, words: Iterable[str]) -> Column:
    """True when the text holds at least one of the words; plain substring search, no regex."""
    return F.coalesce(any_of(text.contains(w) for w in words), F.lit(False))


def is_login(msg: Column) -> Column:
    return any_contains(msg, LOGIN_WORDS)


def is_failed_login(msg: Column) -> Column:
    return any_contains(msg, ("failed",)) & any_contains(msg, FAILED_LOGIN_TARGETS)


def is_successful_login(msg: Column) -> Column:
    return any_contains(msg, SUCCESS_WORDS) & any_contains(msg, ("login",))


def is_error(msg: Column, words: Iterable[str] = ERROR_WORDS) -> Column:
    return any_contains(msg, words)


def is_command(msg: Column) -> Column:
    return any_contains(msg, COMMAND_WORDS)


def has_suspicious_command(text: Column) -> Column:
    """Case follows the column given: pass ``msg`` to ignore case, the raw text to respect it."""
    return any_contains(text, SUSPICIOUS_COMMANDS)


def first_word(text: Column, words: Iterable[str]) -> Column:
    """The first word of the list that the text contains, else null."""
    words = list(words)
    chain = F.when(text.contains(words[0]), F.lit(words[0]))
    for w in words[1:]:
        chain = chain.when(text.contains(w), F.lit(w))
    return chain


def is_network(msg: Column, fields: Column) -> Column:
    by_key = any_of(F.coalesce(F.map_contains_key(fields, k), F.lit(False)) for k in NETWORK_KEYS)
    return any_contains(msg, NETWORK_WORDS) | by_key


def is_off_hours(ts: Column, start: int = 22, end: int = 6) -> Column:
    h = F.hour(ts)
    return (h >= start) | (h < end)


def text_search(term: str) -> Column:
    """Case-insensitive substring in message or raw; nulls never match."""
    q = term.lower()
    return F.coalesce(F.lower("message").contains(q), F.lit(False)) | F.coalesce(
        F.lower("raw").contains(q), F.lit(False)
    )


def odd_web_port(protocol: Column, port: Column) -> Column:
    return F.lower(protocol).isin("http", "https") & ~port.isin(*WEB_PORTS)


def not_expired(expires_at: Column, as_of: Column) -> Column:
    return expires_at.isNull() | (expires_at > as_of)
