"""Field extraction as Column expressions, and the prepared log frame the detectors share."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberwatch.functions import predicates as P

# Text shapes that decide what is extracted. (?U) gives \w, \d and \b their
# Unicode meaning, so that names with accents come out whole. What a match begins with is looked at
# before a word boundary, which is dear to test at every place of a long text.
IPV4 = r"(?U)(?=\d)\b(?:\d{1,3}\.){3}\d{1,3}\b"
USER_SHAPES = (r"(?U)user\s+(\w+)", r"(?U)User\s+(\w+)", r"(?U)for\s+(\w+)")
USER_WORDS = ("user", "User", "for")
PORT_SHAPE = r"(?iU)port[:\s]+(\d+)"
BYTES_SHAPE = r"(?iU)(\d+)\s*(bytes|KB|MB|GB)"
HASH_LENGTHS = (32, 40, 64)
HASH_KEYS = ("file_hash", "hash", "md5", "sha1", "sha256")
DOMAIN_SHAPE = r"(?U)\b(?:[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?\.)+[a-zA-Z]{2,}\b"
URL_SHAPE = r"(?U)https?://[^\s]+"
EMAIL_SHAPE = r"(?U)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
IGNORED_DOMAINS = ("localhost", "example.com", "test.com")
SIZE_WORDS = ("byte", "kb", "mb", "gb")
UNIT_FACTORS = {"bytes": 1, "kb": 1024, "mb": 1024**2, "gb": 1024**3}

JSON_MAP = T.MapType(T.StringType(), T.StringType())


def hash_shape(length: int) -> str:
    return rf"(?U)(?=[a-fA-F0-9]{{{length}}})\b[a-fA-F0-9]{{{length}}}\b"


def json_map(c: Column | str) -> Column:
    """JSON object text to map<string,string>; nested values stay JSON text, JSON null stays a key."""
    return F.from_json(c, JSON_MAP)


def has_key(fields: Column, key: str) -> Column:
    return F.coalesce(F.map_contains_key(fields, key), F.lit(False))


def non_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def or_unknown(c: Column) -> Column:
    return F.coalesce(non_empty(c), F.lit("unknown"))


def extract(text: Column, pattern: str, group: int = 0) -> Column:
    """First regex match or null (Spark gives '' for no match)."""
    return non_empty(F.regexp_extract(text, pattern, group))


def event_time(timestamp: Column, fields: Column) -> Column:
    return F.coalesce(timestamp.try_cast("timestamp"), fields["timestamp"].try_cast("timestamp"))


def source_ip(fields: Column, message_ip: Column) -> Column:
    """A present key wins even when its value is null; only then the first IPv4 of the message."""
    return (
        F.when(has_key(fields, "source_ip"), fields["source_ip"])
        .when(has_key(fields, "src_ip"), fields["src_ip"])
        .otherwise(message_ip)
    )


def user_name(fields: Column, message_user: Column) -> Column:
    return F.when(has_key(fields, "user"), fields["user"]).otherwise(message_user)


def dest_ip(fields: Column) -> Column:
    return F.coalesce(non_empty(fields["dest_ip"]), non_empty(fields["destination_ip"]))


def dest_port(fields: Column, message_port: Column) -> Column:
    """First key present decides, without falling through on null; 0 counts as absent."""
    port = (
        F.when(has_key(fields, "dest_port"), fields["dest_port"])
        .when(has_key(fields, "port"), fields["port"])
        .otherwise(message_port)
    )
    return F.nullif(port.try_cast("int"), F.lit(0))


def field_bytes(fields: Column) -> Column:
    return fields["bytes"].try_cast("bigint")


def transfer_bytes(fields: Column, amount: Column, unit: Column, honour_units: bool = True) -> Column:
    """Bytes of the record, else the first quantity found in the message."""
    found = non_empty(amount).try_cast("bigint")
    if honour_units:
        factor = F.coalesce(*[F.when(F.lower(unit) == u, F.lit(n)) for u, n in UNIT_FACTORS.items()])
        found = found * factor.cast("bigint")
    return F.when(has_key(fields, "bytes"), field_bytes(fields)).otherwise(found)


def event_type(msg: Column) -> Column:
    """Event type guessed from lower-cased text."""
    return (
        F.when(msg.contains("login") & msg.contains("failed"), "login_failed")
        .when(msg.contains("login"), "login_success")
        .when(msg.contains("error"), "error")
        .when(msg.contains("access"), "access")
        .otherwise("unknown")
    )


def error_category(msg: Column) -> Column:
    return (
        F.when(msg.contains("denied") | msg.contains("forbidden"), "access_denied")
        .when(msg.contains("exception"), "exception")
        .when(msg.contains("500") | msg.contains("503"), "server_error")
        .otherwise("other")
    )


def path_value(path: str, fields: str = "fields", extra: str = "extra") -> Column:
    """Dotted path to a Column: ``message``, ``normalized.a``, ``normalized.a.b``, ``metadata.x``."""
    head, _, rest = path.partition(".")
    if not rest:
        return F.col(head) if head in ("raw", "message", "appname") else F.lit(None).cast("string")
    if head not in ("normalized", "metadata"):
        return F.lit(None).cast("string")
    root = F.col(fields if head == "normalized" else extra)
    key, _, deeper = rest.partition(".")
    return F.get_json_object(root[key], "$." + deeper) if deeper else root[key]


def text_hashes(text: Column) -> Column:
    """MD5, SHA-1 and SHA-256 shaped tokens, in that order."""
    found = F.concat(*[F.regexp_extract_all(text, F.lit(hash_shape(n)), F.lit(0)) for n in HASH_LENGTHS])
    empty = F.array().cast("array<string>")  # most texts hold no token of even the shortest kind
    return F.when(text.rlike(f"[a-fA-F0-9]{{{min(HASH_LENGTHS)}}}"), found).when(text.isNotNull(), empty)


def record_hashes(fields: Column, message: Column) -> Column:
    """Hash candidates of a record: message tokens first, then the five hash keys."""
    empty = F.array().cast("array<string>")
    return F.array_compact(
        F.concat(
            F.coalesce(text_hashes(message), empty),
            F.array(*[fields[k] for k in HASH_KEYS]),
        )
    )


def indicators(fields: Column, text: Column, ip: Column) -> Column:
    """array<struct<type,value>> of distinct normalised indicators found in a record.

    ``text`` is the message, or the raw line where the message is empty. All fixed-shape
    matching happens once per record; ``explode`` the result to join it.
    """

    def tag(kind: str, values: Column) -> Column:
        return F.transform(values, lambda v: F.struct(F.lit(kind).alias("type"), F.lower(F.trim(v)).alias("value")))

    def found(shape: str) -> Column:
        return F.coalesce(F.regexp_extract_all(text, F.lit(shape), F.lit(0)), F.array().cast("array<string>"))

    domains = F.filter(found(DOMAIN_SHAPE), lambda d: ~d.isin(*IGNORED_DOMAINS))
    file_hash = F.when(F.length(fields["file_hash"]).isin(*HASH_LENGTHS), fields["file_hash"])
    every = F.concat(
        tag("ip", F.array(ip, fields["dest_ip"], fields["source_ip"])),
        tag("domain", F.concat(F.array(fields["domain"]), domains)),
        tag("url", F.concat(F.array(fields["url"]), found(URL_SHAPE))),
        tag("hash", F.concat(F.array(file_hash), *[found(hash_shape(n)) for n in HASH_LENGTHS])),
        tag("email", found(EMAIL_SHAPE)),
    )
    return F.array_distinct(F.filter(every, lambda i: i["value"].isNotNull() & (i["value"] != "")))


def flags(fields: Column, msg: Column, text: Column) -> dict[str, Column]:
    """Keyword verdicts on a record, decided once so that detectors need not read its text."""
    error = P.is_error(msg)
    return {
        "is_login": P.is_login(msg),
        "is_failed_login": P.is_failed_login(msg),
        "is_successful_login": P.is_successful_login(msg),
        "is_error": error,
        "error_kind": F.when(error, error_category(msg)),
        "is_command": P.is_command(msg),
        "is_suspicious": P.is_command(msg) & P.has_suspicious_command(msg),
        "command_word": P.first_word(text, P.SUSPICIOUS_COMMANDS),
        "is_privilege": P.any_contains(msg, P.PRIVILEGE_WORDS),
        "is_off_hours_kind": P.any_contains(msg, P.OFF_HOURS_WORDS),
        "is_file": P.any_contains(msg, P.FILE_WORDS),
        "is_dns": msg.contains("dns") | F.coalesce(fields["protocol"] == "dns", F.lit(False)),
        "event_kind": event_type(msg),
    }


def prepare(logs: DataFrame, honour_units: bool = True) -> DataFrame:
    """Log table to the frame the detectors read.

    Adds the parsed maps (``fields``, ``extra``), lower-cased ``msg``, nullable event time ``ts`` and
    what the detectors group or filter by: ``source_ip``, ``user``, ``contact_ip`` (the record's
    dest_ip), ``dest_ip`` (either spelling), ``dest_port``, ``protocol``, ``field_bytes``,
    ``transfer_bytes``, the flag ``network`` and the keyword verdicts of ``flags``. ``honour_units=False`` reads "5 GB" as 5 bytes.

    Store or persist the result before running detectors on it (``sources.tables.materialise``):
    a filter on a derived column is pushed down by substituting the column's definition, so over an
    unmaterialised frame each predicate would parse the JSON again. Stored, the detectors read the
    few columns they need instead of messages and maps.
    """
    base = logs.withColumns(
        {
            "fields": json_map("normalized"),
            "extra": json_map("metadata"),
            "msg": F.coalesce(F.lower("message"), F.lit("")),
        }
    )
    # Text is searched only where no key answers and a cheap substring test allows a match, and in
    # a projection of its own: inside the final CASE each regex would run for the test and again for
    # the value.
    fields, message, msg = F.col("fields"), F.col("message"), F.col("msg")
    no_ip = ~has_key(fields, "source_ip") & ~has_key(fields, "src_ip")
    no_port = ~has_key(fields, "dest_port") & ~has_key(fields, "port")
    has_size = ~has_key(fields, "bytes") & P.any_contains(msg, SIZE_WORDS)
    searched = base.withColumns(
        {
            "m_ip": F.when(no_ip, F.regexp_extract(message, IPV4, 0)),
            **{
                f"m_user{i}": F.when(
                    ~has_key(fields, "user") & message.contains(word), F.regexp_extract(message, shape, 1)
                )
                for i, (word, shape) in enumerate(zip(USER_WORDS, USER_SHAPES))
            },
            "m_port": F.when(no_port & msg.contains("port"), F.regexp_extract(message, PORT_SHAPE, 1)),
            "m_amount": F.when(has_size, F.regexp_extract(message, BYTES_SHAPE, 1)),
            "m_unit": F.when(has_size, F.regexp_extract(message, BYTES_SHAPE, 2)),
        }
    )
    users = F.coalesce(*[non_empty(F.col(f"m_user{i}")) for i in range(len(USER_SHAPES))])
    found = searched.withColumns(
        {
            "ts": event_time(F.col("timestamp"), fields),
            "source_ip": source_ip(fields, non_empty(F.col("m_ip"))),
            "user": user_name(fields, users),
            "contact_ip": non_empty(fields["dest_ip"]),
            "dest_ip": dest_ip(fields),
            "dest_port": dest_port(fields, non_empty(F.col("m_port"))),
            "protocol": non_empty(fields["protocol"]),
            "field_bytes": field_bytes(fields),
            "transfer_bytes": transfer_bytes(fields, F.col("m_amount"), F.col("m_unit"), honour_units),
            "network": P.is_network(msg, fields),
            **flags(fields, msg, F.coalesce(non_empty(message), F.col("raw"))),
        }
    )
    return found.drop(*[c for c in found.columns if c.startswith("m_")])


def in_cycles(prepared: DataFrame, as_of: datetime | str, cycle_seconds: int | None = None) -> DataFrame:
    """Adds ``cycle``, the end of the analysis cycle a row belongs to, and ``ets``, its event time
    or the cycle's end where that is unknown.

    Cycles are ingestion-time windows of ``cycle_seconds``; without it all rows are one cycle ending
    at ``as_of``.
    """
    if cycle_seconds:
        cycle = F.window("ingestion_time", f"{cycle_seconds} seconds")["end"]
    else:
        cycle = F.lit(as_of).cast("timestamp")
    return prepared.withColumn("cycle", cycle).withColumn("ets", F.coalesce("ts", "cycle"))
