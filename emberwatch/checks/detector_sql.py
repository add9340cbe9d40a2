"""The detectors once more as plain SQL over the CTE ``x``, to check the Spark plans against.

Every function returns a SELECT with the columns rule, alert_type, method, severity, description,
log_id, source_ip, dest_ip, user, host and cycle.
"""

from __future__ import annotations

from emberwatch.checks.views import W, any_word, has, js
from emberwatch.functions import predicates as P
from emberwatch.operators.signatures import Signature

FAILED = f"({any_word('msg', ['failed'])} AND {any_word('msg', P.FAILED_LOGIN_TARGETS)})"
SUCCESS = f"({any_word('msg', P.SUCCESS_WORDS)} AND {any_word('msg', ['login'])})"
LOGIN = any_word("msg", P.LOGIN_WORDS)
ERROR = any_word("msg", P.ERROR_WORDS)
COMMAND = any_word("msg", P.COMMAND_WORDS)
SUSPICIOUS = any_word("msg", P.SUSPICIOUS_COMMANDS)
NETWORK = f"({any_word('msg', P.NETWORK_WORDS)} OR {' OR '.join(has(k) for k in P.NETWORK_KEYS)})"
IP = "nullif(source_ip, '')"
USER = "nullif(\"user\", '')"
DEST = f"coalesce(nullif({js('dest_ip')}, ''), nullif({js('destination_ip')}, ''))"
PORT = f"""nullif(try_cast(CASE WHEN {has('dest_port')} THEN {js('dest_port')} WHEN {has('port')} THEN {js('port')}
  ELSE nullif(regexp_extract(message, '(?i)port[:\\s]+(\\d+)', 1), '') END AS INT), 0)"""
QUANTITY = "(?i)(\\d+)\\s*(bytes|KB|MB|GB)"
BYTES = f"""CASE WHEN {has('bytes')} THEN try_cast({js('bytes')} AS BIGINT)
  ELSE try_cast(nullif(regexp_extract(message, '{QUANTITY}', 1), '') AS BIGINT) *
    CASE lower(regexp_extract(message, '{QUANTITY}', 2)) WHEN 'bytes' THEN 1 WHEN 'kb' THEN 1024
      WHEN 'mb' THEN 1048576 WHEN 'gb' THEN 1073741824 END END"""
EVENT_TYPE = """CASE WHEN contains(msg, 'login') AND contains(msg, 'failed') THEN 'login_failed'
  WHEN contains(msg, 'login') THEN 'login_success' WHEN contains(msg, 'error') THEN 'error'
  WHEN contains(msg, 'access') THEN 'access' ELSE 'unknown' END"""
ERROR_CATEGORY = """CASE WHEN contains(msg, 'denied') OR contains(msg, 'forbidden') THEN 'access_denied'
  WHEN contains(msg, 'exception') THEN 'exception'
  WHEN contains(msg, '500') OR contains(msg, '503') THEN 'server_error' ELSE 'other' END"""


def row(
    kind, method, severity, text, frm, where="true", log_id="NULL", ip="NULL", dest="NULL", user="NULL", host="NULL",
    rule="NULL", more="",
) -> str:
    return f"""SELECT CAST({rule} AS VARCHAR) AS rule, {kind} AS alert_type, '{method}' AS method, {severity} AS severity,
  {text} AS description, CAST({log_id} AS VARCHAR) AS log_id, CAST({ip} AS VARCHAR) AS source_ip,
  CAST({dest} AS VARCHAR) AS dest_ip, CAST({user} AS VARCHAR) AS "user", CAST({host} AS VARCHAR) AS host, cycle{more}
FROM {frm} WHERE {where}"""


def burst(
    kind, method, severity, when, k1, threshold, text, measure="n", seconds=None, k2="''", value="NULL", amount="0",
    ip="NULL", dest="NULL", user="NULL", host="NULL", log=True, vals="NULL", more="",
) -> str:
    group = f"""(SELECT cycle, k1, k2, count(*) AS n, count(DISTINCT value) AS d, CAST(sum(amount) AS BIGINT) AS a,
    min(ets) AS lo, max(ets) AS hi, arg_min(id, (ets, id)) AS first_id, arg_min(coalesce(host, '~'), (ets, id)) AS first_host,
    list_sort(list(DISTINCT value) FILTER (value IS NOT NULL)) AS vals
  FROM (SELECT cycle, ets, id, host, {k1} AS k1, {k2} AS k2, {value} AS value, {amount} AS amount FROM x WHERE {when})
  WHERE k1 IS NOT NULL GROUP BY cycle, k1, k2)"""
    span = f" AND hi - lo <= INTERVAL '{seconds} seconds'" if seconds else ""
    return row(
        f"'{kind}'", method, f"'{severity}'", text, group, f"{measure} >= {threshold}{span}",
        log_id="first_id" if log else "NULL", ip=ip, dest=dest, user=user, host=host, more=more,
    )


def members(kind, when, k1, threshold, value, measure="d", seconds=None, k2="''") -> str:
    """Every value of the groups that alert, with its count."""
    span = f"AND hi - lo <= INTERVAL '{seconds} seconds'" if seconds else ""
    return f"""SELECT '{kind}' AS kind, cycle, k1, k2, value, count(*) AS n FROM (
  SELECT *, count(*) OVER g AS rows_, count(DISTINCT value) OVER g AS d, min(ets) OVER g AS lo, max(ets) OVER g AS hi
  FROM (SELECT cycle, ets, {k1} AS k1, {k2} AS k2, CAST({value} AS VARCHAR) AS value FROM x WHERE {when}) WHERE k1 IS NOT NULL
  WINDOW g AS (PARTITION BY cycle, k1, k2))
WHERE {'rows_' if measure == 'n' else 'd'} >= {threshold} {span} AND value IS NOT NULL GROUP BY cycle, k1, k2, value"""


def all_members() -> str:
    """``members`` of every detector that lists values, with the thresholds of the registered bursts."""
    day, text = 86400, "coalesce(nullif(message, ''), raw)"
    word = "CASE " + " ".join(f"WHEN contains({text}, '{w}') THEN '{w}'" for w in P.SUSPICIOUS_COMMANDS) + " END"
    ip, user = f"coalesce({IP}, 'unknown')", f"coalesce({USER}, 'unknown')"
    return " UNION ALL ".join([
        members("port_scan_detected", f"{DEST} IS NOT NULL", IP, 10, DEST),
        members("lateral_movement", f"({IP} IS NOT NULL OR {USER} IS NOT NULL)", ip, 3, "nullif(host, '')", seconds=day, k2=user),
        members("suspicious_command_sequence", any_word(text, P.SUSPICIOUS_COMMANDS), ip, 2, word, "n", day, user),
        members("port_scan", f"{NETWORK} AND {PORT} IS NOT NULL", IP, 8, PORT, seconds=day),
        members("ddos_attack", NETWORK, f"nullif({js('dest_ip')}, '')", 4, IP, "n", day),
    ])


def sliding(kind, when, k1, threshold, measure, seconds, k2="''", value="NULL", amount="0") -> str:
    """Stretches of moments at which the measure of the last ``seconds`` reaches the threshold."""
    over = f"OVER (PARTITION BY k1, k2 ORDER BY ets RANGE BETWEEN INTERVAL {seconds} SECONDS PRECEDING AND CURRENT ROW)"
    measured = {"rows": f"count(*) {over}", "distinct": f"count(DISTINCT value) {over}", "amount": f"sum(amount) {over}"}[measure]
    some = "AND value IS NOT NULL" if measure == "distinct" else ""
    return f"""SELECT '{kind}' AS kind, k1, k2, min(ets) AS started, max(ets) AS ended, max(m)::BIGINT AS peak, count(*) AS points,
  arg_min(id, ets) AS log_id
FROM (SELECT *, m >= {threshold} AS hit, sum((m < {threshold})::INT) OVER (PARTITION BY k1, k2 ORDER BY ets) AS misses FROM (
  SELECT k1, k2, ets, m, min(id) AS id FROM (
    SELECT k1, k2, ets, id, {measured} AS m FROM (SELECT ets, id, {k1} AS k1, {k2} AS k2, {value} AS value, {amount} AS amount FROM x WHERE {when})
    WHERE k1 IS NOT NULL {some}) GROUP BY k1, k2, ets, m)) WHERE hit GROUP BY k1, k2, misses"""


def brute_force_attempt(least=5):
    return burst("brute_force_attempt", "anomaly_detection", "high", FAILED, IP, least,
                 "concat('Password guessing by ', k1, ': ', n, ' sign-ins refused')", ip="k1", log=False)


def port_scan_detected(least=10):
    return burst("port_scan_detected", "anomaly_detection", "high", f"{DEST} IS NOT NULL", IP, least,
                 "concat('Many targets for ', k1, ': ', d, ' different targets')",
                 measure="d", value=DEST, ip="k1", log=False)


def lateral_movement(least, seconds):
    return burst("lateral_movement", "heuristic_analyzer", "high", f"({IP} IS NOT NULL OR {USER} IS NOT NULL)",
                 f"coalesce({IP}, 'unknown')", least,
                 f"concat('One user on many machines: ', d, ' hosts in {seconds // 60} minutes')", measure="d",
                 seconds=seconds, k2=f"coalesce({USER}, 'unknown')", value="nullif(host, '')", ip="k1", user="k2")


def _commas(c):
    return f"format('{{:,}}', {c})"


def data_exfiltration(least, seconds):
    return burst("data_exfiltration", "heuristic_analyzer", "critical", f"({BYTES}) > 0", IP, least,
                 f"concat('Much data left: ', {_commas('a')}, ' bytes')", measure="a", seconds=seconds,
                 amount=BYTES, ip="k1")


def rapid_file_access(least, seconds):
    return burst("rapid_file_access", "heuristic_analyzer", "medium", any_word("msg", P.FILE_WORDS),
                 f"coalesce({IP}, 'unknown')", least,
                 f"concat('Files opened in quick succession: ', n, ' accesses in {seconds // 60} minutes')", seconds=seconds,
                 k2=f"coalesce({USER}, 'unknown')", ip="k1", user="k2")


def suspicious_command_sequence(least, seconds):
    text = "coalesce(nullif(message, ''), raw)"
    first = "CASE " + " ".join(f"WHEN contains({text}, '{w}') THEN '{w}'" for w in P.SUSPICIOUS_COMMANDS) + " END"
    return burst("suspicious_command_sequence", "heuristic_analyzer", "high", any_word(text, P.SUSPICIOUS_COMMANDS),
                 f"coalesce({IP}, 'unknown')", least,
                 "concat('Commands of an attack in one session: ', array_to_string(vals, ', '))", seconds=seconds,
                 k2=f"coalesce({USER}, 'unknown')", value=first, ip="k1", user="k2", host="nullif(first_host, '~')")


def port_scan(least, seconds):
    return burst("port_scan", "network_analyzer", "high", f"{NETWORK} AND {PORT} IS NOT NULL", IP, least,
                 "concat('Many ports tried: ', d, ' different ports, all from ', k1)", measure="d",
                 seconds=seconds, value=PORT, ip="k1")


def ddos_attack(least, seconds):
    return burst("ddos_attack", "network_analyzer", "critical", NETWORK, f"nullif({js('dest_ip')}, '')", least,
                 "concat('Flood of connections: ', n, ' connections to ', k1, ' from ', d, ' sources')",
                 seconds=seconds, value=IP, dest="k1")


def dns_tunneling(least, seconds):
    return burst("dns_tunneling", "network_analyzer", "high",
                 f"{NETWORK} AND (contains(msg, 'dns') OR coalesce({js('protocol')} = 'dns', false))", IP, least,
                 "concat('Names looked up too often: ', n, ' lookups by ', k1)", seconds=seconds, ip="k1")


def bandwidth_anomaly(least, seconds):
    size = f"try_cast({js('bytes')} AS BIGINT)"
    return burst("bandwidth_anomaly", "network_analyzer", "high", f"{NETWORK} AND {size} > 0", IP, least,
                 f"concat('Heavy traffic: ', {_commas('a')}, ' bytes from ', k1)", measure="a",
                 seconds=seconds, amount=size, ip="k1")


def off_hours_activity():
    return row("'off_hours_activity'", "heuristic_analyzer", "'medium'",
               "concat('Work outside office hours (', lpad(CAST(hour(ts) AS VARCHAR), 2, '0'), ':00)')", "x",
               f"(hour(ts) >= 22 OR hour(ts) < 6) AND {any_word('msg', P.OFF_HOURS_WORDS)}",
               log_id="id", ip="source_ip", user='"user"', host="host")


def protocol_anomaly():
    port = f"nullif(try_cast({js('dest_port')} AS INT), 0)"
    proto = f"nullif({js('protocol')}, '')"
    return row("'protocol_anomaly'", "network_analyzer", "'medium'",
               f"concat('Protocol on a foreign port: ', {proto}, ' on port ', {port})", "x",
               f"{NETWORK} AND lower({proto}) IN ('http', 'https') AND {port} NOT IN (80, 443, 8080, 8443)",
               log_id="id", ip="source_ip")


def suspicious_commands():
    return row("'suspicious_commands'", "anomaly_detection", "'high'",
               "concat('Commands that attackers use: ', n, ' instances')",
               f"(SELECT cycle, count(*) AS n FROM x WHERE {COMMAND} AND {SUSPICIOUS} GROUP BY cycle)")


def brute_force_success(least, seconds):
    steps = f"""(
  SELECT cycle, k1, k2, arg_min(id, (ets, id)) AS id, arg_min(coalesce(host, '~'), (ets, id)) AS host,
         arg_min(nf, (ets, id)) AS nf
  FROM (
    SELECT *, sum(f) OVER g AS nf, max(CASE WHEN f = 1 THEN ets END) OVER g AS lf FROM (
      SELECT *, coalesce(sum(s) OVER (PARTITION BY cycle, k1, k2 ORDER BY ets, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS grp
      FROM (SELECT cycle, ets, id, host, coalesce({IP}, 'unknown') AS k1, coalesce({USER}, 'unknown') AS k2,
                   CAST({FAILED} AS INT) AS f, CAST({SUCCESS} AS INT) AS s
            FROM x WHERE ({IP} IS NOT NULL OR {USER} IS NOT NULL) AND ({FAILED} OR {SUCCESS})))
    WINDOW g AS (PARTITION BY cycle, k1, k2, grp ORDER BY ets, id ROWS UNBOUNDED PRECEDING))
  WHERE s = 1 AND nf >= {least} AND ets - lf <= INTERVAL '{seconds} seconds' GROUP BY cycle, k1, k2)"""
    return row("'brute_force_success'", "heuristic_analyzer", "'high'",
               "concat('A guessed password worked: ', CAST(nf AS BIGINT), ' refusals, then a sign-in')",
               steps, log_id="id", ip="k1", user="k2", host="nullif(host, '~')")


def privilege_escalation(seconds, rearm=False):
    anchor = "max" if rearm else "min"
    late = "false" if rearm else f"""coalesce(bool_or(esc AND anchor IS NOT NULL AND ets - anchor > INTERVAL '{seconds} seconds')
      OVER (PARTITION BY cycle, k ORDER BY ets, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false)"""
    steps = f"""(
  SELECT *, {late} AS dead FROM (
    SELECT *, {anchor}(CASE WHEN login THEN ets END) OVER (PARTITION BY cycle, k, grp ORDER BY ets, id ROWS UNBOUNDED PRECEDING) AS anchor FROM (
      SELECT *, coalesce(sum(CAST(esc AS INT)) OVER (PARTITION BY cycle, k ORDER BY ets, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS grp
      FROM (SELECT cycle, ets, id, host, {USER} AS k, {LOGIN} AS login, {any_word('msg', P.PRIVILEGE_WORDS)} AS esc
            FROM x WHERE {USER} IS NOT NULL) WHERE login OR esc)))"""
    return row("'privilege_escalation'", "heuristic_analyzer", "'critical'",
               "'Higher rights taken soon after sign-in'", steps,
               f"esc AND anchor IS NOT NULL AND ets - anchor <= INTERVAL '{seconds} seconds' AND NOT dead",
               log_id="id", user="k", host="host",
               more=", round(epoch(ets - anchor), 3) AS time_since_login")


def beaconing(least, variation):
    stats = f"""(SELECT cycle, src, dst, count(*) AS n, avg(gap) AS m, stddev_pop(gap) AS s FROM (
    SELECT cycle, src, dst, epoch(ts - lag(ts) OVER (PARTITION BY cycle, src, dst ORDER BY ts)) AS gap
    FROM (SELECT cycle, {IP} AS src, nullif({js('dest_ip')}, '') AS dst, ts FROM x WHERE {NETWORK})
    WHERE src IS NOT NULL AND dst IS NOT NULL AND ts IS NOT NULL) GROUP BY cycle, src, dst)"""
    return row("'beaconing'", "network_analyzer", "'critical'",
               "concat('Calls home at even intervals from ', src, ' to ', dst)", stats,
               f"n >= {least} AND m > 0 AND s / m < {variation}", ip="src", dest="dst",
               more=", n AS connection_count, round(m, 3) AS mean_interval, round(s / m, 6) AS variation")


def metric_values_sql(bucket="date_trunc('hour', ts)"):
    key = f"CAST({bucket} AS VARCHAR)"
    counts = [("login_frequency", LOGIN, key), ("failed_login_rate", FAILED, key), ("error_rate", ERROR, key),
              ("command_execution_rate", COMMAND, key), ("requests_per_ip", "true", IP)]
    plain = [f"SELECT '{m}' AS metric, {k} AS key, count(*) AS value FROM x WHERE {w} AND {k} IS NOT NULL GROUP BY 1, 2"
             for m, w, k in counts]
    host = "nullif(host, '')"
    distinct = [f"SELECT '{m}' AS metric, {k} AS key, count(DISTINCT {v}) AS value FROM x WHERE {v} IS NOT NULL AND {k} IS NOT NULL GROUP BY 1, 2"
                for m, k, v in [("unique_hosts", key, host), ("unique_destinations", IP, DEST)]]
    return " UNION ALL ".join([*plain, *distinct])


def baselines_sql(values, least=10):
    return f"""SELECT metric, avg(value) AS mean, stddev_pop(value) AS std, quantile_cont(value, 0.5) AS median,
  quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3,
  quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr, CAST(min(value) AS DOUBLE) AS min,
  CAST(max(value) AS DOUBLE) AS max, count(*) AS count FROM ({values}) GROUP BY metric HAVING count(*) >= {least}"""


RATES = [("login_frequency", LOGIN, "login_frequency_anomaly", "medium"),
         ("failed_login_rate", FAILED, "failed_login_anomaly", "high"),
         ("error_rate", ERROR, "error_rate_anomaly", "medium"),
         ("command_execution_rate", COMMAND, "command_execution_anomaly", "high")]


def rate_anomalies(limits, base="b"):
    parts = []
    for metric, when, kind, severity in RATES:
        frm = f"""(SELECT c.cycle, c.value, b.mean, (c.value - b.mean) / nullif(b.std, 0) AS z
  FROM (SELECT cycle, count(*) AS value FROM x WHERE {when} GROUP BY cycle) c JOIN {base} b ON b.metric = '{metric}')"""
        parts.append(row(f"'{kind}'", "anomaly_detection", f"'{severity}'", "CAST(NULL AS VARCHAR)", frm,
                         f"abs(round(z, 9)) > {limits[metric]}", more=", value, round(z, 6) AS z"))
    return " UNION ALL ".join(parts)


def request_anomalies(limit, base="b", plain=100):
    counts = f"(SELECT cycle, {IP} AS ip, count(*) AS value FROM x WHERE {IP} IS NOT NULL GROUP BY 1, 2)"
    if base is None:
        return row("'high_request_rate'", "anomaly_detection", "'medium'",
                   "concat('Very many requests by ', ip, ': ', value, ' requests')", counts, f"value > {plain}",
                   ip="ip", more=", value, CAST(NULL AS DOUBLE) AS z")
    frm = f"(SELECT c.*, (value - mean) / nullif(std, 0) AS z FROM {counts} c JOIN {base} b ON b.metric = 'requests_per_ip')"
    return row("'request_rate_anomaly'", "anomaly_detection", "'medium'", "CAST(NULL AS VARCHAR)", frm,
               f"abs(round(z, 9)) > {limit}", ip="ip", more=", value, round(z, 6) AS z")


# --- profiles ------------------------------------------------------------------------------


def profile_sql(source="x"):
    timed = f"FROM {source} WHERE {USER} IS NOT NULL AND ts IS NOT NULL"
    return f"""SELECT "user", 'history' AS facet, 'rows' AS item, count(*) AS n FROM {source} WHERE {USER} IS NOT NULL GROUP BY 1
UNION ALL SELECT "user", 'login_hour', CAST(hour(ts) AS VARCHAR), count(*) {timed} AND {LOGIN} GROUP BY 1, 3
UNION ALL SELECT "user", 'login_day', CAST(isodow(ts) - 1 AS VARCHAR), count(*) {timed} AND {LOGIN} GROUP BY 1, 3
UNION ALL SELECT "user", 'source_ip', {IP}, count(*) {timed} AND {IP} IS NOT NULL GROUP BY 1, 3
UNION ALL SELECT "user", 'resource', {js('resource')}, count(*) {timed} AND {js('resource')} IS NOT NULL GROUP BY 1, 3
UNION ALL SELECT "user", 'action', {js('action')}, count(*) {timed} AND {js('action')} IS NOT NULL GROUP BY 1, 3"""


def profile_ctes(middle, hours=10, rows=10):
    return f"""hist AS (SELECT * FROM x WHERE ts < TIMESTAMP '{middle}'),
prof AS MATERIALIZED ({profile_sql('hist')}),
ok AS (SELECT "user" FROM prof GROUP BY 1 HAVING sum(n) FILTER (facet = 'history') >= {rows}
       AND count(*) FILTER (facet = 'login_hour') >= {hours}),
act AS MATERIALIZED (SELECT * FROM x WHERE ts IS NOT NULL AND {USER} IS NOT NULL AND "user" IN (SELECT "user" FROM ok))"""


def unusual_login_time(share=0.05):
    frm = """(SELECT a.*, hour(a.ts) AS h FROM act a LEFT JOIN (
    SELECT "user" AS u, CAST(item AS INT) AS hr, n / sum(n) OVER (PARTITION BY "user") AS share FROM prof WHERE facet = 'login_hour') s
    ON s.u = a."user" AND s.hr = hour(a.ts) WHERE """ + f"{LOGIN} AND coalesce(s.share, 0) < {share})"
    return row("'unusual_login_time'", "behavioral_analyzer", "'medium'",
               "concat('User ', \"user\", ' signed in at an hour new to them (', lpad(CAST(h AS VARCHAR), 2, '0'), ':00)')", frm,
               log_id="id", user='"user"', host="host")


def _unseen(kind, severity, facet, item, text, ip="NULL"):
    frm = f"""(SELECT a.*, {item} AS item FROM act a WHERE {item} IS NOT NULL AND NOT EXISTS
    (SELECT 1 FROM prof q WHERE q.facet = '{facet}' AND q."user" = a."user" AND q.item = {item}))"""
    return row(f"'{kind}'", "behavioral_analyzer", f"'{severity}'", f"concat('User ', \"user\", '{text}', item)", frm,
               log_id="id", ip=ip, user='"user"', host="host")


def unusual_source_ip():
    return _unseen("unusual_source_ip", "high", "source_ip", "nullif(a.source_ip, '')", " came from an address new to them: ", "item")


def unusual_resource_access():
    return _unseen("unusual_resource_access", "medium", "resource",
                   "json_extract_string(a.normalized, '$.resource')", " opened something new to them: ")


# --- rules ---------------------------------------------------------------------------------


def _rule_field(name, derived="NULL"):
    return (f"CASE WHEN {has(name)} THEN {js(name)} WHEN coalesce(json_exists(metadata, '$.{name}'), false) "
            f"THEN json_extract_string(metadata, '$.{name}') ELSE {derived} END")


def rule_sql(rule, where, by=None, least=0, seconds=0):
    frm = f"(SELECT * FROM x WHERE {where})"
    if by:
        frm = f"""(SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY cycle, g) AS in_group FROM (
    SELECT *, nullif({by}, '') AS g FROM {frm}) WHERE g IS NOT NULL AND cycle - ts <= INTERVAL '{seconds} seconds') WHERE in_group >= {least})"""
    return row(f"'{rule['name']}'", "rule_engine", f"'{rule['severity']}'",
               f"'[{rule['mitre_attack']['technique']}] {rule['description']}'", frm, log_id="id", ip="source_ip",
               user='"user"', host="host", rule=f"'{rule['id']}'")


def rolling_rule_sql(rule, where, by, least, seconds):
    """Rows of a cycle whose group has enough rows, of this cycle or earlier ones, within ``seconds`` of the cycle's end."""
    frm = f"""(WITH r AS (SELECT *, nullif({by}, '') AS g FROM x WHERE {where}),
  near AS (SELECT * FROM r WHERE g IS NOT NULL AND cycle - ts <= INTERVAL '{seconds} seconds'),
  ends AS (SELECT DISTINCT g, cycle FROM near),
  enough AS (SELECT e.g, e.cycle FROM ends e JOIN near n ON n.g = e.g AND n.cycle <= e.cycle AND e.cycle - n.ts <= INTERVAL '{seconds} seconds'
    GROUP BY e.g, e.cycle HAVING count(*) >= {least})
  SELECT near.* FROM near SEMI JOIN enough ON near.g = enough.g AND near.cycle = enough.cycle)"""
    return row(f"'{rule['name']}'", "rule_engine", f"'{rule['severity']}'",
               f"'[{rule['mitre_attack']['technique']}] {rule['description']}'", frm, log_id="id", ip="source_ip",
               user='"user"', host="host", rule=f"'{rule['id']}'")


def rule_brute_force_rolling(rule, least, seconds):
    return rolling_rule_sql(rule, f"({_rule_field('event_type', EVENT_TYPE)}) = 'login_failed'", _rule_field("source_ip", "source_ip"), least, seconds)


def rule_valid_accounts(rule):
    return rule_sql(rule, f"({_rule_field('event_type', EVENT_TYPE)}) = 'login_success' AND ({_rule_field('source_ip_type')}) = 'external' "
                          f"AND ({_rule_field('user_type')}) = 'privileged'")


def rule_brute_force(rule, least, seconds):
    return rule_sql(rule, f"({_rule_field('event_type', EVENT_TYPE)}) = 'login_failed'",
                    _rule_field("source_ip", "source_ip"), least, seconds)


def rule_c2(rule, least, seconds):
    return rule_sql(rule, f"lower({_rule_field('protocol')}) = 'http' AND ({_rule_field('dest_port')}) IN ('8080', '8443', '4444', '1337') "
                          f"AND ({_rule_field('dest_ip_type')}) = 'external'", _rule_field("dest_ip"), least, seconds)


def rule_credentials(rule):
    return rule_sql(rule, f"({_rule_field('event_type', EVENT_TYPE)}) = 'process_creation' AND ({_rule_field('process_name')}) "
                          f"IN ('mimikatz.exe', 'procdump.exe', 'pwdump.exe')")


# --- signatures ----------------------------------------------------------------------------

NW = r"[^\p{L}\p{M}\p{N}_]"
# Word boundaries with Unicode meaning, spelt out for an engine that has only the ASCII ones.
BOUNDARY_FORMS = {
    r"(?i)\bunion\b.{1,100}\bselect\b": rf"(?i)(?:\A|{NW})union(?:[^\p{{L}}\p{{M}}\p{{N}}_\n]|[^\p{{L}}\p{{M}}\p{{N}}_\n].{{0,98}}[^\p{{L}}\p{{M}}\p{{N}}_\n])select(?:\z|{NW})",
    r"(?i)\b(sleep|benchmark|waitfor\s+delay)\s*\(": rf"(?i)(?:\A|{NW})(sleep|benchmark|waitfor\s+delay)\s*\(",
    r"(?i)\bon(load|error|click|mouseover|focus|blur|change|submit)\s*=": rf"(?i)(?:\A|{NW})on(load|error|click|mouseover|focus|blur|change|submit)\s*=",
    r"(?i)\b(web\.config|wp-config\.php|\.env|\.git/config)\b": rf"(?i)(?:(?:\A|{NW})(?:web\.config|wp-config\.php)|{W}(?:\.env|\.git/config))(?:\z|{NW})",
    r"[;&|]\s*(cat|ls|dir|whoami|id|uname|pwd|wget|curl)\b": rf"[;&|]\s*(cat|ls|dir|whoami|id|uname|pwd|wget|curl)(?:\z|{NW})",
    r"\|\s*(nc|netcat|telnet|bash|sh)\b": rf"\|\s*(nc|netcat|telnet|bash|sh)(?:\z|{NW})",
}


def _re2(pattern: str) -> str:
    p = BOUNDARY_FORMS.get(pattern, pattern)
    out, i, in_class = "", 0, False
    while i < len(p):
        c, nxt = p[i], p[i : i + 2]
        if c == "\\":
            if nxt == r"\w":
                nxt = r"\p{L}\p{M}\p{N}_" if in_class else W
            elif nxt == r"\s":
                nxt = r"\s\x0b\x{85}\p{Z}" if in_class else r"[\s\x0b\x{85}\p{Z}]"
            out, i = out + nxt, i + 2
            continue
        in_class = c == "[" or (in_class and c != "]")
        out, i = out + c, i + 1
    return out


def signatures(catalog: list[Signature]) -> str:
    def column(path):
        return f"nullif({path}, '')" if "." not in path else f"nullif({js(path.split('.')[1])}, '')"

    def test(s):
        either = "(?im)" + "|".join(f"(?:{_re2(p)})" for p in s.patterns)
        quoted = either.replace("'", "''")
        return " OR ".join(f"coalesce(regexp_matches({column(f)}, '{quoted}'), false)" for f in s.fields)

    tests = ", ".join(f"CASE WHEN {test(s)} THEN '{s.id}' END" for s in catalog)
    rows = ", ".join(
        "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in (s.id, s.name, s.severity, s.category, s.description)) + ")"
        for s in catalog
    )
    frm = f"""(SELECT h.*, k.* FROM (SELECT id, host, source_ip, "user", cycle, unnest(list_filter([{tests}], lambda z: z IS NOT NULL)) AS sid FROM x) h
  JOIN (VALUES {rows}) k(kid, name, sev, category, text) ON k.kid = h.sid)"""
    return row("category", "signature_detector", "sev", "concat(name, ': ', text)", frm, log_id="id", ip="source_ip",
               user='"user"', host="host", rule="sid")


# --- dimensions derived from the tables ----------------------------------------------------

BLOCKED = "SELECT concat('10.0.0.', n_nationkey) AS ip FROM nation"
HASHES = """SELECT DISTINCT md5(concat('file', p_size)) AS hash, concat('HASH-', p_size) AS signature_id,
  concat('Known file ', p_size) AS name, CASE WHEN p_size % 2 = 0 THEN 'critical' ELSE 'high' END AS severity,
  'md5' AS hash_type, 'known bad file' AS description FROM part"""
INTEL = """SELECT concat('ti-', s_suppkey) AS id,
  CASE s_suppkey % 4 WHEN 0 THEN 'ip' WHEN 1 THEN 'domain' WHEN 2 THEN 'hash' ELSE 'url' END AS indicator_type,
  CASE s_suppkey % 4 WHEN 0 THEN concat('10.0.0.', s_suppkey % 16) WHEN 1 THEN concat(' HOST', s_suppkey % 60, '.example.org')
    WHEN 2 THEN md5(concat('file', s_suppkey % 40)) ELSE concat('http://192.0.2.', s_suppkey % 25, ':8081/INDEX') END AS indicator_value,
  CASE WHEN s_suppkey % 3 = 0 THEN NULL WHEN s_suppkey % 3 = 1 THEN 'botnet' ELSE 'c2' END AS threat_type,
  CASE WHEN s_suppkey % 11 = 0 THEN NULL ELSE (s_suppkey % 10) / 10.0 END AS confidence,
  concat('feed', s_nationkey) AS source, CAST(NULL AS STRING) AS metadata,
  CAST('2024-01-01 00:00:00' AS TIMESTAMP) AS created_at,
  CASE WHEN s_suppkey % 5 = 0 THEN CAST('2023-06-01 00:00:00' AS TIMESTAMP) WHEN s_suppkey % 5 = 1 THEN NULL
    ELSE CAST('2025-01-01 00:00:00' AS TIMESTAMP) END AS expires_at FROM supplier"""


def blocked_ips():
    return row("'blocked_ip_detected'", "signature_detector", "'high'",
               "concat('An address on the block list connected: ', source_ip)", "x", f"source_ip IN ({BLOCKED.replace('AS ip ', '')})",
               log_id="id", ip="source_ip", host="host")


def known_hashes():
    found = "list_concat(" * 2 + "coalesce(regexp_extract_all(message, '\\b[a-fA-F0-9]{32}\\b'), []), coalesce(regexp_extract_all(message, '\\b[a-fA-F0-9]{40}\\b'), [])), coalesce(regexp_extract_all(message, '\\b[a-fA-F0-9]{64}\\b'), []))"
    keys = ", ".join(js(k) for k in ("file_hash", "hash", "md5", "sha1", "sha256"))
    frm = f"""(SELECT cycle, id, host, arg_min(name, pos) AS name, arg_min(severity, pos) AS severity FROM (
    SELECT v.*, k.name, k.severity FROM (SELECT cycle, id, host, unnest(hs) AS h, unnest(range(len(hs))) AS pos FROM
      (SELECT *, list_filter(list_concat({found}, [{keys}]), lambda z: z IS NOT NULL) AS hs FROM x)) v JOIN ({HASHES}) k ON k.hash = lower(v.h))
    GROUP BY cycle, id, host)"""
    return row("'malicious_hash_detected'", "signature_detector", "severity",
               "concat('A file known to be harmful: ', name)", frm, log_id="id", host="host")


DOMAIN = "\\b(?:[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?\\.)+[a-zA-Z]{2,}\\b"
EMAIL = "\\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Z|a-z]{2,}\\b"


def indicator_sql():
    text = "coalesce(nullif(message, ''), raw)"

    def found(p, more="", kind=""):
        return f"SELECT *, '{kind}' AS type, unnest(regexp_extract_all({text}, '{p}')) AS v FROM x"

    one = [("ip", "source_ip"), ("ip", js("dest_ip")), ("ip", js("source_ip")), ("domain", js("domain")), ("url", js("url")),
           ("hash", f"CASE WHEN length({js('file_hash')}) IN (32, 40, 64) THEN {js('file_hash')} END")]
    parts = [f"SELECT *, '{k}' AS type, {e} AS v FROM x" for k, e in one]
    parts += [f"SELECT * FROM ({found(DOMAIN, kind='domain')}) WHERE v NOT IN ('localhost', 'example.com', 'test.com')",
              found("https?://[^\\s]+", kind="url"), found(EMAIL, kind="email"),
              *[found(f"\\b[a-fA-F0-9]{{{n}}}\\b", kind="hash") for n in (32, 40, 64)]]
    union = " UNION ALL ".join(parts)
    return f"SELECT DISTINCT id, host, source_ip, \"user\", cycle, type, lower(trim(v)) AS value FROM ({union}) WHERE v IS NOT NULL AND trim(v) <> ''"


def threat_intel(as_of):
    frm = f"""(SELECT i.*, t.* EXCLUDE (value) FROM ({indicator_sql()}) i JOIN (
    SELECT indicator_type, lower(trim(indicator_value)) AS value, coalesce(nullif(threat_type, ''), 'unknown') AS threat,
           coalesce(nullif(confidence, 0), 0.5) AS conf,
           row_number() OVER (PARTITION BY indicator_type, lower(trim(indicator_value)) ORDER BY confidence DESC NULLS LAST, created_at DESC, id) AS place
    FROM ({INTEL}) WHERE expires_at IS NULL OR expires_at > TIMESTAMP '{as_of}') t
  ON t.indicator_type = i.type AND t.value = i.value WHERE place = 1)"""
    return row("concat('threat_intel_', type)", "threat_intel_matcher",
               "CASE WHEN conf >= 0.8 THEN 'critical' WHEN conf >= 0.6 THEN 'high' WHEN conf >= 0.4 THEN 'medium' ELSE 'low' END",
               "concat('Listed by a threat feed: ', type, ' ', value, ' (', threat, ')')", frm, log_id="id",
               ip="source_ip", user='"user"', host="host", rule="value")


def threat_intel_as_of(until):
    frm = f"""(SELECT i.*, t.* EXCLUDE (value) FROM (SELECT * FROM ({indicator_sql()}) JOIN (SELECT id, ets FROM x) USING (id)) i JOIN (
    SELECT id AS intel_id, indicator_type, lower(trim(indicator_value)) AS value, coalesce(nullif(threat_type, ''), 'unknown') AS threat,
           coalesce(nullif(confidence, 0), 0.5) AS conf, confidence, created_at, expires_at FROM ({INTEL})) t
  ON t.indicator_type = i.type AND t.value = i.value AND coalesce(created_at <= ets, true) AND ets < coalesce(expires_at, TIMESTAMP '{until}')
  QUALIFY row_number() OVER (PARTITION BY i.id, i.type, i.value ORDER BY confidence DESC NULLS LAST, created_at DESC, intel_id) = 1)"""
    return row("concat('threat_intel_', type)", "threat_intel_matcher",
               "CASE WHEN conf >= 0.8 THEN 'critical' WHEN conf >= 0.6 THEN 'high' WHEN conf >= 0.4 THEN 'medium' ELSE 'low' END",
               "concat('Listed by a threat feed: ', type, ' ', value, ' (', threat, ')')", frm, log_id="id",
               ip="source_ip", user='"user"', host="host", rule="value")
