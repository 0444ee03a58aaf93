"""The adapters of ``gatewatch.sources.adapters`` written as DuckDB SQL.

Used only by the oracle SQL strings; each is a CTE body over the driver's
pre-registered views.
"""

from gatewatch import constants as K
from gatewatch.sources.adapters import URI_PREFIXES


def _case_mod(col: str, m: int, values: list[str]) -> str:
    whens = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE {col} % {m} {whens} END"


RULE_CASE = (f"CASE event_type WHEN 'error' THEN '{K.RULE_SQLI}' WHEN 'signup' THEN '{K.RULE_GEO}' "
             f"WHEN 'click' THEN '{K.RULE_AI_BLOCK}' WHEN 'purchase' THEN '{K.RULE_REPUTATION}' "
             f"ELSE '{K.RULE_DEFAULT}' END")
IP_EXPR = ("concat('10.0.', CAST(CAST(floor(user_id / 256) AS BIGINT) AS VARCHAR), '.', "
           "CAST(user_id % 256 AS VARCHAR))")
COUNTRY_EXPR = _case_mod("user_id", 5, ["KR", "KR", "NL", "US", "CN"])
URI_EXPR = (f"concat('/', {_case_mod('user_id', 7, URI_PREFIXES)}, '/', event_type, '/', "
            "coalesce(json_extract_string(props, '$.k'), '0'))")

WAF = f"""waf AS (
  SELECT event_id AS row_id, ts AS event_ts, user_id, event_type, value,
         CAST(epoch_ms(ts) AS BIGINT) AS ts_ms,
         {RULE_CASE} AS terminatingruleid,
         CASE WHEN event_type = 'view' THEN 'ALLOW' ELSE 'BLOCK' END AS action,
         {IP_EXPR} AS client_ip,
         {COUNTRY_EXPR} AS country,
         {URI_EXPR} AS uri,
         '' AS args,
         lpad(CAST(year(ts) AS VARCHAR), 4, '0') AS year,
         lpad(CAST(month(ts) AS VARCHAR), 2, '0') AS month,
         lpad(CAST(day(ts) AS VARCHAR), 2, '0') AS day,
         lpad(CAST(hour(ts) AS VARCHAR), 2, '0') AS hour
  FROM events)"""

SCORED = f"""scored AS (
  SELECT event_id AS row_id, ts AS event_ts,
         strftime(ts, '%Y-%m-%d %H:%M:%S') AS event_time,
         {IP_EXPR} AS ip,
         least(value, 100.0) AS pred_risk,
         CASE WHEN value >= 70 THEN 1 ELSE 0 END AS anomaly,
         0.15 - value / 1000.0 AS raw_score,
         {RULE_CASE} AS terminatingruleid,
         CASE WHEN event_type = 'view' THEN 'ALLOW' ELSE 'BLOCK' END AS action,
         {COUNTRY_EXPR} AS country,
         lpad(CAST(year(ts) AS VARCHAR), 4, '0') AS year,
         lpad(CAST(month(ts) AS VARCHAR), 2, '0') AS month,
         lpad(CAST(day(ts) AS VARCHAR), 2, '0') AS day
  FROM events)"""

WEB = r"""web AS (
  SELECT page_id AS row_id, url,
         regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host,
         regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS request_uri,
         regexp_extract(url, '[?]([^#]*)', 1) AS request_args
  FROM pages)"""

DOCREQ = """docreq AS (
  SELECT doc_id AS row_id, concat('/', lang, '/', source) AS request_uri, text AS request_args
  FROM documents)"""


def entropy_sql(expr: str) -> str:
    """Shannon entropy of a text in DuckDB (0.0 for null or empty)."""
    return (f"(CASE WHEN coalesce(length({expr}), 0) = 0 THEN 0.0 "
            f"ELSE abs(list_entropy(string_split({expr}, ''))) END)")


def restore_args_sql(rule: str, row_id: str) -> str:
    sq = ", ".join("'" + p.replace("'", "''") + "'" for p in K.SQLI_PAYLOADS)
    xs = ", ".join("'" + p.replace("'", "''") + "'" for p in K.XSS_PAYLOADS)
    return (f"(CASE WHEN contains({rule}, 'SQLi') THEN [{sq}][({row_id} % {len(K.SQLI_PAYLOADS)}) + 1] "
            f"WHEN contains({rule}, 'XSS') OR contains({rule}, 'CrossSite') THEN [{xs}][({row_id} % {len(K.XSS_PAYLOADS)}) + 1] "
            f"ELSE '' END)")


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
