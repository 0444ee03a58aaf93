"""The scalar functions for SQL users: temporary SQL functions whose bodies the
optimizer inlines, so a query that uses them has no Python in its plan.

    register(spark)
    spark.sql("SELECT gw_entropy(uri), gw_threat_class(uri, args) FROM requests")
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from gatewatch import constants as K
from gatewatch.functions.text import OTHER_DIGITS


def _any(text: str, words: list[str]) -> str:
    quoted = [w.replace("\\", "\\\\").replace("'", "\\'") for w in words]
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in quoted) + ")"


def _left(text: str, pattern: str) -> str:
    return f"char_length(regexp_replace({text}, r'{pattern}', ''))"


def _plogp(count: str) -> str:
    return f"if({count} > 0, {count} / n * log2({count} / n), 0D)"


def bodies() -> dict[str, tuple[str, str, str]]:
    """name -> (parameters, type, body)."""
    clog = "if(a.r > 0, a.r * log2(a.r), 0D)"
    fold = (f"aggregate(array_sort(split(t, '')), named_struct('p', '', 'r', 0L, 'acc', 0D), "
            f"(a, x) -> named_struct('p', x, 'r', if(x = a.p, a.r + 1, 1L), 'acc', if(x = a.p, a.acc, a.acc + {clog})), a -> a.acc + {clog})")
    s = "coalesce(t, '')"
    counts = (f"SELECT char_length({s}) AS n, {_left(s, chr(92) + 'P{L}+')} AS c1, {_left(s, '[^' + chr(92) + 'p{Nd}' + OTHER_DIGITS + ']+')} AS c2, "
              f"char_length({s}) - {_left(s, '[^' + chr(92) + 'p{L}' + chr(92) + 'p{N} ' + chr(92) + 't]+')} AS c3, {_left(s, '[^ ' + chr(92) + 't]+')} AS c4")
    low = lambda c: f"lower(coalesce({c}, ''))"
    threat = (f"CASE WHEN {_any(low('args'), K.THREAT_SQL_WORDS)} THEN '{K.THREAT_SQL}' WHEN {_any(low('args'), K.THREAT_XSS_MARKS)} THEN '{K.THREAT_XSS}' "
              f"WHEN {_any(low('uri'), K.THREAT_ADMIN_WORDS)} THEN '{K.THREAT_ADMIN}' WHEN {_any(low('uri'), K.THREAT_TRAVERSAL_MARKS)} THEN '{K.THREAT_TRAVERSAL}' "
              f"WHEN gw_entropy(args) > {K.THREAT_ENTROPY_LIMIT}D THEN '{K.THREAT_ENCODED}' ELSE '{K.THREAT_FALLBACK}' END")
    octet = lambda i: f"try_cast(try_element_at(split(ip, '[.]'), {i}) AS bigint)"
    return {
        "gw_entropy": ("t STRING", "DOUBLE", f"CASE WHEN coalesce(char_length(t), 0) = 0 THEN 0D ELSE abs(log2(char_length(t)) - {fold} / char_length(t)) END"),
        "gw_class_entropy": ("t STRING", "DOUBLE", f"(SELECT if(n > 0, abs(-({' + '.join(_plogp(c) for c in ('c1', 'c2', 'c3', 'c4'))})), 0D) FROM ({counts}))"),
        "gw_threat_class": ("uri STRING, args STRING", "STRING", threat),
        "gw_ip_long": ("ip STRING", "BIGINT", f"{octet(1)} * 16777216 + {octet(2)} * 65536 + {octet(3)} * 256 + {octet(4)}"),
        "gw_cidr32": ("ip STRING", "STRING", "concat(ip, '/32')"),
        "gw_in_cidr": ("ip STRING, net STRING, plen INT", "BOOLEAN", "shiftright(gw_ip_long(ip), 32 - plen) = shiftright(gw_ip_long(net), 32 - plen)"),
    }


def register(spark: SparkSession) -> list[str]:
    """Create (or replace) the functions in the session; their names."""
    for name, (params, kind, body) in bodies().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {kind} RETURN {body}")
    return list(bodies())
