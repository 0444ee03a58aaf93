"""Ordinal codes, IP helpers, nested-record access, time parts."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from gatewatch import constants as K


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def map_code(key, mapping: dict, default) -> Column:
    """Dictionary lookup with a default for unseen keys (JVM-side map literal)."""
    m = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in mapping.items()))
    return F.coalesce(F.try_element_at(m, _col(key)), F.lit(default))


def country_code(country, mapping: dict = K.COUNTRY_CODES, default=K.COUNTRY_CODE_ELSE) -> Column:
    return map_code(country, mapping, default)


def rule_code(rule, mapping: dict = K.RULE_CODES, default=K.RULE_CODE_ELSE) -> Column:
    return map_code(rule, mapping, default)


def edge_country_code(country, country_map: dict) -> Column:
    """Edge variant: unseen country gets max(code)+1 (0 when the map is empty)."""
    unknown = (max(country_map.values()) if country_map else 0) + 1
    return map_code(country, country_map, unknown).cast("double")


def header_value(headers, name: str, default: str | None = None) -> Column:
    """First value of a header in an array<struct<name,value>>, case-insensitive."""
    hit = F.filter(_col(headers), lambda h: F.lower(h["name"]) == F.lit(name.lower()))
    v = F.try_element_at(hit, F.lit(1))["value"]
    return F.coalesce(v, F.lit(default)) if default is not None else v


def ipv4_to_long(ip) -> Column:
    """Dotted IPv4 text to a bigint; invalid text gives null."""
    parts = F.split(_col(ip), r"\.")
    o = [F.try_element_at(parts, F.lit(i + 1)).try_cast("long") for i in range(4)]
    valid = (F.size(parts) == 4)
    for x in o:
        valid = valid & x.isNotNull() & (x >= 0) & (x <= 255)
    val = o[0] * 16777216 + o[1] * 65536 + o[2] * 256 + o[3]
    return F.when(valid, val)


def ip_to_cidr32(ip) -> Column:
    return F.concat(_col(ip), F.lit("/32"))


def zero_pad(c, width: int) -> Column:
    return F.lpad(_col(c).cast("string"), width, "0")


def kst_hour_weight(ts) -> Column:
    """Traffic weight of the Korea-time hour band (UTC+9)."""
    h = F.pmod(F.hour(_col(ts)) + K.KST_OFFSET_HOURS, F.lit(24))
    out = None
    for lo, hi, w in K.HOUR_BANDS:
        cond = (h >= lo) & (h <= hi)
        out = F.when(cond, F.lit(w)) if out is None else out.when(cond, F.lit(w))
    return out.otherwise(F.lit(K.HOUR_BAND_ELSE))


def c_factor(n) -> Column:
    """Average path length of an unsuccessful BST search, c(n)."""
    n = _col(n).cast("double")
    return (F.when(n <= 1, F.lit(0.0))
            .when(n == 2, F.lit(1.0))
            .otherwise(2.0 * (F.log(n - 1) + F.lit(K.EULER_GAMMA)) - 2.0 * (n - 1) / n))
