"""Access-policy replay, IP / CIDR membership, event-pattern and log filters.

Policy replay evaluates a priority-ordered rule list as one CASE expression
(first terminating match wins, default action otherwise); rule predicates are
Columns, so the whole replay is a narrow projection inside codegen. Set
membership comes in two forms:

* literal lists (trusted ranges, reputation ranges): per distinct prefix
  length an ``isin`` over the shifted address — an InSet hash probe, no join;
* data-derived tables (the AI block list, which grows with the data): an
  equi-join on the address (or on its /16 bucket for CIDR tables). No
  static broadcast hint: AQE measures the built side at runtime and
  broadcasts it only under ``spark.sql.autoBroadcastJoinThreshold``,
  otherwise keeps the shuffle join.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatewatch import constants as K
from gatewatch.functions.codes import ipv4_to_long


@dataclass
class Rule:
    name: str
    match: Column
    action: str = "BLOCK"
    scope_down: Column | None = None  # the rule only inspects rows where this holds


def replay(df: DataFrame, rules: list[Rule], default_action: str = "ALLOW",
           default_rule: str = K.RULE_DEFAULT, rule_col: str = "terminatingruleid",
           action_col: str = "action") -> DataFrame:
    """First matching rule (in list order = priority) terminates."""
    rid, act = None, None
    for r in rules:
        cond = r.match if r.scope_down is None else (r.scope_down & r.match)
        cond = F.coalesce(cond, F.lit(False))
        rid = F.when(cond, F.lit(r.name)) if rid is None else rid.when(cond, F.lit(r.name))
        act = F.when(cond, F.lit(r.action)) if act is None else act.when(cond, F.lit(r.action))
    return df.withColumns({rule_col: rid.otherwise(F.lit(default_rule)),
                           action_col: act.otherwise(F.lit(default_action))})


def not_in_countries(country, allowed: list[str] = K.ALLOWED_COUNTRIES) -> Column:
    c = F.col(country) if isinstance(country, str) else country
    return ~F.coalesce(c, F.lit("")).isin(allowed)


def lower_starts(col, prefixes: list[str]) -> Column:
    c = F.lower(F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit("")))
    out = F.lit(False)
    for p in prefixes:
        out = out | c.startswith(p.lower())
    return out


def contains_any(col, words: list[str]) -> Column:
    c = F.lower(F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit("")))
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


def parse_cidr(cidr: str) -> tuple[int, int]:
    """'a.b.c.d/p' -> (p, network >> (32 - p))."""
    ip, _, plen = cidr.partition("/")
    p = int(plen) if plen else 32
    a, b, c, d = (int(x) for x in ip.split("."))
    v = (a << 24) | (b << 16) | (c << 8) | d
    return p, v >> (32 - p)


def in_cidrs(ip, cidrs: list[str]) -> Column:
    """Membership of a dotted IPv4 column in a literal CIDR list: one InSet
    probe per distinct prefix length, no join."""
    v = ipv4_to_long(F.col(ip) if isinstance(ip, str) else ip)
    by_len: dict[int, set[int]] = defaultdict(set)
    for c in cidrs:
        p, net = parse_cidr(c)
        by_len[p].add(net)
    out = F.lit(False)
    for p, nets in sorted(by_len.items()):
        out = out | F.coalesce(F.shiftright(v, 32 - p).isin(sorted(nets)), F.lit(False))
    return out


def cidr_table(cidrs: DataFrame, col: str = "cidr") -> DataFrame:
    """CIDR text table -> (plen, net) keys."""
    ip = F.split(F.col(col), "/")
    plen = F.coalesce(F.try_element_at(ip, F.lit(2)).try_cast("int"), F.lit(32))
    v = ipv4_to_long(F.try_element_at(ip, F.lit(1)))
    net = F.floor(v / F.pow(F.lit(2.0), (32 - plen).cast("double"))).cast("long")
    return cidrs.select(plen.alias("plen"), net.alias("net")).dropDuplicates()


def cidr_intervals(cidrs: DataFrame, col: str = "cidr", prefix_lengths: list[int] | None = None) -> DataFrame:
    """CIDR text table -> disjoint address intervals (bucket, lo, hi), cut at
    /16 buckets and merged.

    A prefix of up to 16 bits covers whole buckets: those are listed once. The
    others lie in one bucket each, where a sweep by their first address, with
    the running maximum of the last one, joins what overlaps or touches. A
    bucket holds at most 32,768 intervals, whatever the table's size. Entries
    that are no CIDR, or longer than /32, are left out."""
    keys = cidr_table(cidrs, col).where("net IS NOT NULL AND plen BETWEEN 0 AND 32")
    if prefix_lengths is not None:
        keys = keys.where(F.col("plen").isin(list(prefix_lengths)))
    wide = keys.where("plen <= 16").select(F.explode(F.sequence(
        F.expr("net << (16 - plen)"), F.expr("((net + 1) << (16 - plen)) - 1"))).alias("bucket")).distinct()
    wide = wide.select("bucket", F.expr("bucket << 16").alias("lo"), F.expr("((bucket + 1) << 16) - 1").alias("hi"))
    thin = keys.where("plen > 16").select(F.expr("net << (32 - plen)").alias("lo"), F.expr("((net + 1) << (32 - plen)) - 1").alias("hi"))
    thin = thin.withColumn("bucket", F.shiftright("lo", 16)).select("bucket", "lo", "hi")
    order = Window.partitionBy("bucket").orderBy("lo", F.desc("hi"))
    reach = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    cut = wide.unionByName(thin).withColumn("_new", (F.col("lo") > F.coalesce(reach, F.lit(-2)) + 1).cast("int"))
    cut = cut.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return cut.groupBy("bucket", "_run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_run")


def cidr_member_flag(df: DataFrame, ip: str, cidrs: DataFrame, prefix_lengths: list[int] | None = None,
                     flag: str = "in_set") -> DataFrame:
    """Flag rows whose IP lies in any CIDR of a (data-derived) table of any
    size; ``prefix_lengths`` restricts the table to some lengths.

    One equi-join on the /16 bucket of the address, with one row per bucket:
    whether it is covered whole, else its intervals by /24, so a row is tested
    against the (at most 128) intervals of its own /24. Rows are never repeated; columns of ``df`` pass
    through, whatever their names, but one named as ``flag`` is replaced. A
    null or malformed address is in no set."""
    pieces = cidr_intervals(cidrs, prefix_lengths=prefix_lengths).withColumn("whole", F.expr("hi - lo = 65535"))
    pieces = pieces.withColumn("sub", F.explode(F.expr("sequence(lo >> 8, if(whole, lo, hi) >> 8)")))
    pieces = pieces.groupBy("bucket", "sub", "whole").agg(F.collect_list(F.struct("lo", "hi")).alias("held"))
    table = pieces.groupBy(F.col("bucket").alias("__cidr_bucket")).agg(
        F.max("whole").alias("__cidr_whole"), F.map_from_entries(F.collect_list(F.struct("sub", "held"))).alias("__cidr_subs"))
    v = ipv4_to_long(F.col(ip))
    out = df.drop(flag).select("*", v.alias("__cidr_v")).join(table, F.shiftright("__cidr_v", 16) == F.col("__cidr_bucket"), "left")
    near = F.try_element_at("__cidr_subs", F.shiftright("__cidr_v", 8))
    inside = F.exists(near, lambda r: (F.col("__cidr_v") >= r["lo"]) & (F.col("__cidr_v") <= r["hi"]))
    return out.withColumn(flag, F.coalesce(F.col("__cidr_whole") | inside, F.col("__cidr_whole"), F.lit(False))).drop(
        "__cidr_v", "__cidr_bucket", "__cidr_whole", "__cidr_subs")


def ip_member_flag(df: DataFrame, ip: str, ips: DataFrame, ip_col: str = "ip",
                   flag: str = "in_set") -> DataFrame:
    """Exact-IP membership (block list) as a left join with the distinct IPs."""
    s = ips.select(F.col(ip_col).alias("_bip")).dropDuplicates().withColumn("_hit", F.lit(True))
    return (df.join(s, df[ip] == s["_bip"], "left")
            .withColumn(flag, F.coalesce(F.col("_hit"), F.lit(False))).drop("_bip", "_hit"))


def waf_rules(country: str, ip_blocked: str, uri: str, args: str, ip: str,
              trusted: list[str] | None = None, reputation: list[str] | None = None) -> list[Rule]:
    """The regional web ACL, priorities 0-4. Managed-rule contents are not
    public; SQLi / common-rule predicates use the classifier keyword lists."""
    sqli_scope = ~lower_starts(uri, ["/admin/"])
    if trusted:
        sqli_scope = sqli_scope & ~in_cidrs(ip, trusted)
    common_scope = ~lower_starts(uri, ["/health", "/metrics"])
    return [
        Rule(K.RULE_GEO, not_in_countries(country)),
        Rule(K.RULE_AI_BLOCK, F.col(ip_blocked)),
        Rule(K.RULE_SQLI, contains_any(args, K.THREAT_SQL_WORDS), scope_down=sqli_scope),
        Rule(K.RULE_COMMON, contains_any(args, K.THREAT_XSS_MARKS) | contains_any(uri, ["../"]),
             scope_down=common_scope),
        Rule(K.RULE_REPUTATION, in_cidrs(ip, reputation or [])),
    ]


def edge_rules(country: str, uri: str, args: str, ip: str, reputation: list[str] | None = None) -> list[Rule]:
    """Edge ACL: the country whitelist (geo restriction) first, then common
    rules, SQLi, IP reputation (no scope-down at the edge)."""
    return [
        Rule("GeoRestriction-KR-Only", not_in_countries(country)),
        Rule(K.RULE_COMMON, contains_any(args, K.THREAT_XSS_MARKS) | contains_any(uri, ["../"])),
        Rule(K.RULE_SQLI, contains_any(args, K.THREAT_SQL_WORDS)),
        Rule(K.RULE_REPUTATION, in_cidrs(ip, reputation or [])),
    ]


def match_pattern(df: DataFrame, pattern: dict[str, list[str]], json_col: str | None = None,
                  json_root: str = "detail") -> Column:
    """Event-pattern filter: every field's value must be in its list (AND).
    A dotted field under ``json_root`` is read from the JSON text column."""
    cond = F.lit(True)
    for field, values in pattern.items():
        if json_col and field.startswith(json_root + "."):
            path = "$." + field[len(json_root) + 1:]
            v = F.get_json_object(F.col(json_col), path)
        else:
            v = F.col(f"`{field}`")
        cond = cond & F.coalesce(v.isin(values), F.lit(False))
    return cond


def log_filter(df: DataFrame, filters: list[tuple[str, list[str], str]], default: str = "KEEP",
               action: str = "action") -> DataFrame:
    """Logging filter: each filter = (KEEP|DROP, actions, MEETS_ANY|MEETS_ALL);
    the first filter whose condition holds decides, else the default."""
    decision = None
    for behavior, actions, req in filters:
        conds = [F.col(action) == F.lit(a) for a in actions]
        c = conds[0]
        for x in conds[1:]:
            c = (c | x) if req == "MEETS_ANY" else (c & x)
        c = F.coalesce(c, F.lit(False))
        decision = F.when(c, F.lit(behavior)) if decision is None else decision.when(c, F.lit(behavior))
    decision = F.lit(default) if decision is None else decision.otherwise(F.lit(default))
    return df.filter(decision == F.lit("KEEP"))
