"""Dashboard queries (rule, attack type, country, hour, client; anomalous IPs)."""

from __future__ import annotations

from gatewatch.operators import dashboards as D
from gatewatch.plans.registry import query, table
from gatewatch.plans.sqlviews import SCORED, WAF, with_
from gatewatch.sources.adapters import scored_events, waf_logs


def _waf(spark, sf):
    return waf_logs(table(spark, sf, "events"))


def _scored(spark, sf):
    return scored_events(table(spark, sf, "events"))


@query("rule_blocks", with_(WAF) + """
SELECT terminatingruleid AS rule, COUNT(*) AS block_count
FROM waf WHERE action = 'BLOCK' GROUP BY terminatingruleid ORDER BY block_count DESC, rule""")
def rule_blocks(spark, sf):
    """Blocks per terminating rule, all partitions."""
    return D.rule_blocks(_waf(spark, sf))


@query("attack_types", with_(WAF) + """
SELECT CASE WHEN terminatingruleid LIKE '%SQLi%' THEN 'SQLi'
            WHEN terminatingruleid LIKE '%XSS%' THEN 'XSS'
            WHEN terminatingruleid LIKE '%CommonRule%' THEN 'CommonRuleSet'
            WHEN terminatingruleid = 'GeoBlock-Non-KR' THEN 'GeoBlock'
            WHEN terminatingruleid = 'AI-RealTime-Block-Rule' THEN 'AI Block'
            WHEN terminatingruleid LIKE '%ReputationList%' THEN 'IP Reputation'
            ELSE 'Other' END AS attack_type,
       COUNT(*) AS cnt
FROM waf WHERE action = 'BLOCK' GROUP BY 1 ORDER BY cnt DESC, attack_type""")
def attack_types(spark, sf):
    """Blocks per attack type (ordered CASE over the rule id)."""
    return D.attack_types(_waf(spark, sf))


@query("country_top30", with_(WAF) + """
SELECT country, COUNT(*) AS block_count FROM waf WHERE action = 'BLOCK'
GROUP BY country ORDER BY block_count DESC, country LIMIT 30""")
def country_top30(spark, sf):
    """Top 30 countries by blocks (nested httprequest.country)."""
    return D.country_top(_waf(spark, sf), 30)


@query("hourly_rule", with_(WAF) + """
SELECT strftime(date_trunc('hour', make_timestamp(ts_ms * 1000)), '%Y-%m-%d %H:%M:%S') AS block_hour,
       terminatingruleid AS rule, COUNT(*) AS cnt
FROM waf WHERE action = 'BLOCK' GROUP BY 1, 2 ORDER BY block_hour, rule""")
def hourly_rule(spark, sf):
    """Blocks per UTC hour of the epoch-ms timestamp and rule."""
    return D.hourly_rule(_waf(spark, sf))


@query("top10_ips", with_(WAF) + """
SELECT client_ip, country, terminatingruleid AS rule, COUNT(*) AS hit_count
FROM waf WHERE action = 'BLOCK' GROUP BY 1, 2, 3
ORDER BY hit_count DESC, client_ip, country, rule LIMIT 10""")
def top10_ips(spark, sf):
    """Top 10 (client ip, country, rule) by blocks."""
    return D.top_clients(_waf(spark, sf), 10)


@query("top_anomalous_ip", with_(SCORED) + """
SELECT year, month, day, ip, cnt FROM (
  SELECT year, month, day, ip, COUNT(*) AS cnt,
         row_number() OVER (PARTITION BY year, month, day ORDER BY COUNT(*) DESC, ip) AS rk
  FROM scored WHERE anomaly = 1 GROUP BY year, month, day, ip) t
WHERE rk = 1""")
def top_anomalous_ip(spark, sf):
    """Top anomalous IP of each day partition (the daily analyzer report)."""
    return D.top_anomalous_ip_per_day(_scored(spark, sf))


@query("distinct_anomalous_ips", with_(SCORED) + """
SELECT year, month, day, COUNT(DISTINCT ip) AS n_ips, COUNT(*) AS n_anomalies
FROM scored WHERE anomaly = 1 GROUP BY year, month, day""")
def distinct_anomalous_ips(spark, sf):
    """Distinct anomalous IPs and anomaly count per day."""
    return D.distinct_anomalous_ips(_scored(spark, sf))
