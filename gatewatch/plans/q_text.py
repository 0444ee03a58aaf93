"""Text-feature queries: entropies, lengths, specials, keywords, classifiers,
payload restoration and ordinal codes."""

from __future__ import annotations

from pyspark.sql import functions as F

from gatewatch import constants as K
from gatewatch.functions import codes as C
from gatewatch.functions import text as X
from gatewatch.operators.dashboards import value_counts
from gatewatch.operators.features import spread, uri4_frame
from gatewatch.plans.registry import query, table
from gatewatch.plans.sqlviews import DOCREQ, WAF, WEB, entropy_sql, restore_args_sql, with_
from gatewatch.sources.adapters import doc_requests, waf_logs, web_requests

def _sql_any_contains(expr, words):
    return "(" + " OR ".join(f"contains({expr}, '{w}')" for w in words) + ")"


SPECIAL_SQL = r"[<>{}\[\]()*&%$!?]"


def _special_sql(expr):
    return f"CAST(length(regexp_extract_all(coalesce({expr}, ''), '{SPECIAL_SQL}')) AS BIGINT)"


def _keywords_sql(expr, words=K.RISK_KEYWORDS):
    return "CAST((" + " + ".join(f"CAST(contains(lower(coalesce({expr}, '')), '{w}') AS INTEGER)"
                                 for w in words) + ") AS BIGINT)"


def _threat_sql(uri, args, ent):
    u = f"lower(coalesce({uri}, ''))"
    a = f"lower(coalesce({args}, ''))"
    return (f"CASE WHEN {_sql_any_contains(a, K.THREAT_SQL_WORDS)} THEN '{K.THREAT_SQL}' "
            f"WHEN {_sql_any_contains(a, K.THREAT_XSS_MARKS)} THEN '{K.THREAT_XSS}' "
            f"WHEN {_sql_any_contains(u, K.THREAT_ADMIN_WORDS)} THEN '{K.THREAT_ADMIN}' "
            f"WHEN {_sql_any_contains(u, K.THREAT_TRAVERSAL_MARKS)} THEN '{K.THREAT_TRAVERSAL}' "
            f"WHEN {ent} > {K.THREAT_ENTROPY_LIMIT} THEN '{K.THREAT_ENCODED}' "
            f"ELSE '{K.THREAT_FALLBACK}' END")


@query("url_entropy", with_(WEB) + f"""
SELECT row_id, host,
       round({entropy_sql('request_uri')}, 6) AS path_entropy,
       round({entropy_sql('request_args')}, 6) AS args_entropy,
       CAST(length(request_uri) AS BIGINT) AS uri_len
FROM web""")
def url_entropy(spark, sf):
    """Path and query-string entropy and path length of every page URL."""
    w = spread(web_requests(table(spark, sf, "pages")))
    return w.select("row_id", "host",
                    X.round6(X.shannon_entropy("request_uri")).alias("path_entropy"),
                    X.round6(X.shannon_entropy("request_args")).alias("args_entropy"),
                    X.text_length("request_uri").alias("uri_len"))


@query("doc_entropy", f"""
SELECT doc_id, lang, round({entropy_sql('text')}, 6) AS entropy,
       CAST(length(coalesce(text, '')) AS BIGINT) AS n_chars
FROM documents""")
def doc_entropy(spark, sf):
    """Shannon entropy over the code points of every whole document."""
    d = spread(table(spark, sf, "documents"))
    return d.select("doc_id", "lang", X.round6(X.shannon_entropy("text")).alias("entropy"),
                    X.text_length("text").alias("n_chars"))


def _class_entropy_sql(expr):
    s = f"coalesce({expr}, '')"
    cnt = {
        "a": f"length(regexp_extract_all({s}, '\\p{{L}}'))",
        "d": f"length(regexp_extract_all({s}, '[\\p{{Nd}}{X.OTHER_DIGITS}]'))",
        "o": f"length(regexp_extract_all({s}, '[^\\p{{L}}\\p{{N}} \\t]'))",
        "s": f"length(regexp_extract_all({s}, '[ \\t]'))",
    }
    n = f"length({s})"
    terms = " + ".join(f"(CASE WHEN {c} > 0 THEN -({c} / {n}) * log2({c} / {n}) ELSE 0 END)"
                       for c in cnt.values())
    return f"(CASE WHEN {n} = 0 THEN 0.0 ELSE abs({terms}) END)"


@query("class_entropy", f"""
SELECT doc_id, round({_class_entropy_sql('text')}, 6) AS class_entropy FROM documents""")
def class_entropy(spark, sf):
    """Entropy over letter / digit / space / other classes of every document."""
    d = spread(table(spark, sf, "documents"))
    return d.select("doc_id", X.round6(X.class_entropy("text")).alias("class_entropy"))


def _bin_entropy_sql(code):
    # Python bin(): '0b' + binary digits (code >= 0 here)
    b = f"concat('0b', ltrim(CAST(CAST({code} AS BIGINT)::BIT AS VARCHAR), '0'))"
    b = f"(CASE WHEN {code} = 0 THEN '0b0' ELSE {b} END)"
    return entropy_sql(b)


@query("rule_entropy", with_(WAF) + f"""
SELECT rule, rule_code, round({_bin_entropy_sql('rule_code')}, 6) AS rule_entropy, COUNT(*) AS n
FROM (SELECT terminatingruleid AS rule,
             CAST(CASE terminatingruleid WHEN '{K.RULE_SQLI}' THEN 0 WHEN '{K.GEO_RULE_IN_LABELS}' THEN 1
                  WHEN '{K.RULE_DEFAULT}' THEN 2 ELSE 999 END AS BIGINT) AS rule_code FROM waf) t
GROUP BY rule, rule_code""")
def rule_entropy(spark, sf):
    """Rule code of every log row, entropy of its binary text, rows per rule."""
    w = waf_logs(table(spark, sf, "events"))
    coded = w.select(F.col("terminatingruleid").alias("rule"),
                     C.rule_code("terminatingruleid").cast("long").alias("rule_code"))
    return (coded.withColumn("rule_entropy", X.round6(X.rule_code_entropy("rule_code")))
            .groupBy("rule", "rule_code", "rule_entropy").agg(F.count(F.lit(1)).alias("n")))


@query("uri_features4", with_(WEB) + f"""
SELECT row_id, CAST(length(request_uri) AS DOUBLE) AS uri_length,
       CAST({_special_sql('request_uri')} AS DOUBLE) AS special_chars,
       CAST({_keywords_sql('request_uri')} AS DOUBLE) AS risk_keyword,
       round({entropy_sql('request_uri')}, 6) AS uri_entropy
FROM web""")
def uri_features4(spark, sf):
    """The 4-feature URI vector (length, specials, keywords, entropy) per page."""
    f = uri4_frame(spread(web_requests(table(spark, sf, "pages"))))
    return f.select("row_id", "uri_length", "special_chars", "risk_keyword",
                    X.round6("uri_entropy").alias("uri_entropy"))


@query("threat_class", with_(DOCREQ) + f"""
SELECT row_id, {_threat_sql('request_uri', 'request_args', entropy_sql('request_args'))} AS threat_type
FROM docreq""")
def threat_class(spark, sf):
    """Ordered threat classifier over every document taken as a query string."""
    d = spread(doc_requests(table(spark, sf, "documents")))
    return d.select("row_id", X.classify_threat("request_uri", "request_args",
                                                X.shannon_entropy("request_args")).alias("threat_type"))


@query("threat_counts", with_(DOCREQ) + f"""
SELECT threat_type, COUNT(*) AS cnt FROM (
  SELECT {_threat_sql('request_uri', 'request_args', entropy_sql('request_args'))} AS threat_type FROM docreq) t
GROUP BY threat_type ORDER BY cnt DESC, threat_type""")
def threat_counts(spark, sf):
    """Value counts of threat types over all documents, descending."""
    d = spread(doc_requests(table(spark, sf, "documents")))
    typed = d.select(X.classify_threat("request_uri", "request_args",
                                       X.shannon_entropy("request_args")).alias("threat_type"))
    return value_counts(typed, "threat_type")


@query("scanner_label", with_(WEB) + f"""
SELECT row_id,
       CASE WHEN {_sql_any_contains("lower(url)", K.SCANNER_PATTERNS)}
              OR length(regexp_extract_all(lower(url), '{SPECIAL_SQL}')) > {K.SCANNER_SPECIAL_LIMIT}
            THEN 1 ELSE 0 END AS true_label,
       {_special_sql('url')} AS special_chars
FROM web""")
def scanner_label(spark, sf):
    """Scanner-attack label of every full page URL."""
    w = web_requests(table(spark, sf, "pages"))
    return w.select("row_id", X.scanner_label("url").alias("true_label"),
                    X.special_char_count("url").alias("special_chars"))


@query("doc_scanner_label", f"""
SELECT doc_id,
       CASE WHEN {_sql_any_contains("lower(text)", K.SCANNER_PATTERNS)}
              OR length(regexp_extract_all(lower(text), '{SPECIAL_SQL}')) > {K.SCANNER_SPECIAL_LIMIT}
            THEN 1 ELSE 0 END AS true_label,
       {_keywords_sql('text')} AS risk_keyword
FROM documents""")
def doc_scanner_label(spark, sf):
    """Scanner label and risk-keyword count over every whole document."""
    d = spread(table(spark, sf, "documents"))
    return d.select("doc_id", X.scanner_label("text").alias("true_label"),
                    X.risk_keyword_count("text").alias("risk_keyword"))


@query("payload_restore", with_(WAF) + f"""
SELECT row_id, terminatingruleid AS rule, {restore_args_sql('terminatingruleid', 'row_id')} AS request_args,
       round({entropy_sql(restore_args_sql('terminatingruleid', 'row_id'))}, 6) AS args_entropy
FROM waf""")
def payload_restore(spark, sf):
    """Query string restored from the rule type, and its entropy, per log row."""
    w = waf_logs(table(spark, sf, "events"))
    r = w.select("row_id", F.col("terminatingruleid").alias("rule"),
                 X.restore_args("terminatingruleid", "row_id").alias("request_args"))
    return r.withColumn("args_entropy", X.round6(X.shannon_entropy("request_args")))


@query("encode_codes", with_(WAF) + f"""
SELECT row_id,
       CAST(coalesce(CASE country WHEN 'KR' THEN 0 WHEN 'NL' THEN 1 WHEN 'US' THEN 2 END, 99) AS BIGINT) AS country_code,
       CAST(coalesce(CASE terminatingruleid WHEN '{K.RULE_SQLI}' THEN 0 WHEN '{K.GEO_RULE_IN_LABELS}' THEN 1
                     WHEN '{K.RULE_DEFAULT}' THEN 2 END, 999) AS BIGINT) AS rule_code,
       CAST(coalesce(CASE country WHEN 'KR' THEN 0 WHEN 'NL' THEN 1 WHEN 'US' THEN 2 END, 3) AS DOUBLE) AS edge_country_code
FROM waf""")
def encode_codes(spark, sf):
    """Ordinal country and rule codes; edge variant maps unseen countries to max+1."""
    w = waf_logs(table(spark, sf, "events"))
    country = C.header_value("httprequest.headers", K.VIEWER_COUNTRY_HEADER, K.UNKNOWN_COUNTRY)
    return w.select("row_id",
                    C.country_code("httprequest.country").cast("long").alias("country_code"),
                    C.rule_code("terminatingruleid").cast("long").alias("rule_code"),
                    C.edge_country_code(country, K.COUNTRY_CODES).alias("edge_country_code"))
