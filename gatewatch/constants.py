"""Fixed values the results depend on.

FIXED VALUES — these must equal the values of the system we re-implement
(rule names, keyword lists, payload lists, code maps, bounds, scenario
timeline). They are stated here plainly, in their natural order.
"""

# --- WAF rule names (terminating rule ids) and their priorities 0..4 --------
RULE_GEO = "GeoBlock-Non-KR"
RULE_AI_BLOCK = "AI-RealTime-Block-Rule"
RULE_SQLI = "AWS-AWSManagedRulesSQLiRuleSet"
RULE_COMMON = "AWS-AWSManagedRulesCommonRuleSet"
RULE_REPUTATION = "AWS-AWSManagedRulesAmazonIpReputationList"
RULE_DEFAULT = "Default_Action"
GEO_RULE_IN_LABELS = "Allow-Only-Korea"
ALLOWED_COUNTRIES = ["KR"]

# --- dashboard attack-type CASE (ordered, first match wins) -----------------
# (kind, pattern, label): kind 'like' is a SQL LIKE pattern, 'eq' an equality
ATTACK_TYPE_RULES = [
    ("like", "%SQLi%", "SQLi"),
    ("like", "%XSS%", "XSS"),
    ("like", "%CommonRule%", "CommonRuleSet"),
    ("eq", "GeoBlock-Non-KR", "GeoBlock"),
    ("eq", "AI-RealTime-Block-Rule", "AI Block"),
    ("like", "%ReputationList%", "IP Reputation"),
]
ATTACK_TYPE_ELSE = "Other"

# --- payloads used to restore missing query strings, by rule type -----------
SQLI_PAYLOADS = [
    "id=1' UNION SELECT username,password FROM users--",
    "id=1 OR 1=1--",
    "user=admin'--",
    "id=1' AND SLEEP(5)--",
    "q=1; DROP TABLE sessions--",
    "id=1' AND 1=CONVERT(int,@@version)--",
]
XSS_PAYLOADS = [
    "q=%3cscript%3ealert%28document.cookie%29%3c%2fscript%3e",
    "input=<img src=x onerror=alert(1)>",
    "search=%22%3E%3Cscript%3Ealert%281%29%3C%2Fscript%3E",
    "q=<svg onload=alert(1)>",
]

# --- request headers ------------------------------------------------------------
VIEWER_COUNTRY_HEADER = "cloudfront-viewer-country"
UNKNOWN_COUNTRY = "XX"

# --- text features -----------------------------------------------------------
SPECIAL_CHARS_REGEX = r"[<>{}\[\]()*&%$!?]"
RISK_KEYWORDS = ["script", "select", "union", "drop", "admin", "etc/passwd", "../"]
SCANNER_PATTERNS = ["etc/passwd", "bin/sh", "script", "union", "select", ".pl", "alert(", "eval-stdin"]
SCANNER_SPECIAL_LIMIT = 3

# --- threat classifier (ordered) ---------------------------------------------
THREAT_SQL_WORDS = ["union", "select", "drop", "sleep"]
THREAT_XSS_MARKS = ["script", "%3c", "onerror", "onload"]
THREAT_ADMIN_WORDS = ["admin", "login"]
THREAT_TRAVERSAL_MARKS = ["../", "etc"]
THREAT_ENTROPY_LIMIT = 4.0
THREAT_SQL = "SQL Injection"
THREAT_XSS = "XSS Attempt"
THREAT_ADMIN = "Admin Access Try"
THREAT_TRAVERSAL = "Path Traversal"
THREAT_ENCODED = "Encoded Payload Attack"
THREAT_FALLBACK = "GeoBlock / Rule Anomaly"

# --- ordinal encodings --------------------------------------------------------
COUNTRY_CODES = {"KR": 0, "NL": 1, "US": 2}
COUNTRY_CODE_ELSE = 99
RULE_CODES = {"AWS-AWSManagedRulesSQLiRuleSet": 0, "Allow-Only-Korea": 1, "Default_Action": 2}
RULE_CODE_ELSE = 999

# --- evaluation groups ----------------------------------------------------------
GROUP_SQLI = "SQLi"
GROUP_SENTINEL = "sentinel"
GROUP_OTHER = "other"

# --- scores ------------------------------------------------------------------------
SCORE_HISTOGRAM_BOUNDS = [-0.30, -0.20, -0.15, -0.10, -0.05, 0.00, 0.05, 0.10, 0.15, 0.20, 0.30]
CONTAMINATION_SWEEP = [0.05, 0.10, 0.15, 0.20, 0.25, 0.30]
RECOMMENDED_DEFAULT = 0.25
RECOMMEND_PCT_RANGE = (20.0, 30.0)
STABILITY_IQR_LIMIT = 0.05
EULER_GAMMA = 0.5772156649

# --- contamination sentinel ---------------------------------------------------
SENTINEL_TOLERANCE = 0.10
SENTINEL_MIN_C = 0.01
SENTINEL_MAX_C = 0.40

# --- risk / scenario -----------------------------------------------------------
PRED_THRESHOLD = 70
SCENARIO = [("NORMAL", 50), ("PREDICT", 40), ("PREMITIGATE", 40), ("ATTACK_ATTEMPT", 40), ("STABILIZE", 40)]
LATCH_RESET_AFTER = 190
MITIGATION_START = 90
MITIGATION_SPAN = 40
MITIGATION_STEPS = (0.33, 0.66)
OBS_RISK_CAP = 75.0
THRESHOLD_PERCENTILE = 5

# --- traffic hour bands (KST = UTC+9) ---------------------------------------------
KST_OFFSET_HOURS = 9
HOUR_BANDS = [(9, 18, 1.0), (19, 23, 0.6)]
HOUR_BAND_ELSE = 0.2

# --- response ------------------------------------------------------------------------
DEFENSE_METRIC = "DefenseSignal"
ALERT_MESSAGE = "AI-based Anomaly Detected"

# --- budget ------------------------------------------------------------------------------
BUDGET_ALERT_PCT = 80

# --- compliance controls (config rule names carry the control id) --------------------
CONFIG_RULE_NAMES = [
    "isms-2-5-iam-root-access-key-check",
    "isms-2-5-iam-password-policy",
    "isms-2-5-mfa-enabled-for-iam-console",
    "isms-2-6-s3-public-read-prohibited",
    "isms-2-6-s3-public-write-prohibited",
    "isms-2-6-vpc-default-sg-closed",
    "isms-2-9-cloudtrail-enabled",
    "isms-2-9-cloudtrail-log-validation",
    "isms-2-10-s3-ssl-requests-only",
    "isms-2-10-encrypted-volumes",
    "isms-2-11-guardduty-enabled",
]
CONFIG_EVENT_PATTERN = {
    "source": ["aws.config"],
    "detail-type": ["Config Rules Compliance Change"],
    "detail.newEvaluationResult.complianceType": ["NON_COMPLIANT"],
}
AUDIT_EVENT_PATTERN = {
    "source": ["aws.wafv2"],
    "detail-type": ["WAF Configuration Change", "AWS API Call via CloudTrail"],
    "detail.eventName": ["UpdateWebACL", "DeleteWebACL"],
}
