"""Feature frames for the isolation forest and the classifiers.

``add_entropy_features`` is the training feature step: path entropy of the
URI (``uri`` or else ``request_uri``), query-string entropy (restored from the
rule when the log has no query string), and the ordinal codes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatewatch import constants as K
from gatewatch.functions import codes as C
from gatewatch.functions import text as X
from gatewatch.session import partition_bytes, plan_bytes

TRAIN_FEATURES = ["country_code", "rule_code", "uri_len", "path_entropy", "args_entropy"]
EDGE_FEATURES = ["country_code", "rule_code", "uri_len", "uri_entropy", "rule_entropy"]
URI4_FEATURES = ["uri_length", "special_chars", "risk_keyword", "uri_entropy"]


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Round-robin an input too small to give every task slot a split before
    CPU-heavy per-row work. Larger inputs are left as they are: their scan
    already splits. Rows are the same either way; the size is the plan's
    estimate, no job runs."""
    spark = df.sparkSession
    want = min_partitions or spark.sparkContext.defaultParallelism
    size = plan_bytes(df)
    if size is not None and size < want * partition_bytes(spark):
        return df.repartition(want)
    return df


def require_columns(df: DataFrame, cols: list[str]) -> None:
    """Fail before any job runs when feature columns are missing."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing feature columns: {missing}")


def uri_column(df: DataFrame) -> str:
    return "uri" if "uri" in df.columns else "request_uri"


def add_entropy_features(df: DataFrame, row_id: str = "row_id") -> DataFrame:
    """path_entropy over the URI; args_entropy over ``request_args`` (restored
    from ``terminatingruleid`` when that column is absent)."""
    ucol = uri_column(df)
    out = df
    if "request_args" not in df.columns:
        out = out.withColumn("request_args", X.restore_args("terminatingruleid", row_id))
    return out.withColumns({
        "path_entropy": X.shannon_entropy(F.coalesce(F.col(ucol), F.lit(""))),
        "args_entropy": X.shannon_entropy(F.coalesce(F.col("request_args"), F.lit(""))),
    })


def add_codes(df: DataFrame, country: str = "country", rule: str = "terminatingruleid",
              uri: str | None = None) -> DataFrame:
    ucol = uri or uri_column(df)
    return df.withColumns({
        "country_code": C.country_code(country).cast("double"),
        "rule_code": C.rule_code(rule).cast("double"),
        "uri_len": X.text_length(ucol).cast("double"),
    })


def training_frame(df: DataFrame, features: list[str] = TRAIN_FEATURES) -> DataFrame:
    """Codes + entropies; null numeric features become 0."""
    out = add_entropy_features(add_codes(df))
    require_columns(out, features)
    return out.na.fill(0.0, subset=features)


def uri4_frame(df: DataFrame, uri: str = "request_uri") -> DataFrame:
    """The 4-feature URI model's inputs: length, specials, keywords, entropy."""
    return df.withColumns({
        "uri_length": X.text_length(uri).cast("double"),
        "special_chars": X.special_char_count(uri).cast("double"),
        "risk_keyword": X.risk_keyword_count(uri).cast("double"),
        "uri_entropy": X.shannon_entropy(uri),
    })


def edge_frame(df: DataFrame, country_map: dict, uri: str = "uri", headers: str = "headers") -> DataFrame:
    """Edge feature set: country from the viewer-country header (default 'XX',
    unseen -> max+1), rule code fixed 0, URI length and entropy, rule entropy.
    A null URI has null features: it cannot be scored (the edge fails open)."""
    known = F.col(uri).isNotNull()
    country = C.header_value(headers, K.VIEWER_COUNTRY_HEADER, K.UNKNOWN_COUNTRY)
    return df.withColumns({
        "country_code": C.edge_country_code(country, country_map),
        "rule_code": F.lit(0.0),
        "uri_len": F.when(known, X.text_length(uri).cast("double")),
        "uri_entropy": F.when(known, X.shannon_entropy(uri)),
        "rule_entropy": X.rule_code_entropy(F.lit(0)),
    })

