"""Column functions built from native Spark expressions: text features, codes,
IPs, headers, time parts."""
