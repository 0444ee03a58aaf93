"""Readers, writers and adapters: WAF JSON logs, scored events, CSV, metrics, scan
reports, API logs, text reports, model tables; adapters shape the test tables."""
