"""DataFrame operators: dashboards, features, exact quantiles, statistics, policy
replay and membership, chunked scans, risk, response, isolation forest, federation."""
