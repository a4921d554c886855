"""Sources and sinks: keyed snapshots, completed records, result files, JSON records."""
