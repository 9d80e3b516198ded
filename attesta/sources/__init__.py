"""Sources and sinks: CSV files, configuration, staged views, contracts, the table store."""
