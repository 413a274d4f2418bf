"""Sessions, scans, sinks and generated data."""
