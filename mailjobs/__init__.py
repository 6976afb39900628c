"""PySpark jobs for mail triage at scale."""
