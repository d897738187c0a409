"""End-to-end jobs: directory scans and the registered queries."""
