"""DataFrame-level operators: detection, profiles, levels, report analytics."""
