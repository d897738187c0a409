"""Sources and sinks: directories, tables, reports."""
