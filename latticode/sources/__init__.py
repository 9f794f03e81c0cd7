"""Sources and sinks: papers, tables, codebooks and indexes."""
