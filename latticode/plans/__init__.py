"""Jobs a user runs: ingest, embed, build an index, search, explore, verify."""
