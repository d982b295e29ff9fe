"""Writers: dataset documents and tables, sidecars, counters."""
