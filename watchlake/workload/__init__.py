"""The library applied to the benchmark tables, with matching SQL for checks."""
