"""Query catalogue: what each operator computes on the test tables, with SQL equivalents."""
