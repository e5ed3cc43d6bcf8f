"""Tables in and out: schemas and the Ledger, file loaders, bindings of the
driver's test tables, and CSV exports."""
