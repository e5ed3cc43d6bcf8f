"""Column-level building blocks: cleaning of raw strings, exact money and
rounding rules, bands and labels, period windows, MCC categories."""
