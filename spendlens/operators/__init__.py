"""The analyses, each a lazy DataFrame → DataFrame function over a Ledger:
KPIs, spending, merchants, rewards (with the card catalogue), insights."""
