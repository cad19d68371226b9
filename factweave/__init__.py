"""factweave: evidence fusion, reconciliation and three-state entity search as Spark plans."""
