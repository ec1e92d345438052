"""Training-data operators: extraction, scans, joins, tokenisation, packing."""
