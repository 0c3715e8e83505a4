"""Timeline analytics on Spark: declared edits are rows, joins and windows."""
