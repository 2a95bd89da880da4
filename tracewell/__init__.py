"""Media-evidence triage over Spark DataFrames."""
