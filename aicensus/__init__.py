"""Evidence-backed AI-asset inventories over fleets of scans, as Spark DataFrames."""
