"""Query catalogue (Spark side), the DuckDB oracle SQL, and plan inspection."""
