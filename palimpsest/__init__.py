"""palimpsest: analytics over AI-agent context on Spark."""
