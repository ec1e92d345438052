"""Survey-planning analytics as DataFrame, SQL, Arrow and Structured Streaming operators."""
