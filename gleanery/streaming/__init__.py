"""The dataflow as Structured Streaming queries."""
