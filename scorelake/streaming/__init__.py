"""Live processing of event logs with Structured Streaming."""
