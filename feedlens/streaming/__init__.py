"""Structured Streaming counterparts. Rows later than the watermark are dropped."""
