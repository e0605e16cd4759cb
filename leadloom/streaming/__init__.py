"""Structured Streaming operators, each beside the batch twin it must agree with."""
