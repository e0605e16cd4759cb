"""Sources and sinks: nested provider payloads to typed rows, and the report writers."""
