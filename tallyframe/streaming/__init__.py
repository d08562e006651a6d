"""The call log fed by a stream of call records."""
