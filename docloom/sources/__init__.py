"""Sources, sinks and derived relations."""
