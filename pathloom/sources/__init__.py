"""Reading, mapping and writing event logs."""
