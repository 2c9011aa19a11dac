"""Process-mining operators over event logs."""
