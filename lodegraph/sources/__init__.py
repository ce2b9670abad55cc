"""Where sources come from."""
