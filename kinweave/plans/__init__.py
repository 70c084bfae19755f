"""End-to-end queries and the registry the driver reads."""
