"""DataFrame operators over property graphs."""
