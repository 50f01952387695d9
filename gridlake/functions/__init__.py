"""gridlake functions."""
