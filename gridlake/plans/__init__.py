"""gridlake plans."""
