"""gridlake operators."""
