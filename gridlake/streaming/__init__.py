"""gridlake streaming."""
