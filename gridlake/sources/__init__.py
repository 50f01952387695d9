"""gridlake sources."""
