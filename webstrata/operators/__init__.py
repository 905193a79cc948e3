"""Search, extraction and result operators over the resource table."""
