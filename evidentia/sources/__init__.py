"""Sources: files and extracted tables in, activity events (or artifact rows) out."""
