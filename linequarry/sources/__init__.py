"""Sources: loose files and members of archives."""
