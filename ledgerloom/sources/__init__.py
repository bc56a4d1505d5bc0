"""Where tables come from and go to: CSV files, the versioned store, the supplier graph."""
