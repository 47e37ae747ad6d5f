"""Where tables come from: versioned snapshots, outside tables and CSV files."""
