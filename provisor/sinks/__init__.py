"""Writers: versioned snapshots and exports."""
