"""Files of vectors, snapshots and logs."""
