"""Writers: table replace, snapshots, append-only audit log, JSON exports."""
