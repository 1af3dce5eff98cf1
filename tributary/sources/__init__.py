"""Scans and sinks: landing streams, exports and the snapshotting table store."""
