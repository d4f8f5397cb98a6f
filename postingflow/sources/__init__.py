"""Readers and writers: snapshots, listing/detail payloads, logs."""
