"""Byte-exact archives of files, with pixels compressed and optional parity."""
