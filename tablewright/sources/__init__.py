"""Readers and writers: uploads, document tables, exports."""
