"""Readers and writers: code index, source files, logs, history exports."""
