"""Resumable feeds and waves."""
