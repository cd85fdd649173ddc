"""Structured Streaming variants of the weekly cohorts (an extension; the batch reports are the contract)."""
