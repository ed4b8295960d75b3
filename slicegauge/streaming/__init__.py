"""Incremental forms: quota filling from a row stream and a restartable run ledger."""
