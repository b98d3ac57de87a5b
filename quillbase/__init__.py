"""Quillbase: lazy DataFrame transforms for token ledgers, market signals, snapshots and documents."""
