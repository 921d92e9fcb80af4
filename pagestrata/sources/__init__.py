"""Readers of page tables, file trees, manifests and index documents."""
