"""Readers: file scans, manifests, analysis results, symbol extraction, platform logs."""
