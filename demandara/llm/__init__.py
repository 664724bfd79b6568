"""Operators for large text corpora: tokens, near copies, decontamination, packing, scans."""
