"""Readers and writers: wide count tables, FASTA, stage tables and reports."""
