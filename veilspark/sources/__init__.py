"""Dataset registry, variant and result tables, CSV and TSV."""
