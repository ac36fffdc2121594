"""massloom: PySpark feature engineering for peptide-spectrum matches."""
