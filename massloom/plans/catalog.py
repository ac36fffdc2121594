"""The registered queries and their DuckDB oracles, gathered from the plan modules."""

from massloom.plans import calibration, files, peptides, spectra

FLAGSHIP = "unweighted_spectral_entropy"
MODULES = (spectra, calibration, peptides, files)
QUERIES: dict = {name: fn for module in MODULES for name, fn in module.QUERIES.items()}
ORACLES: dict = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
