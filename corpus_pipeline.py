"""A training corpus from ``documents``: the stages of the package, as the driver calls them."""

from cohortlens.llm.pipeline import STAGES, run

# Trees, fingerprints and ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None

__all__ = ["ORACLE_SQL", "STAGES", "run"]
