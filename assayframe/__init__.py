"""assayframe: wide biological measurement matrices as Spark cells.

A matrix of samples by features is held as one sparse, long table of *cells*
``(assay, cohort, sample_id, occ, feature_name, database_id, transcript_id,
value)``; every operator takes DataFrames and returns DataFrames.
"""

from assayframe.session import SESSION_CONF, tuned

__all__ = ["SESSION_CONF", "tuned"]
