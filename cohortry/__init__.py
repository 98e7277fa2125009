"""Hospital-cohort analytics expressed as Spark DataFrame operators.

Modules
-------
``sources``    reading, writing and materialising tables
``functions``  column expressions and distribution tails
``operators``  DataFrame -> DataFrame building blocks
``plans``      end-to-end jobs composed from the operators
"""

from cohortry.session import build_session, tune

__all__ = ["build_session", "tune"]
