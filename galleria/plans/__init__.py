"""Queries of the library, by topic."""

from galleria.plans import enrol, evaluation, geometry, ingest, jobs, people, pixels, quality, recognition, scalars, streams  # noqa: F401
