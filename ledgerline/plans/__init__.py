"""Registered queries by family; importing this package registers them."""

from ledgerline.plans import attribution, catalogue, docking, domain, evidence, ingest, models, provenance, retrieval, structures  # noqa: F401
