"""Queries over the tables, by topic. Importing this package registers them all."""

from docengine.plans import documents, library, overlays, quality_report, reports, sheets, texts, workbench  # noqa: F401
