"""Readers of bundles and harvesters of schemas, specifications, histories and pages."""
