"""Adapters from plain tables to the concept model, and the registered queries with their SQL."""
