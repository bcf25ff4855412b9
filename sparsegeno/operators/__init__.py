"""Estimators and tests on panels."""
